"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets the repetition rate that brings it to its target share of the output. A row's number of copies is a
Poisson variable with that mean, found by inverting its distribution at a uniform number hashed from the row's id. So a
row's copies depend on the row, the seed and the rate alone; tasks can be repeated and rows need no coordination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.session import materialize

#: A rate above this is the sum of several equal Poisson variables, so that exp(-rate) never underflows.
PART_RATE = 64.0
#: Copies of the (small) rate table that a join by source meets where it is not broadcast; splits a hot source.
SALTS = 64
_RESOLUTION = 2.0**52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_RESOLUTION)


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), .. of a Poisson variable with a rate up to PART_RATE, until nothing is left at 52 bits."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, i: F.struct(
            (acc["p"] * rate / i).alias("p"),
            F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + acc["p"] * rate / i)).alias("steps"),
        ),
    )
    return grown["steps"]


def source_rates(docs: DataFrame, weights: DataFrame | None, size: Column, total: float | None) -> DataFrame:
    """Rate per source: ``source, units, weight, rate, parts, steps``; a source without a weight gets rate 0.

    ``weights`` has ``source, weight``; None gives every source the same weight. ``size`` is what a row counts for. A null
    source is a source of its own. Sources without any unit, and tables without weights above 0, get rate 0.
    """
    units = docs.groupBy(F.col("source").alias("source")).agg(
        F.sum(F.coalesce(size.cast("double"), F.lit(0.0))).alias("units"), F.count("*").alias("n_rows")
    )
    if weights is None:
        units = units.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").cast("double").alias("weight"))
        units = units.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        units = units.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    counted = units.withColumn("weight", F.when(F.col("units") > 0, F.col("weight")).otherwise(0.0))
    sums = counted.agg(F.sum("weight").alias("weight"), F.sum("units").alias("units")).first()  # two numbers
    scale = (total if total is not None else sums.units or 0.0) / sums.weight if sums.weight else 0.0
    rated = counted.withColumn(
        "rate", F.when(F.col("weight") > 0, F.col("weight") * F.lit(float(scale)) / F.col("units")).otherwise(0.0)
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    return rated.select("source", "n_rows", "units", "weight", "rate", parts.alias("parts")).withColumn(
        "steps", poisson_steps(F.col("rate") / F.col("parts"))
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, size: Column | None = None, total: float | None = None, seed: int = 0
) -> DataFrame:
    """``docs`` with each row repeated to meet the target weights of its source, shuffled globally.

    Columns of ``docs`` stay (``source`` and ``doc_id`` are used), then ``mix_copy`` (1..copies), ``mix_rate`` and
    ``mix_key``: rows go to the tasks by ``mix_key`` and are sorted by it, which is a random order of all copies that
    does not depend on the layout of the input. ``size`` is the unit that weights are shares of (characters by default), ``total`` the wanted output
    in that unit (the input's size by default). Equal ids get equal numbers of copies; a null id counts as the id
    "null". An empty table gives an empty result. Columns of the input that start with ``mix_`` go.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    units = F.length("text") if size is None else size
    rates = materialize(source_rates(docs, weights, units, total).where(F.col("rate") > 0), "mix-rates")
    # A written table has a known size: Spark broadcasts it under its threshold. Beyond, the salted join below
    # spreads the rows of one source over SALTS tasks.
    salted = rates.select(
        F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), "parts", "steps",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("mix_salt"),
    ).withColumnsRenamed({"parts": "mix_parts", "steps": "mix_steps"})
    rows = docs.withColumn("mix_row_salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)).cast("int"))
    joined = rows.join(
        salted, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_row_salt") == F.col("mix_salt"))
    )
    one = lambda i: F.size(F.filter("mix_steps", lambda step: step <= uniform(F.lit(seed), F.col("doc_id"), i)))
    first = F.size(F.filter("mix_steps", lambda step: step <= F.col("mix_first")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("mix_parts") - 1), F.lit(0), lambda acc, i: acc + one(i))
    counted = joined.withColumn("mix_first", uniform(F.lit(seed), F.col("doc_id"), F.lit(0))).withColumn(
        "mix_n", first + F.when(F.col("mix_parts") > 1, more).otherwise(0)
    )
    copies = counted.where("mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "mix_copy"))
    out = keyed.repartition("mix_key").sortWithinPartitions("mix_key")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_copy", "mix_rate", "mix_key")
