"""Running aggregates that stay bounded per task.

A plain window puts all rows of a key into one task, so a conversation that
holds a third of all messages would be one task. Here rows are cut into blocks
of at most ``2**bits`` consecutive order values (the order column is a unique
integer per key), the running aggregate is computed inside each block, and the
blocks' totals, one row per block, are carried forward by a second and much
smaller pass. Without a key, the block pass is applied again to the block
table, so no task ever sees more than ``2**bits`` rows of one level.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.session import materialize

_AGGREGATES = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


_WIDE = re.compile(r"^[\s:+\-!]*(Join|Aggregate|Window|Generate|Sort|Union|Repartition\w*|RebalancePartitions|MapIn\w+|Expand)\b", re.M)


def read_once(df: DataFrame) -> DataFrame:
    """``df`` for uses that read it more than once: itself if it is a plain scan, else written and read back.

    Without that, every further use in a plan would evaluate everything below again, and nested uses multiply.
    """
    if df.isStreaming or not _WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    return materialize(df, "scan-input")


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    *,
    descending: bool = False,
    inclusive: bool = True,
    bits: int = 16,
    levels: int | None = None,
) -> DataFrame:
    """Add running aggregates over ``keys`` in the order of an integer column.

    ``specs`` maps an output column to (sum | max | min, integer expression).
    ``inclusive=False`` leaves the current row out. Rows with equal order
    values in a key are not supported: the order must be total.
    """
    if levels is None:
        levels = 1 if keys else 3
    base = df
    inputs = {}
    for name, (kind, expr) in specs.items():
        inputs[name] = f"__in_{name}"
        base = base.withColumn(inputs[name], expr)
    blocked = read_once(base).withColumn("__block", F.shiftright(F.col(order).cast("bigint"), bits))
    by = [*keys, "__block"]
    direction = F.col(order).desc() if descending else F.col(order).asc()
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    local = Window.partitionBy(*by).orderBy(direction).rowsBetween(*frame)
    totals = blocked.groupBy(*by).agg(
        *[_AGGREGATES[kind](F.col(inputs[name])).alias(inputs[name]) for name, (kind, _) in specs.items()]
    )
    carry_specs = {f"__carry_{name}": (kind, F.col(inputs[name])) for name, (kind, _) in specs.items()}
    if levels <= 1:
        block_order = F.col("__block").desc() if descending else F.col("__block").asc()
        spec = Window.partitionBy(*keys).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *by, *[_AGGREGATES[kind](expr).over(spec).alias(name) for name, (kind, expr) in carry_specs.items()]
        )
    else:
        renamed = totals.withColumnRenamed("__block", "__order")
        carried = running(
            renamed, keys, "__order", carry_specs,
            descending=descending, inclusive=False, bits=bits, levels=levels - 1,
        ).select(*keys, F.col("__order").alias("__block"), *carry_specs)
    scanned = blocked.select(
        "*", *[_AGGREGATES[kind](F.col(inputs[name])).over(local).alias(f"__local_{name}") for name, (kind, _) in specs.items()]
    )
    joined = scanned.join(carried, by, "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in specs],
        *[
            _combine(kind, F.col(f"__local_{name}"), F.col(f"__carry_{name}")).alias(name)
            for name, (kind, _) in specs.items()
        ],
    )


def join_per_key(
    df: DataFrame, small: DataFrame, keys: list[str], order: str, how: str = "inner", bits: int = 16
) -> DataFrame:
    """Join one row per key onto many rows of that key without one task per key.

    The small side is first repeated for the blocks its key really spans (one
    for an ordinary key), then joined by key and block. A later aggregate by
    key does not pull the rows of a hot key together either.
    """
    blocked = read_once(df).withColumn("__block", F.shiftright(F.col(order).cast("bigint"), bits))
    cells = blocked.select(*keys, "__block").distinct()
    return blocked.join(cells.join(small, keys, how), [*keys, "__block"]).drop("__block")


def dense_numbers(df: DataFrame, order: str, name: str, start: Column | None = None) -> DataFrame:
    """Number all rows 1..n in the order of a unique integer column, in parallel."""
    # Two levels of 2**20 cover order values up to 2**40 with bounded tasks.
    out = running(df, [], order, {name: ("sum", F.lit(1).cast("bigint"))}, bits=20, levels=2)
    return out if start is None else out.withColumn(name, F.col(name) + start)


def first_per_key(df: DataFrame, keys: list[str], order: str, *, last: bool = False) -> DataFrame:
    """Keep each key's row with the lowest (or highest) unique ``order`` value.

    Only keys and the order value enter the aggregation, which is combined
    before the shuffle, so a key that holds most rows costs one row per task.
    The payload is picked up afterwards by a join on the unique order value;
    that side drops the keys, so an expensive key is computed once.
    """
    pick = F.max(order) if last else F.min(order)
    winners = df.groupBy(*keys).agg(pick.alias(order))
    # Winners are narrow and as evenly spread as the order values: hashed, so that the payload is not sorted.
    return df.drop(*keys).join(winners.hint("shuffle_hash"), order).select(*df.columns)


def ordered_lists(df: DataFrame, keys: list[str], order: str, lists: dict[str, Column], others: dict[str, Column] | None = None, bits: int = 12) -> DataFrame:
    """``keys``, an array per entry of ``lists`` with its non-NULL values in the order of a unique integer column, and other aggregates.

    Values are gathered in blocks of 2**bits order values first, in as many tasks as a key has blocks; only blocks, one row each,
    are put together by key. ``others``: boolean conditions, true if any row's is.
    """
    kinds = dict(df.select(*[c.alias(n) for n, c in lists.items()]).dtypes)
    flags = others or {}
    rows = df.select(
        *keys, F.col(order).cast("bigint").alias("__at"), F.shiftright(F.col(order).cast("bigint"), bits).alias("__block"),
        *[F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{kinds[n]}>")).alias(n) for n, c in lists.items()],
        *[c.alias(n) for n, c in flags.items()],
    )

    def gathered(at: str) -> list[Column]:
        whole = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(n) > 0, F.struct(F.col(at).alias("at"), F.col(n).alias("v"))))), lambda x: x["v"])).alias(n) for n in lists]
        return whole + [F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags]

    return rows.groupBy(*keys, "__block").agg(*gathered("__at")).groupBy(*keys).agg(*gathered("__block"))
