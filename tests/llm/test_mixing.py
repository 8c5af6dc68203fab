import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from supportlake.llm import mixing
from tests.llm.common import empty_table, odd_table, table


def copies(rate, doc_id, seed=0):
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    total = 0
    for i in range(parts):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 2000:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def test_equals_poisson_inversion(spark):
    texts = ["x" * (1 + i % 7) for i in range(900)]
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 3.0), ("s2", 0.0)], "source string, weight double")
    got = mixing.mix_sources(table(spark, texts), weights, size=F.lit(1), total=60_000)
    count = Counter(r.doc_id for r in got.select("doc_id").collect())
    rate = {0: 15_000 / 300, 1: 45_000 / 300, 2: 0.0}  # the second takes several parts
    assert all(count[i] == (copies(rate[i % 3], i) if i % 3 < 2 else 0) for i in range(900))
    assert abs(sum(count.values()) - 60_000) < 4 * 60_000**0.5


def test_copies_are_numbered_and_order_ignores_layout(spark):
    docs = table(spark, [f"text {i}" for i in range(200)])
    one = mixing.mix_sources(docs)
    two = mixing.mix_sources(docs.repartition(7))
    key = lambda df: sorted((r.mix_key, r.doc_id, r.mix_copy) for r in df.collect())
    assert key(one) == key(two)
    by_doc = {}
    for _, doc, copy in key(one):
        by_doc.setdefault(doc, []).append(copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_doc.values())


def test_plan_has_no_python(spark):
    plan = mixing.mix_sources(table(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows_and_empty_table(spark):
    assert mixing.mix_sources(empty_table(spark)).count() == 0
    docs = odd_table(spark)
    mixed = mixing.mix_sources(docs, size=F.lit(1), total=1600)
    rows = mixed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}  # the null id and the null source too
    assert "mix_n" not in mixed.columns and set(mixed.columns) >= {"mix_copy", "mix_rate", "mix_key", "n_words"}
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix_sources(docs, none).count() == 0
