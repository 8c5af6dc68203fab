import math
import random

from pyspark.sql import functions as F

from supportlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k, scale=64, width=8):
    """Rows of (query, rank, id, score) as a sorted list; distinct (id, quantized vector) rows are the candidates and the queries."""
    held = set()
    for i, v, *_ in rows:
        if i is None or not v or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((i, tuple(math.floor(scale * x) for x in v)))
    out = []
    for i, q in held:
        if i % 20:
            continue
        hits = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in held if (j, w) != (i, q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k, width=8).collect()
    return sorted(tuple(r) for r in got), len(got)


def vectors(rng, n, width=8):
    import numpy as np

    return [(i, [float(np.float32(rng.gauss(0, 0.4))) for _ in range(width)], 0, "x") for i in range(n)]


def test_equals_brute_force_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "SLICE_QUERIES", 9)
    rows = vectors(random.Random(1), 400)
    # A third of all rows is one vector: ties over many blocks and shards go by id.
    rows += [(1000 + i, rows[40][1], 0, "x") for i in range(200)]
    got, n = run(spark, rows)
    assert got == brute(rows, 20) and n == len(got)


def test_odd_rows(spark):
    rows = vectors(random.Random(2), 45)
    rows += [(60, None, 1, None), (80, [None] + [0.1] * 7, 1, None), (100, [float("nan")] * 8, 1, None), (120, [float("inf")] * 8, 1, None), (140, [], 1, None), (None, rows[0][1], None, None)]
    rows += [rows[20], (20, rows[21][1], None, None), (3, rows[4][1], 0, "x")]  # a repeated row, repeated ids of a query and of a candidate
    got, n = run(spark, rows)
    assert got == brute(rows, 20) and n == len(got) == 4 * 20  # two vectors of query 20
    every, _ = run(spark, rows, 100)
    assert every == brute(rows, 100) and [r[2] for r in every if r[0] == 40].count(3) == 2 and (20, 20) in {(r[0], r[2]) for r in every}


def test_rows_of_another_width_take_no_part(spark):
    rows = vectors(random.Random(4), 45)
    # A new id, a query of its own, and ids that also have a vector of the common width.
    others = [(60, [0.5] * 7, 0, "x"), (61, [9.0] * 12, 0, "x"), (20, [9.0] * 9, 0, "x"), (3, [9.0], 0, "x")]
    got, n = run(spark, rows + others)
    assert got == brute(rows, 20) and n == len(got)


def test_few_and_no_rows(spark):
    rows = vectors(random.Random(3), 5)
    got, _ = run(spark, rows)
    assert got == brute(rows, 20) and len(got) == 4
    assert run(spark, rows[:1])[0] == []
    assert run(spark, [(0, None, 1, None)])[0] == []


def test_blocks_are_pruned():
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.vstack([np.full((topk.BLOCK_ROWS, 4), v) + rng.integers(0, 2, (topk.BLOCK_ROWS, 4)) for v in (9.0, 1.0, -5.0)])

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counted.reads += 1
            return super().__getitem__(key)

    shard = topk.Shard(np.arange(len(values)), np.zeros(len(values), dtype=np.int64), values)
    shard.values = values.view(Counted)
    query, ids, score = shard.search(np.array([-1]), np.array([0]), np.full((1, 4), 3.0), np.array([-np.inf]), np.array([2**62]), 5)
    assert Counted.reads == 1 and (ids < topk.BLOCK_ROWS).all()
