"""Ordered corpus digests by blocks, and latency sketches that are stored and merged."""

import hashlib
import random

from pyspark.sql import functions as F

from supportlake.operators import evaluation as ev

SCHEMA = "draft_order long, source_key string, answer string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_root(rows, bits):
    level = {}
    for order, key, answer in sorted(rows, key=lambda r: r[0]):
        field = lambda x: "n" if x is None else "v" + x
        level.setdefault(order >> bits, []).append(sha(field(key) + "\0" + field(answer)))
    level = {b: sha("".join(v)) for b, v in level.items()}
    for _ in range(-(-64 // bits)):
        up = {}
        for b in sorted(level):
            up.setdefault(b >> bits, []).append(level[b])
        level = {b: sha("".join(v)) for b, v in up.items()}
    return sha("".join(level[b] for b in sorted(level)))


def test_root_equals_brute_force_and_names_changed_blocks(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 100, f"k{i}", None if i % 17 == 0 else f"text {rng.random()}") for i in range(300)] + [(10**12, None, "far")]
    frame = lambda r: spark.createDataFrame(r, SCHEMA).repartition(7)
    leaves = ev.corpus_leaves(frame(rows), bits=4)
    root = ev.corpus_root(leaves, 4).first()
    assert (root.n_chunks, root.digest) == (301, brute_root(rows, 4))
    swapped = list(rows)
    swapped[3], swapped[4] = (rows[4][0], *rows[3][1:]), (rows[3][0], *rows[4][1:])
    hidden = [(o, k, "" if a is None else a) for o, k, a in rows]
    for other, blocks in ((swapped, {rows[3][0] >> 4, rows[4][0] >> 4}), (hidden, {o >> 4 for o, _, a in rows if a is None}), (rows[:-1], {10**12 >> 4})):
        now = ev.corpus_leaves(frame(other), bits=4)
        assert ev.corpus_root(now, 4).first().digest == brute_root(other, 4) != root.digest
        found = ev.changed_blocks(leaves, now).collect()
        assert {r.block for r in found} == blocks and {r.status for r in found} == ({"removed"} if other is not swapped and other is not hidden else {"changed"})
    assert ev.corpus_root(ev.corpus_leaves(frame(rows).limit(0))).count() == 0


def test_merged_sketches_stay_within_their_rank_error(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i % 9, rng.lognormvariate(0, 2)) for i in range(40_000)] + [("a", 1, None), ("a", 1, float("nan")), ("c", 0, 1.5)]
    df = spark.createDataFrame(rows, "strategy string, day int, latency_seconds double").repartition(6)
    stored = ev.latency_sketches(df, ("strategy", "day"))
    assert stored.count() == 19 and stored.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    wanted = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    for r in ev.merge_sketches(stored, ("strategy",), wanted).collect():
        values = sorted(v for s, _, v in rows if s == r.strategy and v is not None and v == v)
        assert r.n == len(values)
        for q, v in zip(wanted, r.quantiles):
            below, upto = sum(x < v for x in values), sum(x <= v for x in values)
            assert below <= (q + r.rank_error) * len(values) and upto >= (q - r.rank_error) * len(values)
