"""Stored inverted lists against the forward index, and what a search skips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supportlake.operators import postings as po
from supportlake.operators import retrieval as rt


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def zipf(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts = [(10 * i + 3, zipf(rng, rng.randint(0, 120))) for i in range(700)]
    texts += [(7001, None), (7002, ""), (7003, "only"), (-5, "negative id w1 w2"), (7010, "退款政策说明 w1"), (7011, "W1 w1 W1")]
    return spark.createDataFrame(texts, "chunk_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    some = [(i, zipf(rng, rng.randint(1, 12))) for i in range(60)]
    return spark.createDataFrame([*some, (100, "only"), (101, "退款"), (102, "absent words"), (103, ""), (104, None), (105, "w1"), (106, "w1 W1 w2")], "query_id long, text string")


@pytest.fixture(scope="module")
def index(corpus):
    kept = po.RANGE_DOCS
    po.RANGE_DOCS = 40
    try:
        return po.build_postings(corpus)
    finally:
        po.RANGE_DOCS = kept


def test_search_equals_forward_index(spark, corpus, asked, index):
    for k in (1, 10, 2000):
        assert rows(po.bm25_search(asked, index, k)) == rows(rt.bm25_topk(asked, rt.lexical_index(corpus), k))
    other = dict(k1=2.0, b=0.1)  # the stored bounds hold for any parameters
    assert rows(po.bm25_search(asked, index, 5, **other)) == rows(rt.bm25_topk(asked, rt.lexical_index(corpus), 5, **other))


def test_grid_equals_broadcast(asked, index):
    assert rows(po.bm25_search(asked, index, 7, broadcast_bytes=2000)) == rows(po.bm25_search(asked, index, 7))


def test_blocks_hold_all_postings(spark, corpus, index):
    stored = index.blocks(spark).where("term is not null")
    flat = stored.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("term", "p.ids", "p.tfs")
    want = rt.bm25_postings(rt.lexical_index(corpus.where("text is not null")))
    assert sorted(map(tuple, flat.collect())) == sorted((r.term, r.chunk_id, r.tf) for r in want.collect())
    assert stored.where("size(ids) <> n or array_max(tfs) <> max_tf or array_min(lens) <> min_len or array_sort(ids) <> ids").count() == 0
    stats = rt.bm25_stats(rt.lexical_index(corpus)).first()
    assert index.n_docs == stats.n_docs and abs(index.avg_len - stats.avg_len) < 1e-9


def test_only_buckets_of_query_terms_are_read(spark, index):
    terms = spark.createDataFrame([("w1",), ("only",)], "term string")
    buckets = po.buckets_of(index, terms)
    assert len(buckets) <= 2 < index.n_buckets
    blocks = po.posting_blocks(index, terms, buckets, "n")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]  # frequencies are read without the lists
    files = index.blocks(spark).where(F.col("bucket").isin(buckets)).select(F.input_file_name()).distinct().count()
    assert files <= 2


def test_bounds_skip_ranges_and_postings():
    """Rare terms decide: ranges without them, and postings of frequent terms, are skipped, with the same result."""
    rng = np.random.default_rng(3)
    ids, texts = np.arange(4000), []
    for _ in range(4000):
        words = [f"w{x}" for x in rng.zipf(1.3, 60) if x < 5000]
        texts.append(words + (["rare", "thing"] if rng.random() < 0.01 else []))
    blocks = [po.invert(ids[a : a + 200], pa.array(texts[a : a + 200])) for a in range(0, 4000, 200)]
    table = pa.Table.from_batches(blocks)
    table = table.filter(pa.compute.is_valid(table.column("term"))).sort_by("first_id")
    avg = float(np.mean([len(t) for t in texts]))
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = [(1, w) for w in ("rare", "thing", "w1", "w2", "w3")] + [(2, w) for w in ("w1", "w7")]
    idf = lambda w: float(np.log(1 + (4000 - df[w] + 0.5) / (df[w] + 0.5)))
    packed = po.pack_terms(pa.table({"query_id": [q for q, _ in asked], "term": [w for _, w in asked], "idf": [idf(w) for _, w in asked]}))
    seen = po.Seen()
    got = po.score_ranges(iter([table.slice(0, 30_000), table.slice(30_000)]), packed, 5, 1.2, 0.75, avg, seen).to_pylist()
    for q in (1, 2):
        score = [
            round(sum(idf(w) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for x, w in asked if x == q and w in t), 9) for t in texts
        ]
        best = sorted(range(4000), key=lambda i: (-score[i], i))[:5]
        mine = sorted((h for h in got if h["query_id"] == q), key=lambda h: (-h["score"], h["chunk_id"]))
        assert [(h["chunk_id"], h["score"]) for h in mine] == [(i, score[i]) for i in best]
    assert seen.skipped > 0 and seen.scored < 0.6 * seen.postings


def test_odd_corpora(spark, asked):
    empty = spark.createDataFrame([], "chunk_id long, text string")
    index = po.build_postings(empty)
    assert po.bm25_search(asked, index, 5).count() == 0 and index.n_docs == 0
    silent = po.build_postings(spark.createDataFrame([(1, None), (2, " ")], "chunk_id long, text string"))
    assert po.bm25_search(asked, silent, 5).count() == 0 and silent.n_docs == 2
    with pytest.raises(ValueError):
        po.bm25_search(asked, index, 0)
