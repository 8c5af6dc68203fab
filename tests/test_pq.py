"""Product quantisation: recall against the exact search, code scores and odd vectors."""

import numpy as np
import pytest

from supportlake.operators import pq
from supportlake.operators import retrieval as rt
from supportlake.plans import retrieval_queries as rq


def pairs(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_nine_of_ten_neighbours_from_a_fifth_of_the_vectors(spark, folder):
    sf = f"/root/testdata/{folder}"
    queries, corpus = rq.query_vectors(spark, sf), rq.corpus_vectors(spark, sf)
    index = rq._stored_codes(spark, sf)
    exact, near = pairs(rt.dense_topk(queries, corpus, 10)), pairs(pq.pq_search(queries, index, 10))
    found = exact.keys() & near.keys()
    print(folder, "recall", len(found) / len(exact), "probed", index.n_probe, "of", len(index.centres), "rescored", index.n_rescored, "of", index.n_rows)
    assert len(found) >= 0.9 * len(exact) and len(near) == len(exact)
    assert 5 * index.n_rescored <= index.n_rows
    assert all(abs(exact[p] - near[p]) < 1e-8 for p in found)  # scores are exact


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 10))
    values = [(centres[i % 6] + 0.3 * rng.standard_normal(10)).astype(np.float32).tolist() for i in range(400)]
    rows = [(i, v) for i, v in enumerate(values)] + [(900, None), (901, []), (902, [None] * 10), (903, [0.0] * 10)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)


def test_code_scores_are_those_of_the_decoded_vectors(spark, small):
    index = pq.build_pq(small, n_lists=5)
    asked = small.where("chunk_id < 8").selectExpr("chunk_id as query_id", "embedding")
    got = {(r.query_id, r.chunk_id): r.score for r in pq.code_topk(asked, index, 500, 5).collect()}
    codes = {r.chunk_id: (r.cell, np.frombuffer(r.code, np.uint8)) for r in index.codes(spark).collect()}
    assert len(codes) == 400 and len(got) == 8 * 400
    vectors = {r.chunk_id: np.array(r.embedding) for r in small.where("chunk_id < 8").collect()}
    for (q, c), score in got.items():
        cell, code = codes[c]
        decoded = index.centres[cell] + np.concatenate([index.codewords[j, w] for j, w in enumerate(code)])[:10]
        assert abs(score - vectors[q] @ decoded / np.linalg.norm(vectors[q])) < 1e-8


def test_all_rows_rescored_is_the_exact_result(small):
    index = pq.build_pq(small, n_lists=5)
    asked = small.where("chunk_id % 9 = 0 or chunk_id >= 900").selectExpr("chunk_id as query_id", "embedding")
    assert pairs(pq.pq_search(asked, index, 7, n_probe=5, n_rescored=500)) == pairs(rt.dense_topk(asked, small, 7))
    few = pairs(pq.pq_search(asked, index, 7, n_probe=5, n_rescored=500, broadcast_bytes=800))
    assert few == pairs(rt.dense_topk(asked, small, 7))


def test_only_probed_cells_are_read(small):
    index = pq.build_pq(small, n_lists=6)
    one = pq.code_topk(small.limit(1).selectExpr("chunk_id as query_id", "embedding"), index, 5, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0] and "embedding" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_codewords_of_few_points():
    points = np.repeat(np.arange(5.0), 4)[:, None] * np.ones((1, 4))
    words = pq.fit_codewords(points, 256)
    assert words.shape == (256, 4) and {float(w[0]) for w in words[pq._nearest(points, words)]} == {0.0, 1.0, 2.0, 3.0, 4.0}


def test_blocks_of_queries_and_rows_do_not_change_the_codes_found(spark, small, monkeypatch):
    """Rows that are decoded once and multiplied in blocks, for few probes too, give what one query at a time gives."""
    index = pq.build_pq(small, n_lists=6)
    asked = small.where("chunk_id < 30").selectExpr("chunk_id as query_id", "embedding")
    alone = {}
    for i in (0, 11, 29):
        alone |= pairs(pq.code_topk(asked.where(f"query_id = {i}"), index, 9, 2))
    monkeypatch.setattr(pq, "SCORE_QUERIES", 7)
    monkeypatch.setattr(pq, "SCORE_ROWS", 23)
    for options in ({}, {"broadcast_bytes": 800}):
        found = pairs(pq.code_topk(asked, index, 9, 2, **options))
        assert {p: s for p, s in found.items() if p[0] in (0, 11, 29)} == alone and len(found) == 30 * 9


def test_codewords_are_fitted_by_several_tasks(spark, small):
    """A small shuffle is put together to one task unless its parts are numbered; that task fitted all sub-vectors."""
    shown = []
    taken = type(small).toArrow
    type(small).toArrow = lambda self: (shown.append(self._jdf.queryExecution().toString()), taken(self))[1]
    try:
        pq.build_pq(small, n_lists=5)
    finally:
        type(small).toArrow = taken
    assert "REPARTITION_BY_NUM" in shown[0]
