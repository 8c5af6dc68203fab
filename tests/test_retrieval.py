"""Retrieval: both top-k paths, filters, fusion, rerank and gates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import retrieval as rt
from supportlake.operators import topk
from supportlake.plans import retrieval_queries as rq
from supportlake.session import materialize
from supportlake.plans.catalog import QUERIES


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def vectors(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = emb.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries, emb.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("chunk_id"), "embedding")


def test_dense_top_k_equals_brute_force_on_both_paths(spark, sf, monkeypatch):
    queries, corpus = vectors(spark, sf)
    q = {r["query_id"]: np.array(r["embedding"], dtype=float) for r in queries.collect()}
    c = {r["chunk_id"]: np.array(r["embedding"], dtype=float) for r in corpus.collect()}
    want = []
    for qid, a in q.items():
        scored = sorted(((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), cid) for cid, b in c.items()))[:7]
        want += [(qid, rank, cid) for rank, (_, cid) in enumerate(scored, 1)]
    assert rows(rt.dense_topk(queries, corpus, 7), "query_id", "rank", "chunk_id") == sorted(want)
    monkeypatch.setattr(topk, "SLICE_ROWS", 100)
    grid = rt.dense_topk(queries, corpus, 7, broadcast_bytes=4000)
    assert rows(grid, "query_id", "rank", "chunk_id") == sorted(want)


def test_equal_vectors_tie_by_id_even_when_most_rows_are_copies(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)] + [(1000, [0.9, 0.1])], "chunk_id long, embedding array<float>").repartition(7)
    query = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["chunk_id"] for r in rt.dense_topk(query, corpus, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_empty_null_and_wrong_width_vectors(spark):
    kinds = "id long, embedding array<float>"
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0]), (5, []), (6, [None, 1.0])], kinds)
    asked, corpus = some.withColumnRenamed("id", "query_id"), some.withColumnRenamed("id", "chunk_id")
    assert rt.dense_topk(asked.limit(0), corpus, 3).count() == 0
    assert rt.dense_topk(asked, corpus.limit(0), 3).count() == 0
    found = rows(rt.dense_topk(asked, corpus, 3), "query_id", "rank", "chunk_id")
    assert found == [(1, 1, 1), (1, 2, 4), (3, 1, 3), (4, 1, 4), (4, 2, 1)]  # only vectors of one width are compared
    assert rows(rt.dense_topk(asked, corpus, 3, broadcast_bytes=20), "query_id", "rank", "chunk_id") == found


def test_selection_is_vectorised():
    import time

    best, rng = topk._Best(50, 20_000), np.random.default_rng(0)
    matrix = np.round(rng.standard_normal((20_000, 1000)).astype(np.float32).astype(float), 3)
    began = time.process_time()
    best.add(np.arange(1000), matrix)
    first = time.process_time() - began
    best.add(np.arange(1000, 2000), matrix - 10)  # beats nothing
    for q in (0, 7, 19_999):
        assert best.ids[q].tolist() == np.lexsort((np.arange(1000), -matrix[q]))[:50].tolist()
    assert first < 20


def test_bm25_grid_equals_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = rt.lexical_index(docs)
    narrow = rows(rt.bm25_topk(asked, index, 5), "query_id", "rank", "chunk_id", "score")
    monkeypatch.setattr(topk, "SLICE_ROWS", 60)
    assert rows(rt.bm25_topk(asked, index, 5, broadcast_bytes=20_000), "query_id", "rank", "chunk_id", "score") == narrow


def test_bm25_finds_cjk_terms(spark):
    docs = spark.createDataFrame([(1, "退款政策说明"), (2, "配送时效"), (3, "Refund POLICY")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "退款"), (2, "policy"), (3, "nothing here")], "query_id long, text string")
    assert rows(rt.bm25_topk(asked, rt.lexical_index(docs), 5), "query_id", "chunk_id") == [(1, 1), (2, 3)]


def test_approximate_search_recall_and_scores(spark, sf):
    queries, corpus = vectors(spark, sf)
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in rt.dense_topk(queries, corpus, 10).collect()}
    near = {(r["query_id"], r["chunk_id"]): r["score"] for r in QUERIES["ret_dense_topk_cells"](spark, sf).collect()}
    common = exact.keys() & near.keys()
    assert len(common) / len(exact) > 6 / 16  # better than the share of cells it reads
    assert all(math.isclose(exact[k], near[k], abs_tol=1e-8) for k in common)
    cells, centres = rt.vector_cells(corpus, 5)
    one = rt.search_cells(queries.limit(1), cells, centres, 10, 1)
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in filters  # cells that no query probes are not read
    whole = rt.dense_topk_ann(queries, corpus, 10, n_lists=5, n_probe=5)
    assert {(r["query_id"], r["chunk_id"]) for r in whole.collect()} == exact.keys()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_approximate_search_finds_nine_of_ten_neighbours(spark, folder):
    sf = f"/root/testdata/{folder}"
    exact = set(rows(rt.dense_topk(rq.query_vectors(spark, sf), rq.corpus_vectors(spark, sf), 10), "query_id", "chunk_id"))
    near = set(rows(QUERIES["ret_dense_topk_cells"](spark, sf), "query_id", "chunk_id"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_probes_are_chosen_by_measured_recall(spark, sf):
    queries, corpus = vectors(spark, sf)
    exact = set(rows(rt.dense_topk(queries, corpus, 10), "query_id", "chunk_id"))
    cells, centres = rt.vector_cells(corpus, 12)
    share = lambda n: len(exact & set(rows(rt.search_cells(queries, cells, centres, 10, n), "query_id", "chunk_id"))) / len(exact)
    for recall in (0.5, 0.9):
        n = rt.probes_for_recall(queries, cells, centres, 10, recall)
        assert share(n) >= recall > share(n - 1)
    assert rt.probes_for_recall(queries, cells, centres, 10, 0.9, sample=20) >= rt.probes_for_recall(queries, cells, centres, 10, 0.5)
    assert rt.cell_count(1) == 1 and rt.cell_count(450) == 21 and rt.cell_count(10**9) == rt.MAX_CELLS


def test_prefilter_rules(spark):
    frame = spark.createDataFrame([(1, "a", True), (2, "a / b", True), (3, "ab", True), (4, "a", False)], "chunk_id long, category string, is_active boolean")
    assert rows(rt.prefilter(frame, category="a"), "chunk_id") == [(1,)]
    assert rows(rt.prefilter(frame, prefixes=("a",)), "chunk_id") == [(1,), (2,), (3,)]
    assert rt.prefilter(frame, ids=frame.filter("false")).count() == 0
    typed = frame.withColumn("content_type", F.lit("policy"))
    assert rows(rt.typed_scope(typed, ("policy",), ("a",)), "chunk_id") == [(1,), (2,)]
    for bad in (" ", "x" * 513):
        with pytest.raises(ValueError):
            rt.prefilter(frame, category=bad)


def test_policy_hits_of_one_query_are_numbered_in_blocks(spark):
    scopes = rt.policy_scope(spark.createDataFrame([(1, "退款退货"), (2, "物流")], "query_id long, intent string"))
    hits = spark.range(200_000).select(
        (F.col("id") % 2 + 1).alias("query_id"), F.col("id").alias("n"), F.lit("退换货与退款").alias("category"),
        F.when(F.col("id") % 3 == 0, "product_faq").otherwise("policy").alias("content_type"), F.col("id").alias("chunk_id"),
    )
    got = rt.policy_hits(hits, scopes)
    assert "__block" in got._jdf.queryExecution().optimizedPlan().toString()  # no task gets all hits of a query
    kept = [i for i in range(0, 200_000, 2) if i % 3]
    assert rows(got, "query_id", "n", "chunk_id") == [(1, place, i) for place, i in enumerate(kept, 1)]


def test_policy_hits_ask_all_items(spark):
    sf = "/root/testdata/sf0.1"
    asked = {r[0] for r in QUERIES["ret_policy_hits_all_items"](spark, sf).select("query_id").distinct().collect()}
    items = {r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    want = set()
    for d, source in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect():
        item = d % len(items)
        if int("".join(filter(str.isdigit, source))) % 3 and d % 4 < {0: 2, 1: 3, 2: 0}[item % 3]:
            want.add(item)
    assert len(items) == 200 and asked == want and max(asked) >= 160


def test_fusion_limits(spark):
    leg = spark.createDataFrame([(1, i, i) for i in range(1, 61)], "query_id long, chunk_id long, rank long")
    fused = rt.rrf_fuse([leg, leg.filter("chunk_id > 40")], 50)
    assert fused.count() == 50 and fused.agg(F.max("chunk_id")).first()[0] <= 50
    best = fused.filter("rank = 1").first()
    assert best["chunk_id"] == 41 or best["score"] >= 2 / (60 + 50)
    with pytest.raises(ValueError):
        rt.rrf_fuse([leg], 101)


def test_rerank_rejects_bad_score_tables(spark):
    cand = spark.createDataFrame([(q, n, q * 10 + n, 0.0) for q in range(1, 6) for n in (1, 2)], "query_id long, n long, chunk_id long, score double")
    scores = spark.createDataFrame(
        [(1, 0, 0.2), (1, 1, 0.9), (2, 0, 0.5), (2, 0, 0.6), (3, 0, 0.5), (4, 0, float("nan")), (4, 1, 0.1)], "query_id long, index long, relevance double"
    )
    out = rt.rerank(cand, scores).collect()
    assert sorted((r["n"], r["chunk_id"]) for r in out if r["query_id"] == 1) == [(1, 12), (2, 11)]
    errors = {r["query_id"]: r["error"] for r in out if r["error"]}
    assert errors == {2: "invalid_rerank_result", 3: "incomplete_rerank_result", 4: "invalid_rerank_result", 5: "incomplete_rerank_result"}


def test_multi_query_merge_keeps_later_better_duplicate_in_its_place(spark):
    data = [
        (1, 1, 7, None, 0.5), (1, 2, 8, None, 0.9), (1, 3, 7, None, 0.9), (1, 4, None, "s", 0.9), (1, 5, None, "s", 0.9), (1, 6, None, None, float("nan")), (1, 7, None, "", 0.1),
    ]
    frame = spark.createDataFrame(data, "question_id long, arrival long, chunk_id long, source_key string, score double")
    assert [r["arrival"] for r in rt.merge_multi_query(frame).orderBy("n").collect()] == [2, 3, 4, 7, 6]


def test_gate_reasons(spark):
    evidence = spark.createDataFrame([(1, "a", 0.4), (1, " ", 0.9), (2, "a", float("inf"))], "query_id long, answer string, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    out = {r["query_id"]: r for r in rt.evidence_gate(evidence, asked, 0.4, "dense").collect()}
    assert out[1]["gate_passed"] and not out[2]["gate_passed"] and out[3]["gate_score"] is None
    assert out[3]["reason"] == "strategy=dense; score=None; threshold=0.4"


def test_evidence_fit_skips_and_goes_on(spark, sf):
    out = QUERIES["ret_fit_evidence"](spark, sf).collect()
    docs = {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        used, kept = 0, 0
        for line in docs[r["doc_id"]][:5]:
            price = -(-len(line) // 4) + 6
            if used + price <= 150:
                used, kept = used + price, kept + 1
        assert r["n_kept"] == kept


def test_expansions_are_strict(spark):
    values = ['{"queries":[" a ","A","b  c","B C","d","e","f"]}', '{"queries":["a",1]}', '{"queries":[]}', '["a"]', '{"queries":["a"]} x', '{"queries":null}', None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["o"] for r in frame.select("i", rt.parse_expansions("v", F.lit("fb")).alias("o")).orderBy("i").collect()]
    assert got == [["fb", "a", "b  c", "d"], ["fb"], ["fb"], ["fb"], ["fb"], ["fb"], ["fb"]]


def test_faq_question_falls_back(spark):
    data = [(1, ["", " q "], ["h"], "c"), (2, [" "], ["x", " h "], "c"), (3, [], [], "c"), (4, None, [" "], "c")]
    frame = spark.createDataFrame(data, "i int, q array<string>, p array<string>, c string")
    got = [r["o"] for r in frame.select("i", rt.shown_question(F.col("q"), F.col("p"), F.col("c")).alias("o")).orderBy("i").collect()]
    assert got == ["q", "h", "c", "c"]


def test_adapted_evidence_has_one_schema(spark, sf):
    out = QUERIES["ret_adapt_evidence"](spark, sf)
    assert out.columns == [*rt.EVIDENCE.names, "shape"]
    bad = out.filter("(shape = 'plain' AND (content_type = 'product_faq' OR NOT startswith(category, 'en'))) OR (shape = 'faq' AND source_key <> 'legacy-faq')")
    assert bad.count() == 0 and out.filter("shape = 'traced'").count() > 0


def test_strategies_agree_with_their_legs(spark, sf):
    stored, queries = rq._stored(spark, sf), rq._text_queries(spark, sf)
    sync = rq._sync(stored)
    out = QUERIES["ret_retrieve_strategies"](spark, sf)
    assert {r["strategy"] for r in out.select("strategy").distinct().collect()} == set(rt.STRATEGIES)
    dense = rt.dense_topk(queries, stored.select(F.col("id").alias("chunk_id"), "embedding"), 50)
    kept = dense.filter(F.col("chunk_id") % 7 != 3).join(sync.select("chunk_id"), "chunk_id", "left_semi")
    want = rows(topk.rank_hits(kept.drop("rank"), 10), "query_id", "chunk_id")
    assert rows(out.filter("strategy = 'dense'"), "query_id", "chunk_id") == want
    with pytest.raises(ValueError):
        rt.retrieve(queries, stored, sync, "magic")


def test_source_url_in_evidence(spark):
    frame = spark.createDataFrame([("doc:x.md:1", ["a"])], "k string, p array<string>")
    assert frame.select(tx.source_url("k", "p")).first()[0].startswith("/api/v1/knowledge/source?source=x.md#section-")


def test_candidates_and_stored_chunks_hold_texts_once(spark, sf, monkeypatch):
    """ranked hits are written without answers, and a text is stored once however many columns show it."""
    stored, queries = rq._stored(spark, sf), rq._text_queries(spark, sf)
    assert stored.where("not (embedding_text <=> answer)").count() == 0
    assert not any(path.endswith(".parquet") and "embedding_text" in spark.read.parquet(path).columns for path in stored.inputFiles())
    written = []
    monkeypatch.setattr(rt, "materialize", lambda df, name: written.append((name, df.columns)) or materialize(df, name))
    legs = rt.search_legs(queries, stored)
    written.clear()
    candidates, final = rt.retrieve(queries, stored, rq._sync(stored), "hybrid", legs=legs)
    assert "answer" in candidates.columns and written and not any("answer" in columns for _, columns in written)
    best = candidates.where("n = 1").join(stored.select(F.col("id").alias("chunk_id"), F.col("answer").alias("own")), "chunk_id")
    assert best.count() > 0 and best.where("not (answer <=> own)").count() == 0
    scans = final.select("query_id", "chunk_id", "n", "score")._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1:]
    assert scans and not any("answer" in scan.split("\n")[0] for scan in scans)


def test_dense_search_by_small_blocks_has_the_scores_of_all_pairs(spark, monkeypatch):
    """rows and queries meet block by block, with widths, ties and missing vectors as before."""
    rng = np.random.default_rng(23)
    vectors = {i: rng.integers(-2, 3, 2 + i % 2).astype(float).tolist() for i in range(150)} | {150: None, 151: [], 152: [1.0, None]}
    corpus = spark.createDataFrame(list(vectors.items()), "chunk_id long, embedding array<float>").repartition(3)
    asked = corpus.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    norm = lambda v: np.linalg.norm(v) or 1.0
    want = set()
    for q in range(0, 150, 5):
        usable = [c for c in range(150) if len(vectors[c]) == len(vectors[q])]
        scores = {c: round(float(np.dot(vectors[q], vectors[c]) / norm(vectors[q]) / norm(vectors[c])), 9) for c in usable}
        want |= {(q, c, n) for n, c in enumerate(sorted(usable, key=lambda c: (-scores[c], c))[:6], 1)}
    monkeypatch.setattr(rt, "DENSE_ROWS", 16)
    monkeypatch.setattr(rt, "DENSE_QUERIES", 4)
    assert rows(rt.dense_topk(asked, corpus, 6), "query_id", "chunk_id", "rank") == sorted(want)
