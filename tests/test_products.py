"""Block products of the lexical leg: every pair is scored, with all its words."""

import math
import pickle
import re

import numpy as np
import pyarrow as pa
import pytest

from supportlake.operators import products as pr
from supportlake.operators import retrieval as rt
from supportlake.operators import topk
from supportlake.plans.catalog import QUERIES


def entries(rng, n, n_words, share):
    table = (rng.random((n, n_words)) < share[:n_words]) * rng.random((n, n_words))
    owner, word = np.nonzero(table)
    return table, word.astype(np.int64), owner, table[owner, word]


@pytest.mark.parametrize("dense_share", [0.0, 0.05, 2.0])
def test_products_are_those_of_the_whole_matrices(dense_share):
    rng = np.random.default_rng(3)
    share = np.r_[np.full(5, 0.9), np.full(40, 0.1), np.full(200, 0.01)]
    a, wa, oa, va = entries(rng, 30, 245, share)
    b, wb, ob, vb = entries(rng, 50, 245, share)
    left, right = pr.by_word(wa, oa, va, 30), pr.by_word(wb, ob, vb, 50)
    assert np.allclose(pr.products(left, right, dense_share, portion=7), a @ b.T)
    nothing = pr.by_word(wb[:0], ob[:0], vb[:0], 50)
    assert not pr.products(left, nothing).any()
    # An entry that comes twice counts twice, in dense and in single additions.
    twice = pr.by_word(np.r_[wa, wa], np.r_[oa, oa], np.r_[va, va], 30)
    assert np.allclose(pr.products(twice, right, dense_share), 2 * a @ b.T)


def test_blocks_hold_every_text_with_entries_once():
    rng = np.random.default_rng(5)
    table, word, owner, value = entries(rng, 500, 90, np.r_[np.full(30, 0.3), np.full(60, 0.01)])
    table[7], keep = 0, owner != 7
    groups = pr.fit_groups(word[keep], owner[keep], 500)
    seen = []
    for _, texts, lists in pr.blocks_of(word[keep], owner[keep], value[keep], 500, groups, block=64):
        assert lists.n == len(texts) <= 64
        whole = np.zeros((len(texts), 90))
        np.add.at(whole, (lists.owners, np.repeat(lists.words, np.diff(lists.starts))), lists.values)
        assert np.array_equal(whole, table[texts])
        seen += texts.tolist()
    assert sorted(seen) == sorted(set(range(500)) - {7})


def test_long_queries_have_the_scores_of_the_formula_on_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    odds = 1.0 / np.arange(1, 401)
    text = lambda i: " ".join(f"{'ab'[i % 2]}{w}" for w in rng.choice(vocabulary, int(rng.integers(1, 120)), p=odds / odds.sum()))
    docs = [(i, text(i)) for i in range(300)] + [(300, ""), (301, None), (302, "...")]
    tokens = {i: re.findall(r"\w+", t or "") for i, t in docs}
    n, mean = len(docs), np.mean([len(tokens[i]) for i, t in docs if t is not None])
    df = {w: sum(w in t for t in tokens.values()) for w in set().union(*tokens.values())}
    corpus = spark.createDataFrame(docs, "chunk_id long, text string").repartition(5)
    asked = corpus.where("chunk_id % 3 = 0").selectExpr("chunk_id as query_id", "text")
    want = {}
    for q in range(0, 303, 3):
        scores = {}
        for c, held in tokens.items():
            for w in set(tokens[q]) & set(held):
                tf = held.count(w)
                scores[c] = scores.get(c, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held) / mean))
        want[q] = [round(s, 6) for s in sorted(scores.values(), reverse=True)[:9]]
    monkeypatch.setattr(topk, "SLICE_ROWS", 90)
    monkeypatch.setattr(pr, "STEP_ROWS", 64)
    for options in ({}, {"broadcast_bytes": 20_000}):
        got = {q: [] for q in want}
        for r in rt.bm25_topk(asked, rt.lexical_index(corpus), 9, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append(round(r.score, 6))
        assert all(np.allclose(got[q], want[q], atol=2e-6) for q in want)


def test_fused_query_cuts_texts_into_words_once(spark, sf):
    """Terms, sizes and scores read a stored index instead of running the pattern over all texts three times."""
    plan = QUERIES["ret_rrf_fuse"](spark, sf)._jdf.queryExecution().toString()
    assert "lexical-index" in plan and "regexp_extract_all" not in plan


def test_packed_queries_are_plain_values():
    """workers read a broadcast without this package, and hold four bytes an entry of it."""
    rows = pa.table({"query_id": [7, 3, 9], "terms": [["a", "b", "c"], ["b", "d"], []], "idfs": [[1.0, 2.0, 3.0], [2.0, 4.0], []]})
    packed = pr.pack_queries(rows)
    assert b"supportlake" not in pickle.dumps(packed)
    terms, seen = packed["terms"].to_pylist(), {}
    for _, queries, *entries in packed["blocks"]:
        assert all(x.dtype == np.int32 for x in entries[1:])
        lists = pr._lists(packed, *entries)
        for word, owner, value in zip(np.repeat(lists.words, np.diff(lists.starts)), lists.owners, lists.values):
            seen[int(packed["query_ids"][queries[owner]]), terms[word]] = float(value)
    assert seen == {(7, "a"): 1.0, (7, "b"): 2.0, (7, "c"): 3.0, (3, "b"): 2.0, (3, "d"): 4.0}


def test_query_sets_of_some_blocks_read_the_corpus_in_place(spark, monkeypatch):
    """a set above the limit is broadcast block by block; the texts of the corpus are moved for very large sets only, and tasks follow the cores."""
    docs = [(i, " ".join(f"w{j}" for j in range(i % 17, i % 17 + 3 + i % 29))) for i in range(200)]
    index = rt.lexical_index(spark.createDataFrame(docs, "chunk_id long, text string").repartition(60))
    asked = index.where("chunk_id % 4 = 0").selectExpr("chunk_id as query_id", "array_join(tokens, ' ') as text")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rt.bm25_topk(asked, index, 6)
    want, options = told(whole), {"broadcast_bytes": 4000}
    assert len(want) == 300
    some = rt.bm25_topk(asked, index, 6, **options)
    plan = some._jdf.queryExecution().toString()
    assert plan.count("Coalesce") > 1 and "CoGroups" not in plan and told(some) == want
    with monkeypatch.context() as few:
        few.setattr(pr, "TEXT_WORDS", 40)
        few.setattr(pr, "STEP_WORDS", 300)
        assert told(rt.bm25_topk(asked, index, 6)) == want
    monkeypatch.setattr(topk, "PASSES", 0)
    grid = rt.bm25_topk(asked, index, 6, **options)
    assert "CoGroups" in grid._jdf.queryExecution().toString() and told(grid) == want


def test_steps_are_bounded_by_rows_and_words():
    """rows that are read at once follow their words, so that long texts take no more memory than short ones."""
    sizes = np.array([3, 0, 4, 50, 1, 1, 1, 1, 0, 2])
    cuts = pr._steps(sizes, 3, 5)
    assert [x for low, high in cuts for x in range(low, high)] == list(range(10))
    assert all(high - low <= 3 and (sizes[low:high].sum() <= 2 * 5 or sizes[low:high].max() == 50) for low, high in cuts)
    assert pr._steps(sizes[:0], 3, 5) == []
