"""Periodic runs against a brute-force search, by operator and by query."""

import hashlib
import random
import zlib

import numpy as np

from supportlake.llm import periodic, queries
from tests.llm.common import CLASHES, WORD, empty_table, odd_rows, odd_table, prose, table


def smallest_period(s):
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def brute_runs(w, least=12):
    """(start, length, period) of all runs, by start, then period."""
    out = []
    for d in range(1, len(w) // 2 + 1):
        i = 0
        while i + d < len(w):
            a = i
            while i + d < len(w) and w[i] == w[i + d]:
                i += 1
            if i + d - a >= max(least, 2 * d) and smallest_period(w[a : i + d]) == d:
                out.append((a, i + d - a, d))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def patterned(rng, n):
    docs = []
    for _ in range(n):
        d = prose(rng, rng.randint(0, 60), rng.choice([2, 3, 6, 50]))
        for _ in range(rng.randint(0, 3)):
            unit = prose(rng, rng.randint(1, 40), rng.choice([2, 4, 100]))
            d += (unit * rng.randint(1, 8))[: rng.randint(1, 200)] + prose(rng, rng.randint(0, 8), 30)
        docs.append(d)
    return docs


def test_runs_equal_brute_force(spark):
    docs = patterned(random.Random(11), 160)
    got = periodic.find_runs(table(spark, [" \n".join(d) for d in docs])).collect()
    assert len(got) == 160 and sum(len(r.runs) for r in got) > 100
    for r in got:
        want = brute_runs(docs[r.doc_id])
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(docs[r.doc_id])
        assert r.collapsed_text == brute_kept(docs[r.doc_id], want)


def test_long_distances_in_several_windows(monkeypatch):
    monkeypatch.setattr(periodic, "MAX_BLOCK", 4)
    rng = random.Random(12)
    for d in patterned(rng, 40) + [prose(rng, 90) * 4]:
        hashes = np.array([zlib.crc32(x.encode()) for x in d], dtype=np.uint64)
        found = periodic.find_in(hashes, np.zeros(len(d), dtype=np.int64), len(d), 12)
        assert sorted((a, z - a, q) for a, z, q in found) == sorted(brute_runs(d))


def test_transform_gives_exact_correlations():
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 1 << 7, 4096).astype(np.uint64)
    codes[700:800] = codes[100:200]
    codes = np.concatenate([codes, np.zeros(4096, dtype=np.uint64)])
    squares = np.concatenate([[0], np.cumsum((codes * codes).astype(np.int64))])
    at, distance = periodic.occurrences(codes, squares, np.arange(0, 2048, 64), 64, 127, 800)
    assert list(zip(at.tolist(), distance.tolist())) == [(128, 600)]


def test_one_word_many_times_and_long_period(spark):
    texts = ["z " * 50_000, " ".join(f"u{i % 7001}" for i in range(20_000)), " ".join(f"u{i}" for i in range(30_000))]
    got = {r.doc_id: r for r in periodic.find_runs(table(spark, texts)).collect()}
    assert [[tuple(x) for x in got[i].runs] for i in range(3)] == [[(0, 50_000, 1)], [(0, 20_000, 7001)], []]
    assert got[0].collapsed_text == "z" and len(got[1].collapsed_text.split()) == 7001


def test_odd_rows_and_empty_table(spark):
    assert periodic.find_runs(empty_table(spark)).count() == 0
    rows = periodic.find_runs(odd_table(spark)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        words = WORD.findall(r.text or "")
        want = brute_runs(words) if len(words) < 500 else []
        assert [tuple(x) for x in r.runs] == want and r.collapsed_text == brute_kept(words, want)
        assert all(r[c] == "old" for c in CLASHES if c != "n_words") and r.n_words == len(words)


def test_query_plants_and_digests(spark, tmp_path):
    rng = random.Random(13)
    texts = [" ".join(prose(rng, rng.randint(0, 80))) for _ in range(120)] + ["a b " * 20, None, ""]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op12_block_convolution"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in enumerate(texts):
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join("%d,%d,%d\n" % x for x in runs)) and r.collapsed_sha256 == digest(brute_kept(w, runs))
    assert planted > 5 and sum(r.n_runs > 0 for r in got.values()) > 5
