"""The n-gram similarity join against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.llm import queries, toccur
from supportlake.session import CLEANUP_SETTING, materialize
from tests.llm.common import WORD, edited, empty_table, odd_rows, odd_table, prose, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def elements(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(texts, percent=85):
    sets, root = [elements(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(i, len(sets[i]), top(i)) for i in range(len(texts))]


def cases(rng):
    texts = [" ".join(prose(rng, rng.randint(1, 90))) for _ in range(60)]
    base = prose(rng, 200)
    texts += [" ".join(edited(rng, base, rng.randint(1, 6))) for _ in range(50)]  # near copies, some alike only through others
    chain = prose(rng, 160)
    for _ in range(10):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    passage = prose(rng, 60)
    texts += [" ".join(passage + prose(rng, rng.randint(5, 60))) for _ in range(40)]  # a common passage
    for n in (4, 5, 7, 12, 26):  # sizes at the edge of the threshold
        short = prose(rng, n)
        texts += [" ".join(short), " ".join(short[:-1]), " ".join([*short, "more"]), " ".join(short[:1] * 3)]
    for _ in range(25):
        small = prose(rng, rng.randint(1, 40), 3)
        texts += [" ".join(small), " ".join(small + small[:2])]
    return texts + [texts[0]] * 5 + [texts[70].upper()] * 3 + ["ÀB c d e f", "àB c d e f", "Àb C d e f", None, "", "  "]


@pytest.mark.parametrize(("members", "times"), [(512, 20), (3, 20)])
def test_components_equal_brute_force(spark, monkeypatch, members, times):
    monkeypatch.setattr(toccur, "SLICE_MEMBERS", members)
    monkeypatch.setattr(toccur, "SLICE_QUERIES", 4 * members)
    monkeypatch.setattr(toccur, "TIMES", times)
    texts = cases(random.Random(members + times))
    got = sorted(tuple(r) for r in toccur.similarity_components(table(spark, texts)).collect())
    assert got == brute_components(texts)


def test_other_thresholds(spark):
    texts = cases(random.Random(2))[:140]
    got = sorted(tuple(r) for r in toccur.similarity_components(table(spark, texts), percent=60).collect())
    assert got == brute_components(texts, 60)


def test_search_equals_brute_force():
    rng = random.Random(4)
    for percent in (30, 85, 100):
        base = [rng.sample(range(400), rng.randint(1, 120)) for _ in range(6)]
        sets = []
        for _ in range(80):
            own = list(rng.choice(base))
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = rng.randrange(400)
            sets.append(np.unique(np.array(own, dtype=np.uint64)))
        index = toccur.Index(sets)
        for query in [*sets[:30], np.array([10**6], dtype=np.uint64)]:
            want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= percent * len(np.union1d(s, query))]
            assert index.search(query, percent).tolist() == want


def test_merge_skip_counts():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        times = rng.randint(1, len(lists))
        found, counts = toccur.merge_skip(lists, times)
        count = {x: sum(x in own for own in lists) for x in range(40)}
        assert list(zip(found.tolist(), counts.tolist())) == [(x, n) for x, n in count.items() if n >= times]


def test_hot_group_stays_linear(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 300)
    texts = [" ".join(edited(rng, base, 1)) for _ in range(150)]
    seen = []
    real = toccur.star_links
    monkeypatch.setattr(toccur, "star_links", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    got = {r.component_id for r in toccur.similarity_components(table(spark, texts)).collect()}
    assert got == {0} and sum(seen) < 150 * 20


def test_sets_with_a_common_passage_are_no_family(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 90)
    texts = [" ".join(passage + prose(rng, 45)) for _ in range(60)]  # sets share two thirds of their elements
    base = prose(rng, 150)
    texts += [" ".join(edited(rng, base, 4)) for _ in range(12)]
    seen = []
    real = toccur.family_links
    monkeypatch.setattr(toccur, "family_links", lambda rows, *a: seen.append({bytes(r.node) for r in rows.select("node").collect()}) or real(rows, *a))
    got = sorted(tuple(r) for r in toccur.similarity_components(table(spark, texts)).collect())
    assert got == brute_components(texts)
    assert not seen[0] & {hashlib.md5(t.encode()).digest() for t in texts[:60]}


def test_written_tables_leave_nothing_shuffled(spark):
    held = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(","))
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = held(), spark.conf.get(CLEANUP_SETTING)
    kept = materialize(counted, "cleaned")
    assert held() <= before and spark.conf.get(CLEANUP_SETTING) == setting
    assert sorted(kept.collect()) == sorted(counted.collect())


def test_odd_rows_and_empty_table(spark):
    assert toccur.similarity_components(empty_table(spark)).count() == 0
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in toccur.similarity_components(odd_table(spark)).collect())
    want = sorted((-1 if d is None else d, len(elements(t)), 6 if d == 7 else -1 if d is None else d) for d, t, *_ in odd_rows())
    assert got == want


def test_query(spark, tmp_path):
    texts = cases(random.Random(9))[::3]
    table(spark, texts, 5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_divide_skip_join"](spark, str(tmp_path)).collect())
    assert got == [(i + 5, n, c + 5) for i, n, c in brute_components(texts)]
