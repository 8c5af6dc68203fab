import random

import numpy as np
import pyarrow as pa

from supportlake.llm import minhash
from supportlake.llm.components import connected_components
from supportlake.llm.words import slices
from tests.llm.common import WORD, edited, empty_table, odd_rows, odd_table, prose, table


def weights(text, k=5):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    return {g: grams.count(g) / len(grams) for g in set(grams)}


def jaccard(x, y):
    both, every = set(x) & set(y), set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in both)


def brute_classes(texts, threshold=0.8):
    sets, root = [weights(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and set(sets[i]) & set(sets[j]) and jaccard(sets[i], sets[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, rng.randint(1, 90))) for _ in range(60)]
    base = prose(rng, 200)
    texts += [" ".join(edited(rng, base, rng.randint(1, 4))) for _ in range(40)]  # near copies, some alike only through others
    chain = prose(rng, 120)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    passage = prose(rng, 60)
    texts += [" ".join(passage + prose(rng, 60)) for _ in range(30)]  # a common passage is no copy
    texts += [texts[0]] * 5 + [texts[70]] * 3 + [None, "", "  "]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_signature_estimates_probability_jaccard():
    rng = random.Random(5)
    base = prose(rng, 300)
    x, y = base + base[:40] * 3, edited(rng, base, 6)
    for _, _, words in slices(pa.array([" ".join(x), " ".join(y)])):
        owner, values, counts = minhash.shingles(words, 5)
        registers = minhash.signatures(owner, values, counts.astype(float), 2, 4096)
    one = owner == 0
    exact = minhash.probability_jaccard(values[one], counts[one].astype(float), values[~one], counts[~one].astype(float))
    assert abs(exact - jaccard(weights(" ".join(x)), weights(" ".join(y)))) < 1e-9
    assert abs((registers[0] == registers[1]).mean() - exact) < 0.04


def test_odd_rows_and_empty_table(spark):
    assert minhash.near_duplicates(empty_table(spark)).count() == 0
    assert minhash.keep_one(empty_table(spark), minhash.near_duplicates(empty_table(spark))).count() == 0
    docs = odd_table(spark)
    classes = minhash.near_duplicates(docs)
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in classes.collect())
    want = [(i, i) for i in (-1, 1, 2, 3, 4, 5, 6, 8, 9, 9, 10, 10, 11, 12, 13)] + [(7, 6)]
    assert got == sorted(want)
    kept = minhash.keep_one(docs, classes)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 10, 10, 11, 12, 13]
    assert len(odd_rows()) == 16


def test_components_of_long_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_hot_bucket_makes_a_star_not_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 300)
    texts = [" ".join(edited(rng, base, 1)) for _ in range(150)]
    seen = []
    real = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    classes = {r.class_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert classes == {0} and sum(seen) < 150 * 28 / 2
    assert np.isfinite(seen[0])
