"""Scores, languages, repeated passages, line rules and the pipeline against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from supportlake.llm import backoff, langid, mixing, quality, rlz
from tests.llm.common import WORD, edited, empty_table, odd_rows, odd_table, prose, table


def score_all(docs, order=3, b=0.4):
    counts = [collections.Counter() for _ in range(order + 1)]
    grams = lambda d, n: [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
    for d in docs:
        for n in range(1, order + 1):
            counts[n].update(grams(d, n))
    every = sum(map(len, docs))
    out = []
    for d in docs:
        own = [collections.Counter(grams(d, n)) for n in range(order + 1)]
        c = lambda g: counts[len(g)][g] - own[len(g)][g]  # noqa: E731, B023
        rest = every - len(d)

        def s(g):
            if len(g) == 1:
                return c(g) / rest if c(g) > 0 else 1 / (rest + 1)  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) > 0 else b * s(g[1:])  # noqa: B023

        out.append(sum(math.log(s(tuple(d[max(0, i - order + 1) : i + 1]))) for i in range(len(d))))
    return out


def test_backoff_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(backoff, "PARTITION_GRAMS", 2000)
    rng = random.Random(8)
    docs = [prose(rng, rng.randint(0, 60), 40) for _ in range(120)]
    got = {r.doc_id: r for r in backoff.score_documents(table(spark, [" ".join(d) for d in docs]), order=3).collect()}
    want = score_all(docs)
    assert all(abs(got[i].log_score - want[i]) < 1e-9 and got[i].n_words == len(docs[i]) for i in range(120))


def test_backoff_scores_a_chunk_in_bounded_memory():
    """Gram counts of two lengths at a time and no list of all answers: under 120 bytes a word."""
    import tracemalloc

    n = 200_000
    hashes = np.random.default_rng(3).integers(1, 50_000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.full(n // 200, 200, dtype=np.int64)
    first = np.append(0, np.cumsum(counts))
    known = [np.unique(backoff.gram_keys(hashes, first, k)[1], return_counts=True)[1].astype(np.int64) for k in (1, 2, 3)]
    tracemalloc.start()
    try:
        logs, missed = backoff.score_words(hashes, counts, (k.copy() for k in known), 2 * n, 0.4, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(logs) == len(missed) == len(counts) and peak < 120 * n


def test_backoff_odd_rows(spark):
    got = backoff.score_documents(odd_table(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert backoff.score_documents(empty_table(spark)).count() == 0


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.identify_languages(docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got) and len(got) > 30
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in model.languages for r in got)


def test_language_codewords_differ():
    for n in (2, 3, 4, 7, 8, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and (abs(code.sum(axis=0)) < n).all()


def test_language_odd_rows(spark):
    docs = odd_table(spark)
    model = langid.train(docs)
    got = langid.identify_languages(docs, model).collect()
    assert len(got) == len(odd_rows())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    none = langid.train(empty_table(spark))
    assert none is None and {r.lang_pred for r in langid.identify_languages(docs, none).collect()} == {"und"}
    assert langid.identify_languages(empty_table(spark), model).count() == 0
    single = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify_languages(docs, single).collect()} == {"und", "en"}


def test_language_flags_mixed_text(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, " ".join(word("abcdefg" if i % 2 else "opqrstu") for _ in range(40)), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    both = " ".join(word("abcdefg") + " " + word("opqrstu") for _ in range(200))
    mixed = spark.createDataFrame([(1, both), (2, rows[0][1])], "doc_id long, text string")
    score = {r.doc_id: r.score for r in langid.identify_languages(mixed, model).collect()}
    assert score[1] < 0.9 < score[2]


def cut_brute(docs, window=20):
    seen, out = set(), []
    for d in docs:
        gone = [False] * len(d)
        for s in range(len(d) - window + 1):
            key = tuple(d[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append([w for w, g in zip(d, gone) if not g])
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(rng, 60) for _ in range(5)]
    docs = []
    for _ in range(140):
        d = prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 40)
            d += rng.choice(passages)[a : a + rng.randint(5, 60)] + prose(rng, rng.randint(0, 12))
        if rng.random() < 0.15:
            d += ["x", "y"] * rng.randint(1, 60) if rng.random() < 0.5 else ["z"] * rng.randint(1, 90)
        if docs and rng.random() < 0.25:
            d = list(rng.choice(docs)) or d
            d = edited(rng, d, rng.randint(0, 4)) if d else d
        docs.append(d)
    got = {r.doc_id: r for r in rlz.remove_repeats(table(spark, [" ".join(d) for d in docs])).collect()}
    for i, want in enumerate(cut_brute(docs)):
        assert got[i].clean_text.split() == want
        assert got[i].n_removed == len(docs[i]) - len(want)
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(want).encode()).hexdigest()


def test_repeats_odd_rows(spark):
    got = rlz.remove_repeats(odd_table(spark)).collect()
    assert len(got) == len(odd_rows())
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = cut_brute([WORD.findall(r[1] or "") for r in rows])
    assert sorted(r.kept_sha256 for r in got) == sorted(hashlib.sha256(" ".join(w).encode()).hexdigest() for w in want)
    assert next(r for r in got if r.doc_id == 7).clean_text == ""
    assert rlz.remove_repeats(empty_table(spark)).count() == 0


def test_clean_text_keeps_space_between_kept_words():
    import numpy as np

    assert rlz.cut_text("a  b\nc d e", np.array([False, False, False, True, False])) == "a  b\nc\ne"


def test_quality_counts_and_rules(spark):
    good = "One clean line of words that ends well.\nAnother fine line follows it here."
    menu = "Home | About | Contact | Login | Help | Jobs | News | Map | Blog | Shop."
    texts = [good, menu, good + "\nAll rights reserved.", " ".join(["a b c d e f"] * 9) + ".", "# * too few", good + "\n" + good]
    got = {r.doc_id: r for r in quality.apply_quality_rules(table(spark, texts)).collect()}
    assert [got[i].kept for i in range(6)] == [True, False, True, False, False, False]
    assert got[2].clean_text == good and got[2].n_lost_lines == 1 and got[2].n_lost_words == 3
    assert got[1].n_symbols == 9 and got[4].n_symbols == 2 and got[5].n_dup_lines == 2
    assert got[3].n_repeat_words >= 50 and got[3].base_failed and not got[1].base_failed


def test_quality_odd_rows(spark):
    got = quality.apply_quality_rules(odd_table(spark)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        words = WORD.findall(r.text or "")
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) for j in range(5) if windows[tuple(words[i : i + 5])] > 1}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert quality.apply_quality_rules(empty_table(spark)).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline
    from tests.llm.test_minhash import brute_classes

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    stage = dict(corpus_pipeline.STAGES)
    told = stage["language_id"](spark, docs, sf).collect()
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify_languages(docs, model).collect()
    assert {r.doc_id for r in told} == {r.doc_id for r in named if r.lang_pred != "und" and not r.ambiguous}
    told = sorted(told, key=lambda r: r.doc_id)
    one = stage["near_dedup"](spark, spark.createDataFrame(told, docs.schema), sf).collect()
    classes = brute_classes([r.text for r in told])
    assert {r.doc_id for r in one} == {told[c].doc_id for c in set(classes)} and len(one) == len(set(classes))
    one = sorted(one, key=lambda r: r.doc_id)
    cut = {r.doc_id: r for r in stage["substring_dedup"](spark, spark.createDataFrame(one, docs.schema), sf).collect()}
    for r, want in zip(one, cut_brute([WORD.findall(r.text) for r in one])):
        assert (cut[r.doc_id].text.split() == want) if want else r.doc_id not in cut
    left = spark.createDataFrame(list(cut.values()), docs.schema)
    mixed = stage["source_mix"](spark, left, sf).collect()
    assert {r.doc_id for r in mixed} <= set(cut) and len(mixed) == mixing.mix_sources(left).count()
    coded = stage["bpe"](spark, spark.createDataFrame(mixed, docs.schema), sf)
    assert coded.columns[:5] == docs.columns and coded.count() == len(mixed)


def test_pipeline_takes_an_empty_table(spark, sf, tmp_path):
    import corpus_pipeline

    empty_table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_run_equals_poisson_inversion_and_the_library(spark, sf, tmp_path):
    import corpus_pipeline
    from supportlake.llm.queries import tokenizer_path
    from tests.llm.test_mixing import copies
    from tokenizers import Tokenizer

    spark.read.parquet(f"{sf}/documents.parquet").limit(80).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    left = docs.collect()
    chars = collections.Counter()
    for r in left:
        chars[r.source] += len(r.text)
    share = sum(chars.values()) / len(chars)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in left:
        ids = tuple(library.encode(r.text, add_special_tokens=False).ids)
        want[(r.doc_id, r.text, ids)] += copies(share / chars[r.source], r.doc_id)
    got = collections.Counter((r.doc_id, r.text, tuple(r.bpe_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and sum(got.values()) > 10
