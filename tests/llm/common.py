"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or helpers.
CLASHES = (
    "n_words", "kept", "score", "class_id", "node", "row_key", "begins", "key", "chunk", "part", "mix_n", "mix_copy", "bpe_ids", "n_tokens",
    "tree_chars", "copy", "rank", "keep_key", "keep_id", "lang_pred", "has_letter_", "clean_text", "edit_list", "leader", "anchor",
)


def prose(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    long = " ".join(prose(rng, 30_000))
    same = "The same line. " * 12
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "word", "en", "b", 4),
        (5, long, "de", "a", len(long)), (6, same, "en", "a", len(same)), (7, same, "en", "b", len(same)), (8, "été naïve 日本語 😀.", "fr", "a", 3),
        (9, "twice row with a few more words in it.", "en", "a", 1), (9, "twice row with a few more words in it.", "en", "a", 1),
        (10, "repeated id, one text.", "en", "a", 1), (10, "repeated id, another text altogether.", "en", "b", 1),
        (None, "no id here but words.", None, None, None), (11, "tie tie tie tie tie tie", "en", "a", 2), (12, "x" * 5000, "en", "a", 5000),
        (13, "<|endoftext|> special | menu | home\nAll rights reserved.", "en", "a", 9),
    ]


def odd_table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("old"))
    return df


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, texts: list, start: int = 0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return out


__all__ = ["CLASHES", "WORD", "edited", "empty_table", "odd_rows", "odd_table", "prose", "table"]
