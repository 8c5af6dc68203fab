"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; a binary classifier per bit tells languages with a 1 from those with a 0 by the mean
log-ratio of a text's hashed byte bigrams and trigrams. Decoding weighs the loss of each bit by how well that bit's
classifier separates the language, takes the nearest codeword, and flags texts whose two nearest are about as near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.llm.words import slices

#: Hash buckets of n-grams; with the number of languages they bound the model.
BUCKETS = 1 << 14
#: More distinct labels than this are an error: the model is held by every task.
MAX_LANGUAGES = 512
#: Steepness of the logistic loss in the mean log-ratio of a text.
STEEPNESS = 8.0
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes for n-grams: lower-case letters and bytes beyond ASCII; anything else is a blank."""
    table = np.full(256, 32, dtype=np.uint32)
    table[128:] = np.arange(128, 256)
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return table


def buckets(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Buckets of the bigram (first half) and trigram (second half) from each byte; BUCKETS where it leaves the document."""
    n = len(data)
    code = _letters()[data]
    two, three = np.full(n, BUCKETS, dtype=np.int64), np.full(n, BUCKETS, dtype=np.int64)
    half = (BUCKETS // 2).bit_length() - 1
    if n > 1:
        pair = code[:-1] << np.uint32(8) | code[1:]
        two[:-1] = pair * np.uint32(0x9E3779B1) >> np.uint32(32 - half)
    if n > 2:
        triple = pair[:-1] << np.uint32(8) | code[2:]
        three[:-2] = (triple * np.uint32(0x85EBCA77) >> np.uint32(32 - half)) + BUCKETS // 2
    ends = bounds[1:][np.diff(bounds) > 0]
    two[ends - 1] = BUCKETS
    three[ends - 1] = BUCKETS
    three[np.maximum(ends - 2, 0)] = BUCKETS
    return np.stack([two, three])


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language: all splits in two for up to 7 languages, else fixed random ones, rows far apart."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = (np.arange(1, 1 << (n - 1))[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits == 1, 1.0, -1.0)
    width, rng, best, apart = int(np.ceil(15 * np.log2(n))), np.random.default_rng(n), None, -1
    for _ in range(50):
        code = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        gaps = (width - code @ code.T) / 2 + width * np.eye(n)
        if gaps.min() > apart:
            best, apart = code, gaps.min()
    return best


class LanguageModel:
    """Classifiers of all bits, from n-gram counts per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        weights = []
        for bit in self.code.T:
            weights.append(np.log(share[bit > 0].mean(axis=0) / share[bit < 0].mean(axis=0)))
        stacked = np.array(weights).reshape(self.code.shape[1], counts.shape[1]).T
        self.weights = np.vstack([stacked, np.zeros((1, stacked.shape[1]))]).astype(np.float32)
        # How far the classifier of a bit sends a language to its own side, per language.
        pull = np.maximum(share @ stacked * self.code, 1e-6)
        self.trust = pull / pull.sum(axis=1, keepdims=True) if self.code.shape[1] else pull

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean log-ratio of each document's n-grams for each bit; 0 for a document without any."""
        sizes = np.diff(bounds)
        out = np.zeros((len(sizes), self.weights.shape[1]))
        some = sizes > 0
        if some.any() and self.weights.shape[1]:
            found = buckets(data, bounds)
            each = self.weights[found[0]]
            each += self.weights[found[1]]
            sums = np.add.reduceat(each, bounds[:-1][some], axis=0, dtype=np.float64)
            out[some] = sums / np.maximum(2 * sizes[some] - 3, 1)[:, None]
        return out

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each document's nearest codeword, and a score: 1 - nearest / second nearest loss."""
        margins = self.margins(data, bounds)
        n = len(margins)
        if len(self.languages) == 1:
            return np.zeros(n, dtype=int), np.ones(n)
        # Weighted by trust over all bits, as one matrix product for each sign of the bit.
        positive, negative = self.trust * (self.code > 0), self.trust * (self.code < 0)
        loss = np.logaddexp(0, -STEEPNESS * margins) @ positive.T + np.logaddexp(0, STEEPNESS * margins) @ negative.T
        order = np.argsort(loss, axis=1, kind="stable")[:, :2]
        near = np.take_along_axis(loss, order, axis=1)
        return order[:, 0], 1 - near[:, 0] / np.maximum(near[:, 1], 1e-12)


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModel | None:
    """A model from all rows with a text and a label; None if there are none.

    Each task counts n-grams per language; the counts are added up by key. The result is bounded by languages times buckets.
    """
    rows = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            index, labels = names.indices.to_numpy(), names.dictionary.to_pylist()
            sums: dict[int, np.ndarray] = {}
            for a, z, words in slices(batch.column("text")):
                owner = np.repeat(index[a:z], np.diff(words.bounds))
                found = buckets(words.data, words.bounds)
                for key in np.unique(index[a:z]):
                    got = np.bincount(found[:, owner == key].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                    sums[key] = sums.get(key, 0) + got
            for key, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([labels[key]] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"]
                )

    table = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if table.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = table.toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").combine_chunks().dictionary_encode()
    order = np.argsort(names.dictionary.to_pylist())
    rank = np.empty(len(order), dtype=int)
    rank[order] = np.arange(len(order))
    counts = np.zeros((len(order), BUCKETS))
    counts[rank[names.indices.to_numpy()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel([names.dictionary[int(i)].as_py() for i in order], counts)


def held_out(key: Column) -> Column:
    """Rows of no part in training: crc32 of the id as text, modulo 4, is 2. A null id has crc32 of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.05) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` (score below ``min_score``).

    The prediction reads the text alone. A null text, one without a letter and any text without a model is ``und`` with
    score 0. All rows and columns stay; a result replaces a column of its name (and ``has_letter_`` goes).
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())]
    docs = docs.drop(*[name for name, _ in added], "has_letter_")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in added]])
    names = docs.columns
    given = docs.withColumn("has_letter_", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
        for batch in batches:
            letters = batch.column("has_letter_").to_numpy(zero_copy_only=False)
            rows = batch.select(names)
            for a, z, words in slices(batch.column("text")):
                if model:
                    best, score = model.predict(words.data, words.bounds)
                else:
                    best, score = np.zeros(z - a, dtype=int), np.zeros(z - a)
                known = letters[a:z] & bool(model)
                score = np.where(known, np.clip(score, 0.0, 1.0), 0.0)
                out = [pa.array(labels[np.where(known, best, -1)], pa.string()), pa.array(score), pa.array(score < min_score)]
                part = rows.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*rows.schema.names, *[name for name, _ in added]])

    return given.mapInArrow(run, schema)
