"""Line-first cleaning: rules per line, failed lines go, then documents that lost too much text go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from supportlake.llm.words import Words, grams, inside, mix, slices

BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: A line with words must end in one of the first, after any of the second.
ENDS, CLOSERS = ".!?…", "\")]”»’"
#: A line with two of these is navigation.
SEPARATORS = "|›»•·"
#: A line with one of these (in lower case) is boilerplate.
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "terms of use", "terms of service", "use of cookies",
    "enable javascript", "click here", "sign up", "log in", "subscribe to", "lorem ipsum", "share this", "read more",
)
_SEPARATOR = re.compile(f"[{SEPARATORS}]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SCHEMA = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("n_lost_words", T.LongType()), ("n_lost_lines", T.LongType()), ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()), ("clean_text", T.StringType()),
]


def line_fails(line: str, low: str) -> bool:
    """Whether a line that has a word breaks a rule of punctuation, navigation or boilerplate."""
    last = line.rstrip(BLANK).rstrip(CLOSERS)[-1:]
    if not last or last not in ENDS:
        return True
    if len(_SEPARATOR.findall(line)) >= 2:
        return True
    return any(p in low for p in PHRASES)


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """The text without failed lines; words and lines lost; lines with a word that equal an earlier one."""
    kept, lost_words, lost_lines, again, seen = [], 0, 0, 0, set()
    whole = text.lower()
    phrases = any(p in whole for p in PHRASES)
    separators = _SEPARATOR.search(text) is not None
    for line in text.split("\n"):
        bare = line.rstrip(BLANK)
        if not bare:
            kept.append(line)
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        if bare[-1] in ENDS and not separators and not phrases or not line_fails(line, line.lower()):
            kept.append(line)
        else:
            lost_words += len(_WORD.findall(line))
            lost_lines += 1
    return "\n".join(kept), lost_words, lost_lines, again


def repeated_words(words: Words, k: int) -> np.ndarray:
    """Words of each document in windows of k words that its text has twice or more."""
    first, n = words.first, len(words.begin)
    keep = np.flatnonzero(inside(first, k))
    out = np.zeros(len(words.counts), dtype=np.int64)
    if not len(keep):
        return out
    owner = words.owner()
    key = mix(grams(words.hashes, k)[keep] + mix(owner[keep].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(keep), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, keep[twice], 1)
    np.add.at(step, keep[twice] + k, -1)
    covered = np.cumsum(step[:n]) > 0
    return np.bincount(owner[covered], minlength=len(out)).astype(np.int64)


def apply_quality_rules(
    docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50, window: int = 5
) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept``, ``n_lost_words``, ``n_lost_lines`` and ``clean_text``.

    A document fails the base rules with fewer than ``min_words`` words, or with more than ``max_repeat_percent`` of its
    words in repeated windows. It is kept if it passes them and its failed lines have at most ``max_lost_percent`` of its
    words. A null or empty text has no words and fails. All rows and columns stay, repeated rows too; a result replaces a column
    of its name. A narrow operation over whole texts.
    """
    names = [name for name, _ in _SCHEMA]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in _SCHEMA]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, dtype=bool)
        symbol[[ord(c) for c in SYMBOLS]] = True
        blank = np.zeros(256, dtype=bool)
        blank[[ord(c) for c in BLANK]] = True
        for batch in batches:
            for a, z, words in slices(batch.column("text")):
                data, bounds = words.data, words.bounds
                total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])  # noqa: E731, B023
                chars = total(~blank[data] & ((data & 0xC0) != 0x80))
                n_words, repeat = words.counts.astype(np.int64), repeated_words(words, window)
                cleaned = [clean_lines(t or "") for t in batch.column("text").slice(a, z - a).to_pylist()]
                lost = np.array([c[1] for c in cleaned], dtype=np.int64)
                failed = (n_words < min_words) | (100 * repeat > max_repeat_percent * n_words)
                kept = ~failed & (100 * lost <= max_lost_percent * n_words)
                out = [
                    n_words, chars, total(symbol[data]), np.array([c[3] for c in cleaned], dtype=np.int64), repeat, lost,
                    np.array([c[2] for c in cleaned], dtype=np.int64), failed, kept, [c[0] for c in cleaned],
                ]
                rows = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, out)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
