"""Words of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow batch.

A word is a maximal run without the characters U+0020 and U+0009..U+000D, unchanged. A null text has no words. Hashes
depend on the word alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from supportlake.llm.worker import per_worker

#: Bytes of text that are hashed at once. A longer document is a slice of its own.
SLICE_BYTES = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _spaces() -> np.ndarray:
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return blank


def _power_table(base: int, n: int) -> np.ndarray:
    table = np.full(n, np.uint64(base))
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(19, (n - 1).bit_length())
    if size > 1 << 22:
        return _power_table(base, n)
    return per_worker(("powers", base, size), lambda: _power_table(base, size))[:n]


class Words:
    """The words of a few documents: byte ranges, hashes and, per document, the range of its words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """``data``: UTF-8 bytes of all texts in a row; ``bounds``: where each text begins, and the end."""
        self.data, self.bounds = data, bounds
        n = len(data)
        blank = per_worker("spaces", _spaces)[data]
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner], after[inner - 1] = True, True
        self.begin = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.begin, bounds)
        self.counts = np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """One hash per word: a polynomial of its bytes, shifted to start at power zero."""
        n = len(self.data)
        inverse = pow(int(_BASE), -1, 1 << 64)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(per_worker("codes", _codes)[self.data] * _powers(int(_BASE), n), out=total[1:])
        span = total[self.end] - total[self.begin]
        return mix(span * _powers(inverse, n + 1)[self.begin] + (self.end - self.begin).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The document (index) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words, by start, lie in one document; ``first`` has the word offset of each document and the end."""
    n = max(0, int(first[-1] - first[0]) - k + 1)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + first[0] + k <= ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(start row, end row, words) of parts of a column, each of about ``size`` bytes but whole documents."""
    data, bounds = text_bytes(column)
    start = 0
    while start < len(bounds) - 1:
        end = int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1
        end = min(max(end, start + 1), len(bounds) - 1)
        yield start, end, Words(data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
        start = end


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of rows with ``counts`` values each."""
    bounds = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values).cast(kind, safe=False))
