"""Periodic runs in word sequences, by block convolution.

At the scale L (a power of two) a text is cut into blocks of L words. A run of period p in [2 L - 1, 4 L - 2] repeats its
first ``length - p >= 2 L - 1`` words p words later, so it holds a whole block that comes again at distance p. Each block
slides over the words at those distances behind it: the sums of squared differences of word codes, whose mixed terms are
one cyclic convolution (an exact number-theoretic transform), are zero exactly where all codes agree. Such a distance is
a seed; it is checked on word hashes and extended to both sides until a word breaks the period. Scales ascend, so that a
shorter period is known before its multiples.

Blocks are left out only where they cannot give a new seed: a word of theirs does not come again in reach, or all that they
see lies in a known run of a period of at most L. Everything is inside one document; nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from supportlake.llm.words import Words, mix, slices
from supportlake.llm.worker import per_worker

#: A prime with roots of unity of order 2**23; four times it is below 2**32, so sums may stay unreduced.
PRIME = 998244353
_ROOT, _ROOT_ORDER = 3, 1 << 23
_P, _P2 = np.uint64(PRIME), np.uint64(2 * PRIME)
_SHIFT = np.uint64(32)
#: Numbers in one transform; a longer block is a transform of its own.
TRANSFORM_CELLS = 1 << 17
#: Blocks are at most this long; longer distances are then seen in several windows.
MAX_BLOCK = _ROOT_ORDER // 4
SLICE_BYTES = 1 << 20
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _twiddles(half: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root of unity of order 2 * half, and each times 2**32 over the prime (for a product without division)."""
    root = pow(_ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    power = np.ones(half, dtype=np.uint64)
    filled = 1
    while filled < half:
        step = np.uint64(pow(root, filled, PRIME))
        more = min(filled, half - filled)
        power[filled : filled + more] = power[:more] * step % _P
        filled += more
    power = power[:, None]
    return power, (power << _SHIFT) // _P


def _times(x: np.ndarray, tw: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x times the twiddles, below twice the prime, for x below four times it."""
    return x * tw[0] - ((x * tw[1]) >> _SHIFT) * _P


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each column of x (in place, numbers below twice the prime); the order of the result is bit-reversed."""
    n, width = x.shape
    half = n // 2
    while half:
        pair = x.reshape(n // (2 * half), 2, half, width)
        a, b = pair[:, 0], pair[:, 1]
        lower = _times(a + (_P2 - b), per_worker(("twiddles", half, False), lambda: _twiddles(half, False)))  # noqa: B023
        total = a + b
        pair[:, 0] = np.minimum(total, total - _P2)  # the difference wraps around where there is nothing to take off
        pair[:, 1] = lower
        half //= 2
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``, reduced."""
    n, width = x.shape
    half = 1
    while half < n:
        pair = x.reshape(n // (2 * half), 2, half, width)
        a = pair[:, 0]
        b = _times(pair[:, 1], per_worker(("twiddles", half, True), lambda: _twiddles(half, True)))  # noqa: B023
        total, other = a + b, a + (_P2 - b)
        pair[:, 0], pair[:, 1] = np.minimum(total, total - _P2), np.minimum(other, other - _P2)
        half *= 2
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def occurrences(codes: np.ndarray, squares: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) wherever the codes of a block equal those ``distance`` (low to high) later.

    ``codes`` go on with zeros behind the last word, far enough; those of words are positive and the squares of a block sum
    up below the prime. ``squares``: running sums of squares.
    """
    n = 4 * size
    at, found = [], []
    reverse = -np.arange(size) % n
    for begin in range(0, len(starts), max(1, TRANSFORM_CELLS // n)):
        part = starts[begin : begin + max(1, TRANSFORM_CELLS // n)]
        blocks = np.zeros((n, len(part)), dtype=np.uint64)
        blocks[reverse] = codes[part + np.arange(size)[:, None]]
        transform(blocks)
        own = squares[part + size] - squares[part]
        for near in range(low, high + 1, n - size + 1):
            shifts = np.arange(min(n - size + 1, high + 1 - near))[:, None]
            window = np.zeros_like(blocks)
            reach = len(shifts) + size - 1
            window[:reach] = codes[part + near + np.arange(reach)[:, None]]
            product = transform_back(blocks * transform(window) % _P)[: len(shifts)].astype(np.int64)
            first = part + near + shifts
            differs = own + squares[first + size] - squares[first] - 2 * product
            shift, block = np.nonzero(differs == 0)
            at.append(part[block])
            found.append(near + shift)
    return (np.concatenate(at), np.concatenate(found)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _first_unlike(h: np.ndarray, i: int, d: int) -> int:
    """The first position from i on whose word differs from the one d later; where there is none later, it differs."""
    step = 32
    while (m := min(step, len(h) - d - i)) > 0:
        unlike = h[i : i + m] != h[i + d : i + d + m]
        k = int(unlike.argmax())
        if unlike[k]:
            return i + k
        i, step = i + m, min(4 * step, 1 << 16)
    return i


def _first_alike(h: np.ndarray, i: int, d: int) -> int:
    """The start of the stretch that ends before i, in which every word equals the one d later."""
    step = 32
    while (m := min(step, i)) > 0:
        unlike = h[i - m : i] != h[i - m + d : i + d]
        k = int(unlike[::-1].argmax())
        if unlike[m - 1 - k]:
            return i - k
        i, step = i - m, min(4 * step, 1 << 16)
    return i


class Runs:
    """Runs found so far in a sequence; those inside no other one form a line of rising starts and ends."""

    def __init__(self):
        self.found: list[tuple[int, int, int]] = []  # (start, end, period)
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.periods: list[int] = []

    def implied(self, at: np.ndarray, distance: np.ndarray, block: int) -> np.ndarray:
        """Which seeds lie in a known run whose period divides their distance: they extend to that run."""
        if not self.starts:
            return np.zeros(len(at), dtype=bool)
        k = np.searchsorted(self.starts, at, side="right") - 1
        inside = (k >= 0) & (np.array(self.ends)[k] >= at + distance + block)
        return inside & (distance % np.array(self.periods)[k] == 0)

    def covered(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def add(self, start: int, end: int, period: int) -> None:
        self.found.append((start, end, period))
        k = bisect.bisect_left(self.starts, start)
        last = bisect.bisect_right(self.ends, end, lo=k)
        self.starts[k:last], self.ends[k:last], self.periods[k:last] = [start], [end], [period]


def find_in(hashes: np.ndarray, owner: np.ndarray, longest: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in a row of documents; hashes of different documents never count as equal."""
    n = len(hashes)
    h = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    ahead = np.full(n, np.iinfo(np.int64).max)  # words up to the next equal word
    ahead[order[again]] = order[again + 1] - order[again]
    runs = Runs()
    size = 2
    while (low := 2 * size - 1 if size > 2 else 1) <= longest // 2:
        high, block = min(4 * size - 2, longest // 2), min(size, MAX_BLOCK)
        whole = n // block
        open_ = (ahead[: whole * block].reshape(whole, block) <= high).all(axis=1)
        if open_.any():
            for start, end, period in runs.found:
                if period <= block:
                    open_[-(-start // block) : max(0, (end - high - block) // block + 1)] = False
            starts = np.flatnonzero(open_) * block
        else:
            starts = np.empty(0, np.int64)
        if len(starts):
            bits = (PRIME.bit_length() - 1 - (block.bit_length() - 1)) // 2
            codes = np.zeros(n + high + 4 * block, dtype=np.uint64)
            codes[:n] = 1 + (h >> np.uint64(20)) % np.uint64((1 << bits) - 1)
            squares = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum((codes * codes).astype(np.int64), out=squares[1:])
            at, distance = occurrences(codes, squares, starts, block, low, high)
            _extend(h, at, distance, block, least, runs)
        size *= 2
    return runs.found


def _extend(h: np.ndarray, at: np.ndarray, distance: np.ndarray, block: int, least: int, runs: Runs) -> None:
    fresh = ~runs.implied(at, distance, block)
    at, distance = at[fresh], distance[fresh]
    order = np.lexsort((at, distance))
    known, reach = -1, -1
    for b, d in zip(at[order].tolist(), distance[order].tolist()):
        if d == known and b < reach:
            continue
        end = _first_unlike(h, b, d)
        known, reach = d, max(end, b + 1)
        if end < b + block:  # equal codes of unequal words
            continue
        start = _first_alike(h, b, d)
        if end + d - start >= max(least, 2 * d) and not runs.covered(start, end + d):
            runs.add(start, end + d, d)


def collapse(words: Words, drop: np.ndarray) -> pa.Array:
    """Texts of the words not dropped, joined by one blank."""
    kept = np.flatnonzero(~drop)
    owner = words.owner()[kept]
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    end = words.end[kept] + ~last  # behind each word but the last there is at least one blank
    data = words.data.copy()
    data[words.end[kept][~last]] = 32
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[words.begin[kept]] += 1
    np.subtract.at(step, end, 1)
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    sizes = np.bincount(owner, weights=end - words.begin[kept], minlength=len(words.counts)).astype(np.int64)
    bounds = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    buffers = [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes())]
    return pa.LargeStringArray.from_buffers(len(sizes), buffers[1], buffers[2])


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed_text``.

    A run is a stretch of words with smallest period q, of at least ``least`` and 2 q words, which no neighbouring word
    extends. Words are numbered from 0. ``collapsed_text`` has the words that lie in no run behind its first q words,
    joined by one blank. A null or wordless text has no runs and an empty collapsed text. Every row stays, rows that repeat an id each
    for itself, with all columns; a result replaces a column of its name. An empty table gives no rows. Equal words are
    told by 64-bit hashes. A worker holds one document's words and, at the largest scale, a few arrays as long.
    """
    docs = docs.drop("n_words", "runs", "collapsed_text")
    results = [("n_words", T.LongType()), ("runs", RUN_TYPE), ("collapsed_text", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in results]])
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, words in slices(batch.column("text"), SLICE_BYTES):
                longest = int(words.counts.max(initial=0))
                found = find_in(words.hashes, words.owner(), longest, least) if longest >= least else []
                table = np.array(found, dtype=np.int64).reshape(-1, 3)
                table = table[np.lexsort((table[:, 2], table[:, 0]))]
                drop = np.zeros(len(words.begin) + 1, dtype=np.int64)
                np.add.at(drop, table[:, 0] + table[:, 2], 1)
                np.subtract.at(drop, table[:, 1], 1)
                document = np.searchsorted(words.first, table[:, 0], side="right") - 1
                per = np.zeros(z - a + 1, dtype=np.int32)
                np.cumsum(np.bincount(document, minlength=z - a), out=per[1:])
                fields = [table[:, 0] - words.first[document], table[:, 1] - table[:, 0], table[:, 2]]
                runs = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(struct)))
                text = collapse(words, np.cumsum(drop[:-1]) > 0).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, z - a).columns, pa.array(words.counts.astype(np.int64)), runs, text], schema.names)

    return docs.mapInArrow(run, schema)
