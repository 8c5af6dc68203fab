"""Language-model scores by stupid backoff over all documents.

Documents are dealt to chunks by hash of their id. Each chunk gives its distinct n-grams with their counts, packed per
hash partition (the leading bits of an n-gram's hash). A partition adds the counts of all chunks, which is the count
table, and answers each chunk's n-grams from it. A chunk then scores its documents from the answers. So a count
goes through the shuffle once per chunk that has the n-gram, not once per occurrence, and as packed bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.words import grams, inside, mix, slices
from supportlake.session import materialize

#: Characters of a chunk and n-grams of a hash partition, about; their numbers follow from the table's size.
CHUNK_CHARS = 1 << 24
PARTITION_GRAMS = 1 << 21


def chunk_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk in a row, and the number of words of each document."""
    hashes, counts = [], []
    for _, _, words in slices(texts):
        hashes.append(words.hashes)
        counts.append(words.counts)
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(counts).astype(np.int64)


def gram_keys(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of the n-grams of one length that lie in one document."""
    at = np.flatnonzero(inside(first, length))
    return at, mix(grams(hashes, length)[at] + np.uint64(length))


def pack(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending hashes as differences in planes of bytes (the leading planes are nearly all zero), and counts likewise."""
    gaps = np.diff(hashes, prepend=hashes[:1] * np.uint64(0))
    return planes(gaps), planes(counts.astype(np.uint64))


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as the planes of their bytes, least first, without planes that are all zero."""
    wide = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not wide[used - 1].any():
        used -= 1
    return bytes([used]) + wide[:used].tobytes()


def unplanes(data: bytes) -> np.ndarray:
    used = data[0]
    n = (len(data) - 1) // used
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :used] = np.frombuffer(data, np.uint8, offset=1).reshape(used, n).T
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def score_documents(docs: DataFrame, order: int = 2, backoff: float = 0.4, leave_out: bool = True) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score, n_backoff`` for every row.

    The score of a word after its up to ``order - 1`` words before is count(gram) / count(context), or ``backoff`` times
    the score after a context shorter by one where the gram's count is 0; for a word alone it is count / number of words. Counts are over all rows; with
    ``leave_out`` a document's own occurrences are subtracted, so it is scored by the other documents. A word
    that does not occur counts as occurring once among one more word. ``log_score`` sums natural logarithms,
    ``n_backoff`` counts the words whose full gram had count 0. A text without words (null, empty, blank) has score 0 and mean null.
    Contexts do not cross documents. Rows that repeat an id or a text are documents of their own. Equal grams are told by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_chunks = max(1, -(-chars // CHUNK_CHARS))
    n_parts = 1 << max(0, int(np.ceil(np.log2(max(1, chars / 6 / PARTITION_GRAMS)))))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_chunks)).cast("int"))
    # One length after the other: each is a job of its own, whose shuffle files are gone before the next.
    answers = [materialize(_count(chunked, length, n_parts), "gram-counts") for length in range(1, order + 1)]
    all_words = int(answers[0].agg(F.sum("events")).first()[0] or 0)
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, counts = chunk_words(left.column("text"))
        lengths, parts = right.column("length").to_numpy(), right.column("part").to_numpy()

        def totals() -> Iterator[np.ndarray]:
            for length in range(1, order + 1):
                mine = np.flatnonzero(lengths == length)
                mine = mine[np.argsort(parts[mine])]
                sums = [unplanes(right.column("totals")[int(i)].as_py()).view(np.int64) for i in mine]
                yield np.concatenate(sums) if sums else np.empty(0, dtype=np.int64)

        logs, missed = score_words(hashes, counts, totals(), all_words, backoff, leave_out)
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "log_score": pa.array(logs, pa.float64()),
            "mean_log_score": pa.array(logs / np.maximum(counts, 1), mask=counts == 0), "n_backoff": pa.array(missed, pa.int64()),
        })

    scored = chunked.groupBy("chunk").cogroup(every.groupBy("chunk"))
    return scored.applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double, n_backoff long")


def _count(chunked: DataFrame, length: int, n_parts: int) -> DataFrame:
    """``chunk, part, length, totals, events``: for each chunk the counts, over all chunks, of its distinct n-grams, in
    ascending order of their hashes; ``events`` adds up to the number of n-grams."""
    bits = n_parts.bit_length() - 1

    def tally(_: tuple, table: pa.Table) -> pa.Table:
        hashes, counts = chunk_words(table.column("text"))
        _, keys = gram_keys(hashes, np.append(0, np.cumsum(counts)), length)
        keys.sort()
        fresh = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        known, times = keys[fresh], np.diff(np.append(fresh, len(keys)))
        part = (known >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(known), dtype=np.int64)
        cuts = np.searchsorted(part, np.arange(n_parts + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        packed = [pack(known[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]) for i in some]
        number = table.column("chunk")[0].as_py()
        return pa.table({
            "part": pa.array(some, pa.int32()), "chunk": pa.array([number] * len(some), pa.int32()),
            "grams": pa.array([p[0] for p in packed], pa.binary()), "counts": pa.array([p[1] for p in packed], pa.binary()),
        })

    def total(table: pa.Table) -> pa.Table:
        held = [np.cumsum(unplanes(x.as_py()), dtype=np.uint64) for x in table.column("grams")]
        counts = [unplanes(x.as_py()) for x in table.column("counts")]
        every, n = np.concatenate(held), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        start = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        known, sums = every[start], np.add.reduceat(n, start)
        answers = [planes(sums[np.searchsorted(known, x)]) for x in held]
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column("part"), "length": pa.array([length] * len(held), pa.int32()),
            "totals": pa.array(answers, pa.binary()), "events": pa.array([int(c.sum()) for c in counts], pa.int64()),
        })

    counted = chunked.groupBy("chunk").applyInArrow(tally, "part int, chunk int, grams binary, counts binary")
    return counted.groupBy("part").applyInArrow(total, "chunk int, part int, length int, totals binary, events long")


def score_words(hashes: np.ndarray, counts: np.ndarray, totals: Iterable[np.ndarray], all_words: int, backoff: float, leave_out: bool):
    """(sum of logarithms, words that backed off) of each document of a chunk.

    ``totals``: for each length the counts of the chunk's distinct n-grams in ascending order of their keys. They are taken one
    after the other; of the counts of each word's grams those of two lengths are held at once.
    """
    n, first = len(hashes), np.append(0, np.cumsum(counts))
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    place = (np.arange(n) - np.repeat(first[:-1], counts)).astype(np.int32)  # of each word in its document
    for length, known in enumerate(totals, 1):
        count = _occurrences(hashes, first, length, known, owner, leave_out)
        if length == 1:
            rest = all_words - (counts[owner] if leave_out else 0)
            value = np.where(count > 0, count / np.maximum(rest, 1), 1.0 / (rest + 1))
            missed = count <= 0
            del rest
        else:
            # The gram of this length that ends at a word, and its context, which starts at the same word.
            at = np.flatnonzero(place >= length - 1)
            full, context = count[at - (length - 1)], shorter[at - (length - 1)]
            seen = full > 0
            value[at] = np.where(seen, full / np.maximum(context, 1), backoff * value[at])
            missed = np.zeros(n, dtype=bool)
            missed[at] = ~seen
            del at, full, context, seen
        shorter = count
    logs = np.bincount(owner, weights=np.log(value), minlength=len(counts))
    return logs, np.bincount(owner[missed], minlength=len(counts)).astype(np.int64)


def _occurrences(hashes: np.ndarray, first: np.ndarray, length: int, known: np.ndarray, owner: np.ndarray, leave_out: bool) -> np.ndarray:
    """Count of the gram of one length that starts at each word, -1 where it leaves the document."""
    count = np.full(len(hashes), -1, dtype=np.int64)
    at, keys = gram_keys(hashes, first, length)
    if not len(at):
        return count
    order = np.argsort(keys, kind="stable")  # equal keys stay in the order of their documents
    keys, at = keys[order], at[order]
    del order
    fresh = np.append(True, keys[1:] != keys[:-1])
    del keys
    found = known[np.cumsum(fresh) - 1]
    if leave_out:
        doc = owner[at]
        run = fresh | np.append(True, doc[1:] != doc[:-1])
        del doc
        own = np.diff(np.append(np.flatnonzero(run), len(at)))
        found -= own[np.cumsum(run) - 1]
    count[at] = found
    return count
