"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

Every document is a reference block, indexed by its word grams. To find the blocks a document shares text with, grams
are sampled: of the grams in each window the one with the smallest hash is an anchor, so equal windows have equal anchors. A
document is parsed against the block with the first occurrence of each of its anchors: from an anchor the factor is
extended greedily to both sides as far as any window with this anchor reaches; extents that overlap on one diagonal are
one factor. Factors of a window's length or more are duplicate spans. Windows at factor boundaries (windows with a shared
anchor that no factor of that block covers) are looked up in a table of such windows. This is exact: where a
window's first occurrence holds its anchor's first occurrence, the factor covers it; else its first occurrence is itself a
boundary window, and the table has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.llm.words import Words, grams, inside, list_column, mix, slices
from supportlake.session import materialize

#: Words of an anchor; the rest of a window is the reach of the sampling.
ANCHOR = 6
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, which has the order of ids: the id itself where ids are unique and not null.

    Else a written table numbers the rows by id (null first), text; rows that repeat an id count as one after the other.
    """
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.withColumn("row_key", F.col("doc_id").cast("long"))
    laid = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return materialize(laid.withColumn("row_key", F.monotonically_increasing_id()), "parse-rows")


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors: the leftmost smallest gram of every window of one document."""
    reach = window - ANCHOR + 1
    values = grams(words.hashes, ANCHOR)
    starts = np.flatnonzero(inside(words.first, window))
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    best = np.lib.stride_tricks.sliding_window_view(values, reach).argmin(axis=1)
    at = starts + best[starts]
    chosen = np.zeros(len(values), dtype=bool)
    chosen[at] = True
    at = np.flatnonzero(chosen)
    return at, values[at]


def anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """``anchor, row_key, at, again``: anchors of all documents; again: an equal one is earlier in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for a, _, words in slices(batch.column("text")):
                at, values = anchors(words, window)
                if not len(at):
                    continue
                owner = np.searchsorted(words.first, at, side="right") - 1
                own = mix(values + mix(owner.astype(np.uint64) + np.uint64(1)))
                again = np.ones(len(at), dtype=bool)
                again[np.unique(own, return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(keys[a + owner]), pa.array((at - words.first[owner]).astype(np.int32)), pa.array(again)],
                    ["anchor", "row_key", "at", "again"],
                )

    return rows.select("row_key", "text").mapInArrow(run, "anchor long, row_key long, at int, again boolean")


def stretches(placed: DataFrame, window: int) -> DataFrame:
    """Per document and block, the word hashes around the shared anchors.

    ``placed``: ``row_key, text, shared`` (array of ``block, at``). Gives ``block, row_key, n_words, at`` and the words
    of the stretches: ``begin`` and ``size`` of each, ``held`` all hashes in a row.
    """
    reach = window - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["block", "row_key", "n_words", "at", "begin", "size", "held"]
        for batch in batches:
            rows: list[tuple] = []
            keys, shared = batch.column("row_key").to_numpy(), batch.column("shared")
            for a, z, words in slices(batch.column("text")):
                hashes = words.hashes
                for i in range(a, z):
                    pairs = shared[i].values.flatten()
                    blocks, at = pairs[0].to_numpy(), pairs[1].to_numpy().astype(np.int64)
                    own = hashes[words.first[i - a] : words.first[i - a + 1]]
                    order = np.lexsort((at, blocks))
                    blocks, at = blocks[order], at[order]
                    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                    for x, y in zip(cuts, cuts[1:]):
                        here = at[x:y]
                        low, high = np.maximum(here - reach, 0), np.minimum(here + window, len(own))
                        fresh = np.ones(len(here), dtype=bool)
                        fresh[1:] = low[1:] > high[:-1]
                        begin = low[fresh]
                        end = high[np.append(np.flatnonzero(fresh)[1:] - 1, len(here) - 1)]
                        held = np.concatenate([own[b:e] for b, e in zip(begin, end)])
                        rows.append((blocks[x], keys[i], len(own), here, begin, end - begin, held))
            if rows:
                out = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
                for j, kind in ((3, pa.int32()), (4, pa.int32()), (5, pa.int32()), (6, pa.int64())):
                    flat = np.concatenate([r[j] for r in rows])
                    flat = flat.view(np.int64) if j == 6 else flat
                    out.append(list_column(flat, np.array([len(r[j]) for r in rows]), kind))
                yield pa.RecordBatch.from_arrays(out, kinds)

    schema = "block long, row_key long, n_words long, at array<int>, begin array<int>, size array<int>, held array<long>"
    return placed.mapInArrow(run, schema)


def parse(at, begin, size, held, n_words: int, block: np.ndarray, block_anchors, same: bool, window: int):
    """Duplicate spans (begin, end) of a document against one block, and starts and hashes of its boundary windows.

    ``at``: the document's anchors that the block has; ``block``: the block's word hashes; ``block_anchors``: positions
    and hashes of its anchors; ``same``: the block is the document itself, where only earlier occurrences count.
    """
    reach = window - ANCHOR
    offset = np.cumsum(size) - size
    which = np.searchsorted(begin, at, side="right") - 1
    place = offset[which] + at - begin[which]  # of each anchor in held
    own = grams(held, ANCHOR)[place]
    index, first = np.unique(block_anchors[1], return_index=True)
    spot = np.minimum(np.searchsorted(index, own), len(index) - 1)
    q = block_anchors[0][first[spot]]
    found = (index[spot] == own) & ((q < at) if same else True)
    at, place, q = at[found], place[found], q[found]
    none = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    if not len(at):
        return none
    steps = np.arange(-reach, window)
    mine, theirs = at[:, None] + steps, q[:, None] + steps
    ok = (mine >= 0) & (mine < n_words) & (theirs >= 0) & (theirs < len(block))
    equal = ok & (held[np.clip(place[:, None] + steps, 0, len(held) - 1)] == block[np.clip(theirs, 0, len(block) - 1)])
    left = np.cumprod(equal[:, :reach][:, ::-1], axis=1).sum(axis=1)
    right = np.cumprod(equal[:, reach + ANCHOR :], axis=1).sum(axis=1)
    low, high = at - left, at + ANCHOR + right
    # Windows with the anchor, and which of them the factor covers.
    starts = at[:, None] - np.arange(reach + 1)
    real = (starts >= 0) & (starts + window <= n_words)
    covered = real & (starts >= low[:, None]) & (starts + window <= high[:, None])
    rest = real & ~covered
    edge_starts = starts[rest]
    edges = grams(held, window)[(place[:, None] - np.arange(reach + 1))[rest]]
    edge_starts, pick = np.unique(edge_starts, return_index=True)
    edges = edges[pick]
    long = high - low >= window
    low, high = low[long], high[long]
    if not len(low):
        return none[0], edge_starts, edges
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = low[1:] > high[:-1]
    ends = high[np.append(np.flatnonzero(fresh)[1:] - 1, len(low) - 1)]
    return np.stack([low[fresh], ends], axis=1), edge_starts, edges


def parse_rows(met: DataFrame, window: int) -> DataFrame:
    """``row_key, spans`` (begin, end, begin, ..), ``starts`` and ``edges`` of documents with one block each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            out = []
            columns = {c: batch.column(c) for c in ("at", "begin", "size", "held")}
            keys, blocks, n_words = (batch.column(c).to_numpy() for c in ("row_key", "block", "n_words"))
            for a, z, words in slices(batch.column("text")):
                hashes = words.hashes
                spots, values = anchors(words, window)
                cuts = np.searchsorted(spots, words.first)
                for i in range(a, z):
                    at, begin, size, held = (columns[c][i].values.to_numpy() for c in ("at", "begin", "size", "held"))
                    block = hashes[words.first[i - a] : words.first[i - a + 1]]
                    own = slice(cuts[i - a], cuts[i - a + 1])
                    known = spots[own] - words.first[i - a], values[own]
                    same, n = bool(keys[i] == blocks[i]), int(n_words[i])
                    out.append(parse(at.astype(np.int64), begin.astype(np.int64), size.astype(np.int64), held.view(np.uint64), n, block, known, same, window))
            lists = [
                list_column(np.concatenate([o[0].ravel() for o in out]), np.array([o[0].size for o in out]), pa.int32()),
                list_column(np.concatenate([o[1] for o in out]), np.array([len(o[1]) for o in out]), pa.int32()),
                list_column(np.concatenate([o[2] for o in out]).view(np.int64), np.array([len(o[2]) for o in out]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *lists], ["row_key", "spans", "starts", "edges"])

    return met.mapInArrow(run, "row_key long, spans array<int>, starts array<int>, edges array<long>")


def duplicate_spans(rows: DataFrame, window: int) -> DataFrame:
    """``row_key, begins``, ``ends``: spans of words that windows starting earlier cover. ``rows`` comes from ``keyed``."""
    sampled = anchor_rows(rows, window)
    firsts = sampled.groupBy("anchor").agg(F.min("row_key").alias("block"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("anchor", "block"), "parse-anchors")
    shared = sampled.join(firsts, "anchor").where("row_key <> block or again")
    lists = shared.groupBy("row_key").agg(F.collect_list(F.struct("block", "at")).alias("shared"))  # at most a document's words
    texts = rows.select("row_key", "text")
    asked = stretches(texts.join(lists, "row_key").select("row_key", "text", "shared"), window)
    met = asked.join(texts.withColumnRenamed("row_key", "block"), "block")
    parsed = materialize(parse_rows(met.select("block", "row_key", "n_words", "at", "begin", "size", "held", "text"), window), "parse-factors")

    edges = parsed.select("row_key", F.explode(F.arrays_zip("starts", "edges")).alias("e")).select(
        F.col("e.edges").alias("edge"), "row_key", F.col("e.starts").alias("start")
    )
    own = materialize(edges.groupBy("edge", "row_key").agg(F.min("start").alias("first_start")), "parse-edges")
    first = own.groupBy("edge").agg(F.min("row_key").alias("first_key"))
    met_edges = edges.join(own, ["edge", "row_key"]).join(first, "edge")
    repeated = met_edges.where("row_key <> first_key or start <> first_start").select(
        "row_key", F.col("start").alias("begin"), (F.col("start") + window).alias("end")
    )
    numbers = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    factors = parsed.where(F.size("spans") > 0).select("row_key", "spans", F.explode(numbers).alias("i")).select(
        "row_key", F.col("spans")[F.col("i")].alias("begin"), F.col("spans")[F.col("i") + 1].alias("end")
    )
    spans = factors.unionByName(repeated).groupBy("row_key", "begin").agg(F.max("end").alias("end"))
    return spans.groupBy("row_key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))


def removed_words(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def cut_text(text: str, drop: np.ndarray) -> str:
    """The text without the dropped words: runs of kept words with the space between them, one per line."""
    found = [m.span() for m in _WORD.finditer(text)]
    kept = np.flatnonzero(~drop)
    if not len(kept):
        return ""
    runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)
    return "\n".join(text[found[r[0]][0] : found[r[-1]][1]] for r in runs)


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept_sha256, clean_text, begins, ends``.

    Words that lie in a window of ``window`` words which also starts earlier (in a document of a smaller id, or earlier in
    the same one) are removed; windows are judged on the input. ``kept_sha256`` is that of the kept words joined by one
    blank. ``clean_text`` is the text with the removed words cut out, and unchanged without any. ``begins`` and ``ends``
    are spans of removed words (they may overlap; null without any). A null text is empty. Rows that repeat an id come
    one after the other, by text, a null id first. Equal words are told by 64-bit hashes. All rows and columns stay; a result replaces a column of its name (and ``row_key`` goes).
    An empty table gives no rows.
    """
    results = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("clean_text", T.StringType())]
    docs = docs.drop(*[name for name, _ in results], "begins", "ends", "row_key")
    if window <= ANCHOR:
        raise ValueError(f"a window has more than {ANCHOR} words")
    rows = keyed(docs)
    spans = materialize(duplicate_spans(rows.select("row_key", "doc_id", "text"), window), "parse-spans")
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("begins", "ends")]
    schema = T.StructType([*docs.schema.fields, *lists, *[T.StructField(name, kind) for name, kind in results]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, clean, digests = [], [], [], []
            for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends")):
                text = text.as_py()
                words, gone = _WORD.findall(text), 0
                n_words.append(len(words))
                if begins.is_valid:
                    drop = removed_words(len(words), begins.values.to_numpy(), ends.values.to_numpy())
                    gone = int(drop.sum())
                    words = [words[i] for i in np.flatnonzero(~drop).tolist()]
                    text = cut_text(text, drop)
                n_removed.append(gone)
                clean.append(text)
                digests.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            out = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)

    joined = rows.join(spans, "row_key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "begins", "ends")
    return joined.mapInArrow(run, schema)
