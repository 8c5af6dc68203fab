"""Exact products of many sparse queries with many sparse rows, block against block.

Queries and rows are put in groups of texts that share words, and by length, and cut into blocks. For two blocks the words that many
of both hold are multiplied as dense matrices; a word that few hold adds to exactly the pairs that share it. Groups and order
only say which pairs are scored together: every pair is scored, with all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from supportlake.operators.topk import _Best

#: Queries or rows of a block, rows and words of text that are read at once, words that are counted at once, and additions that are buffered at once.
BLOCK = 1024
STEP_ROWS, STEP_WORDS = 10_240, 8_000_000
TEXT_WORDS = 500_000
PORTION = 500_000
#: A word is multiplied densely if this share of a block's pairs has it, as one addition takes as long as hundreds of dense ones; most such words.
DENSE_SHARE = 0.002
DENSE_WORDS = 4096
#: Groups of texts, texts and words that they are fitted on, and rounds.
GROUPS, FIT_TEXTS, FIT_WORDS, FIT_ROUNDS = 8, 512, 512, 6


@dataclass(frozen=True)
class Lists:
    """Entries of ``n`` texts by word: ascending words, where each begins, and owner and value of each entry."""

    n: int
    words: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    values: np.ndarray


def by_word(words: np.ndarray, owners: np.ndarray, values: np.ndarray, n: int) -> Lists:
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    return Lists(n, words[first], np.r_[first, len(words)], owners[order], values[order])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _dense(lists: Lists, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words x texts; entries of one text and word are added."""
    at = _spans(first, size)
    flat = np.repeat(np.arange(len(first)), size) * lists.n + lists.owners[at]
    return np.bincount(flat, lists.values[at], len(first) * lists.n).reshape(len(first), lists.n)


def products(left: Lists, right: Lists, dense_share: float = DENSE_SHARE, portion: int = PORTION) -> np.ndarray:
    """Matrix of left texts x right texts: the sum over shared words of the products of their values."""
    place = np.minimum(np.searchsorted(right.words, left.words), max(len(right.words) - 1, 0))
    mine = np.flatnonzero(right.words[place] == left.words) if len(right.words) else np.empty(0, np.int64)
    other = place[mine]
    first, size = left.starts[mine], left.starts[mine + 1] - left.starts[mine]
    begin, count = right.starts[other], right.starts[other + 1] - right.starts[other]
    often = np.zeros(len(mine), bool)
    work = size * count
    most = np.argsort(-work, kind="stable")[:DENSE_WORDS]
    often[most[work[most] >= dense_share * left.n * right.n]] = True
    if often.any():
        out = _dense(left, first[often], size[often]).T @ _dense(right, begin[often], count[often])
    else:
        out = np.zeros((left.n, right.n))
    first, size, begin, count = (x[~often] for x in (first, size, begin, count))
    if not len(first):
        return out
    # Every entry of the right meets all entries of its word on the left, in portions of bounded size.
    at = _spans(begin, count)
    first, size = np.repeat(first, count), np.repeat(size, count)
    number = np.cumsum(size) // portion
    flat_out = out.reshape(-1)
    for low, high in _cuts(number):
        entry, reach = _spans(first[low:high], size[low:high]), size[low:high]
        flat = left.owners[entry] * right.n + np.repeat(right.owners[at[low:high]], reach)
        flat_out += np.bincount(flat, left.values[entry] * np.repeat(right.values[at[low:high]], reach), len(flat_out))
    return out


def _cuts(number: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)].tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _presence(words: np.ndarray, owners: np.ndarray, n: int, vocabulary: np.ndarray) -> np.ndarray:
    """Texts x words of ``vocabulary`` (ascending), as unit vectors."""
    out = np.zeros((n, len(vocabulary)), np.float32)
    if len(vocabulary):
        place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        held = vocabulary[place] == words
        out[owners[held], place[held]] = 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_groups(words: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words of some of the texts, ascending, and centres of groups of texts that share them (spherical k-means)."""
    texts = np.unique(np.linspace(0, n - 1, min(n, FIT_TEXTS)).astype(np.int64)) if n else np.empty(0, np.int64)
    number = np.full(n, -1)
    number[texts] = np.arange(len(texts))
    held = number[owners] >= 0
    found, times = np.unique(words[held], return_counts=True)
    vocabulary = np.sort(found[np.argsort(-times, kind="stable")[:FIT_WORDS]])
    points = _presence(words[held], number[owners[held]], len(texts), vocabulary)
    # The first centres are far from each other.
    near, picks = np.full(len(points), -1.0), []
    for _ in range(min(GROUPS, len(points))):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, points @ points[picks[-1]])
    centres = points[picks]
    for _ in range(FIT_ROUNDS if len(points) else 0):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[own == g].sum(axis=0) for g in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return vocabulary, centres


def blocks_of(words: np.ndarray, owners: np.ndarray, values: np.ndarray, n: int, groups: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, Lists]]:
    """Blocks of texts of one group, those of many entries first: the group, which texts, and their entries. Texts without entries are in none."""
    vocabulary, centres = groups
    size = np.bincount(owners, minlength=n)
    own = np.argmax(_presence(words, owners, n, vocabulary) @ centres.T, axis=1) if len(centres) else np.zeros(n, np.int64)
    order = np.lexsort((-size, own))
    order = order[size[order] > 0]
    by_owner = np.argsort(owners, kind="stable")
    first = np.cumsum(size) - size
    for low, high in _cuts(own[order]) if len(order) else ():
        for start in range(low, high, block):
            texts = order[start : min(start + block, high)]
            at = by_owner[_spans(first[texts], size[texts])]
            yield int(own[texts[0]]), texts, by_word(words[at], np.repeat(np.arange(len(texts)), size[texts]), values[at], len(texts))


def pack_queries(rows: pa.Table) -> dict:
    """Queries of (query_id, terms, idfs) rows: their words, a value per word, and blocks of them.

    A term has the same idf in all queries. Only plain arrays, with four bytes an entry, are kept: a broadcast is held by every worker.
    """
    terms, idfs = (rows.column(c).combine_chunks() for c in ("terms", "idfs"))
    query_ids, place = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    who = np.repeat(place, pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
    coded = terms.flatten().dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    idf = np.zeros(len(coded.dictionary))
    idf[words] = idfs.flatten().to_numpy()
    groups = fit_groups(words, who, len(query_ids))
    small = lambda x: x.astype(np.int32)
    blocks = [
        (group, queries, lists.n, *map(small, (lists.words, lists.starts, lists.owners)))
        for group, queries, lists in blocks_of(words, who, np.broadcast_to(0.0, len(words)), len(query_ids), groups)
    ]
    return {"query_ids": query_ids, "terms": coded.dictionary, "idf": idf, "groups": groups, "blocks": blocks}


def _lists(packed: dict, n: int, words: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> Lists:
    """The entries of a packed block, as they are multiplied."""
    return Lists(n, words.astype(np.int64), starts.astype(np.int64), owners.astype(np.int64), np.repeat(packed["idf"][words], np.diff(starts)))


def _steps(sizes: np.ndarray, rows: int, total: int) -> list[tuple[int, int]]:
    """Cuts of rows: at most ``rows`` of them, and of sizes that come to about ``total``."""
    held = (np.cumsum(sizes) - 1).clip(0) // total
    return [(start, min(start + rows, high)) for low, high in _cuts(held) for start in range(low, high, rows)] if len(sizes) else []


def _known_words(part: pa.Table, packed: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and frequency of the words of the rows that some query has, counted for few words of text at a time."""
    n_terms = max(len(packed["terms"]), 1)
    lists = pc.split_pattern(part.column("words").combine_chunks(), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    # Terms are looked up at once, as every look-up hashes all of them first.
    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=packed["terms"]), -1).to_numpy()
    del lists
    first = np.r_[0, np.cumsum(sizes)]
    cells, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low, high in _steps(sizes, part.num_rows, TEXT_WORDS):
        mine = place[first[low] : first[high]]
        cell, tf = np.unique((np.repeat(np.arange(low, high), sizes[low:high]) * n_terms + mine)[mine >= 0], return_counts=True)
        cells.append(cell)
        times.append(tf)
    cell = np.concatenate(cells)
    return cell // n_terms, cell % n_terms, np.concatenate(times)


def bm25_best(tables: Iterator[pa.Table], packed: dict, k: int, k1: float, b: float, avg_len: float) -> pa.RecordBatch:
    """The k best rows (chunk_id, words: tokens joined by blanks, doc_len) of every packed query that share a word with it."""
    best = _Best(k, len(packed["query_ids"]))
    for table in tables:
        for start, stop in _steps(pc.fill_null(table.column("doc_len"), 0).to_numpy(), STEP_ROWS, STEP_WORDS):
            part = table.slice(start, stop - start)
            row, word, tf = _known_words(part, packed)
            length = part.column("doc_len").to_numpy()
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avg_len))
            ids = part.column("chunk_id").to_numpy()
            blocks = list(blocks_of(word, row, weight, part.num_rows, packed["groups"]))
            del row, word, tf, weight
            for group, queries, *entries in packed["blocks"]:
                left = _lists(packed, *entries)
                # Rows of the queries' own group first: few others reach their scores.
                for _, rows, right in sorted(blocks, key=lambda x: x[0] != group):
                    best.add(ids[rows], products(left, right), queries, 0.0)
    return best.batch(packed["query_ids"])
