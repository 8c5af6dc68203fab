"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

The leaves of a document's tree are runs of pieces (pre-tokens with the blank before them, or white space); a node has
the sums of characters and tokens below it. An edit finds its place by descending the sums. The touched leaves with one
leaf of context on each side are cut and encoded anew, to the right until the new cuts meet the old ones again; then sums
change on the way to the root alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.llm.bpe import LONG_PIECE, MEMORY, PIECE, byte_alphabet
from supportlake.llm.encode import read_definition
from supportlake.llm.words import list_column
from supportlake.llm.worker import per_worker

#: Pieces of a leaf. A leaf that grew to eight times this makes its tree be built anew.
LEAF = 16
EDITS = "array<struct<at:int,drop:int,put:string>>"
_PIECE = re.compile(PIECE)


class PieceCounts(dict):
    """Number of tokens of each piece, by the library; strings of special tokens are ordinary text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, piece: str) -> int:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():  # one pre-token: straight to the model
            n = len(self.tokenize(piece.encode().decode("latin-1").translate(self.alphabet)))
        else:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONG_PIECE:
            self[piece] = n
        return n

    def of(self, pieces: list[str]) -> list[int]:
        if len(self) > MEMORY:
            self.clear()
        return list(map(self.__getitem__, pieces))


def piece_counts(definition: str) -> PieceCounts:
    return per_worker(("piece counts", definition), lambda: PieceCounts(definition))


class Tree:
    """Sums of characters and tokens over the leaves; node i has the children 2 i and 2 i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.width = len(chars) // 2
        self.chars, self.tokens = chars, tokens

    @staticmethod
    def build(text: str, counts: PieceCounts) -> Tree:
        pieces = _PIECE.findall(text)
        n = -(-len(pieces) // LEAF)
        width = 1 << max(0, (n - 1).bit_length())
        sums = np.zeros((2, 2 * width), dtype=np.int64)
        if n:
            cuts = np.arange(0, len(pieces), LEAF)
            sums[0, width : width + n] = np.add.reduceat(list(map(len, pieces)), cuts)
            sums[1, width : width + n] = np.add.reduceat(counts.of(pieces), cuts)
            level = width
            while level > 1:
                sums[:, level // 2 : level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
                level //= 2
        return Tree(sums[0], sums[1])

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that has character ``at`` (the last one with text at the end), and the characters before that leaf."""
        node, before = 1, 0
        at = min(at, int(self.chars[1]) - 1)
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        by = (chars - int(self.chars[node]), tokens - int(self.tokens[node]))
        while node:
            self.chars[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def edit(self, text: str, at: int, drop: int, put: str, counts: PieceCounts) -> tuple[str, int]:
        """The edited text, and the number of pieces encoded for it."""
        at = min(max(at, 0), len(text))
        drop = min(max(drop, 0), len(text) - at)
        after = text[:at] + put + text[at + drop :]
        if not text:
            fresh = Tree.build(after, counts)
            self.width, self.chars, self.tokens = fresh.width, fresh.chars, fresh.tokens
            return after, len(_PIECE.findall(after))
        first, start = self.find(max(at - 1, 0))
        while first > 0:  # context on the left
            first -= 1
            grown = int(self.chars[first + self.width])
            start -= grown
            if grown:
                break
        last, last_start = self.find(at + drop)
        end = last_start + int(self.chars[last + self.width])
        shift = len(put) - drop
        while True:
            while last + 1 < self.width and end < len(text):  # context on the right
                last += 1
                grown = int(self.chars[last + self.width])
                end += grown
                if grown:
                    break
            region = after[start : end + shift]
            if end >= len(text):
                pieces = _PIECE.findall(region)
                break
            # One more character decides how the last piece ends; the cut must be where the old one was.
            pieces, length = [], 0
            for m in _PIECE.finditer(after, start):
                pieces.append(m.group())
                length = m.end() - start
                if length >= len(region):
                    break
            if length == len(region):
                break
        self.put(first, len(region), sum(counts.of(pieces)))
        for leaf in range(first + 1, last + 1):
            self.put(leaf, 0, 0)
        done = len(pieces)
        if done > 8 * LEAF + 2 * LEAF * (last - first + 1):
            fresh = Tree.build(after, counts)
            self.width, self.chars, self.tokens = fresh.width, fresh.chars, fresh.tokens
        return after, done


def sample_edits(text: Column, key: Column) -> Column:
    """Two edits for each text, by hash of ``key``: drop up to 40 characters at one place, copy 60 characters to another."""
    n = F.length(text)
    place = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), n + F.lit(1)).cast("int")
    start = F.pmod(F.xxhash64(key, F.lit(3)), n + F.lit(1)).cast("int")
    first = F.struct(place(1).alias("at"), F.lit(40).alias("drop"), F.lit("").alias("put"))
    second = F.struct(place(2).alias("at"), F.lit(0).alias("drop"), F.substring(text, start + F.lit(1), F.lit(60)).alias("put"))
    return F.array(first, second).cast(EDITS)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with ``tree_chars`` and ``tree_tokens``, the sums of each text's tree (the total at index 1), and ``n_tokens``.

    A null text is empty: a tree of one empty leaf, 0 tokens. All rows stay; a result replaces a column of its name.
    """
    definition = read_definition(tokenizer_path)
    docs = docs.drop("tree_chars", "tree_tokens", "n_tokens")
    sums = T.ArrayType(T.LongType(), False)
    schema = T.StructType([*docs.schema.fields, T.StructField("tree_chars", sums), T.StructField("tree_tokens", sums), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(definition)
        for batch in batches:
            if not len(batch):
                continue
            trees = [Tree.build(t or "", counts) for t in batch.column("text").to_pylist()]
            sizes = np.array([2 * t.width for t in trees])
            added = [
                list_column(np.concatenate([t.chars for t in trees]), sizes, pa.int64()),
                list_column(np.concatenate([t.tokens for t in trees]), sizes, pa.int64()),
                pa.array([int(t.tokens[1]) for t in trees], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "tree_chars", "tree_tokens", "n_tokens"])
        counts.clear()

    return docs.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits: Column, tokenizer_path: str) -> DataFrame:
    """Applies each row's ``edits`` (array of ``at, drop, put``, in order, in code points of the text so far).

    ``trees`` comes from ``count_tokens``. Text, trees and ``n_tokens`` follow the edits; ``n_before`` has the count
    before, ``n_edits`` the edits applied, ``n_encoded`` the pieces that were encoded for them. Places beyond the text
    mean its end; a null edit, a null list and a null ``put`` change nothing. A result replaces a column of its name.
    """
    definition = read_definition(tokenizer_path)
    given = trees.withColumn("edit_list", edits).drop("n_edits", "n_encoded").withColumn("n_before", F.col("n_tokens"))
    schema = T.StructType([f for f in given.schema.fields if f.name != "edit_list"] + [T.StructField("n_edits", T.LongType()), T.StructField("n_encoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(definition)
        for batch in batches:
            if not len(batch):
                continue
            texts, done, n_edits, grown = [], [], [], []
            lists = batch.column("edit_list").to_pylist()
            for text, edit_list, chars, tokens in zip(batch.column("text").to_pylist(), lists, batch.column("tree_chars"), batch.column("tree_tokens")):
                tree = Tree(chars.values.to_numpy().copy(), tokens.values.to_numpy().copy())
                total, applied = 0, 0
                for e in edit_list or []:
                    if e is None or e["at"] is None:
                        continue
                    text, n = tree.edit(text or "", e["at"], e["drop"] or 0, e["put"] or "", counts)
                    total, applied = total + n, applied + 1
                texts.append(text)
                done.append(total)
                n_edits.append(applied)
                grown.append(tree)
            sizes = np.array([2 * t.width for t in grown])
            new = {
                "text": pa.array(texts, pa.string()),
                "tree_chars": list_column(np.concatenate([t.chars for t in grown]), sizes, pa.int64()),
                "tree_tokens": list_column(np.concatenate([t.tokens for t in grown]), sizes, pa.int64()),
                "n_tokens": pa.array([int(t.tokens[1]) for t in grown], pa.int64()),
                "n_edits": pa.array(n_edits, pa.int64()),
                "n_encoded": pa.array(done, pa.int64()),
            }
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)
        counts.clear()

    return given.mapInArrow(run, schema)
