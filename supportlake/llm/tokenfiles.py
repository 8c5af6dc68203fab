"""Token ids of whole texts as flat binary files with 64-bit document offsets.

Documents are dealt to partitions by ranges of their id and sorted there. A partition writes three flat little-endian
files: ``.bin`` (unsigned ids, 16 or 32 bits by vocabulary), ``.idx`` (64-bit offsets of each document in the file, and
the end) and ``.doc`` (64-bit document ids). A manifest with one row per partition has names, sizes and, from prefix
sums over these sizes, the position of the partition's first id and document among all. Files have unique names and only
those in the committed manifest count, so repeated or lost tasks do no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportlake.llm.bpe import byte_alphabet
from supportlake.llm.encode import read_definition
from supportlake.llm.worker import per_worker
from supportlake.session import run_dir

#: Words that a task remembers; it forgets all when there are more, and at its end.
MEMORY = 600_000
#: Not split on plain blanks: other separators (which are no white space to the vocabulary) and letters whose lower case
#: depends on their place.
_UNUSUAL = re.compile("[\x1c-\x1fİΣ]")
_MARK = re.compile("[,.](?<=[a-zß-öø-ÿ][,.])(?=[ \n])")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MANIFEST = "part int, path string, n_docs long, n_null long, n_ids long, width int"


class WordTable(dict):
    """Lower-case words of a text without white space to ids, for a vocabulary that lowers case and drops white space.

    Texts are cut at white space and before a mark between a letter and white space: no pre-token crosses these cuts.
    A word of plain letters goes to the library's BPE model as its pre-tokens would; any other goes through the whole
    tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        alphabet = byte_alphabet()
        self.letters = {ord(c): "".join(alphabet[b] for b in c.encode()) for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len)
        self.plain = '"type":"Lowercase"' in definition.replace(" ", "") and '"Removed"' in definition

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.tokenize(word)]
        elif _LETTERS.fullmatch(word):
            ids = [t.id for t in self.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = self.pack(ids)
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as the library gives them without special tokens added; null is an empty text."""
        if not text:
            return b""
        if not self.plain or _UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) > MEMORY:
            self.clear()
        return b"".join(map(self.__getitem__, _MARK.sub(r" \g<0>", text.lower()).split()))


def word_table(definition: str) -> WordTable:
    return per_worker(("word table", definition), lambda: WordTable(definition))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_column: str = "doc_id") -> DataFrame:
    """Writes the files of ``docs`` under ``folder`` and returns the manifest: ``part, path, n_docs, n_null, n_ids, width, doc_base, id_base``.

    A document is its ids and ``end_id``; a null text has the end id alone. Order: id (null first), equal ids by text.
    An empty table writes no file and gives an empty manifest. ``folder`` must be one that all executors share.
    """
    definition = read_definition(tokenizer_path)
    place, base = file_system(folder)
    place.create_dir(base, recursive=True)
    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(definition)
        end = np.array([end_id], dtype=table.kind).tobytes()
        store, base = file_system(folder)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        offsets, ids, total, nulls = [np.zeros(1, dtype=np.int64)], [], 0, 0
        out = None
        for batch in batches:
            if not len(batch):
                continue
            out = out or store.open_output_stream(f"{path}.bin")
            sizes = np.empty(len(batch), dtype=np.int64)
            for i, text in enumerate(batch.column("text")):
                found = table.encode(text.as_py())
                out.write(found + end)
                sizes[i] = (len(found) + len(end)) // len(end)
            offsets.append(total + np.cumsum(sizes))
            total = int(offsets[-1][-1])
            keys = batch.column("doc_id")
            nulls += keys.null_count
            ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        table.clear()
        if out is None:
            return
        out.close()
        for suffix, parts in ((".idx", offsets), (".doc", ids)):
            with store.open_output_stream(path + suffix) as side:
                side.write(np.concatenate(parts).astype("<i8").tobytes())
        row = [TaskContext.get().partitionId(), path, sum(map(len, ids)), nulls, total, len(end)]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds)], ["part", "path", "n_docs", "n_null", "n_ids", "width"]
        )

    laid.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with the prefix sums before it."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per document
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return files.withColumn("doc_base", total("n_docs")).withColumn("id_base", total("n_ids"))


def _map(store: fs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return file.read_buffer()
    with store.open_input_file(path) as file:
        return file.read_buffer()


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if kept, ``ids`` (array<long>).

    ``start`` counts the ids of all documents before; the crc is that of the ids as unsigned 32-bit integers.
    """
    manifest = read_manifest(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(_map(store, row["path"] + ".bin"), f"<u{row['width']}")
                offsets = np.frombuffer(_map(store, row["path"] + ".idx"), "<i8")
                ids = np.frombuffer(_map(store, row["path"] + ".doc"), "<i8")
                for a in range(0, len(ids), 4096):
                    z = min(a + 4096, len(ids))
                    held = flat[offsets[a] : offsets[z]].astype("<u4")
                    cuts = (offsets[a : z + 1] - offsets[a]).tolist()
                    crc = [zlib.crc32(held[x:y]) for x, y in zip(cuts, cuts[1:])]
                    none = np.arange(a, z) < row["n_null"]
                    out = [pa.array(ids[a:z], pa.int64(), mask=none), pa.array(offsets[a:z] + row["id_base"]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                    if keep_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(held, pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    return manifest.repartition("part").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes ``docs`` to a fresh shared folder and reads the files back."""
    folder = run_dir(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, end_id, folder)
    return read_token_files(docs.sparkSession, folder)
