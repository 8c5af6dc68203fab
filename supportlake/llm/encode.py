"""Encoding and decoding whole tables of texts by byte-level BPE."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from supportlake.llm.bpe import parts, vocabulary
from supportlake.llm.worker import give_back


def read_definition(path: str) -> str:
    """A tokenizer file read on the driver; its text (about a megabyte, fixed) travels with the tasks."""
    return Path(path).read_text(encoding="utf-8")


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``bpe_ids`` (array<int>) and ``bpe_text`` (decoded), if kept, ``bpe_n_tokens``, ``bpe_ids_sha256`` and ``bpe_text_sha256``.

    Every whole text is encoded by the pair occurrence index and decoded again; strings of special tokens in a text become these tokens. A null text is empty and
    decodes to an empty text. All rows and columns stay, repeated rows too, but columns of the input that start
    with ``bpe_`` go. A narrow operation: no shuffle, memory bounded by an Arrow batch.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("bpe_")])
    definition = read_definition(tokenizer_path)
    added = [("bpe_n_tokens", T.LongType()), ("bpe_ids_sha256", T.StringType()), ("bpe_text_sha256", T.StringType())]
    if keep_text:
        added.insert(0, ("bpe_text", T.StringType()))
    if keep_ids:
        added.insert(0, ("bpe_ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(definition)
        for batch in batches:
            at = 0
            for texts in parts(batch.column("text").to_pylist()):
                ids = bpe.encode(texts)
                back = [bpe.decode(x) for x in ids]
                rows = batch.slice(at, len(texts))
                at += len(texts)
                out = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                if keep_text:
                    out.insert(0, pa.array(back, pa.binary()).cast(pa.string()))
                if keep_ids:
                    ends, total = [0], 0
                    for x in ids:
                        total += len(x) // 4
                        ends.append(total)
                    flat = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(ids))])
                    out.insert(0, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays([*rows.columns, *out], [*batch.schema.names, *[name for name, _ in added]])
        bpe.forget()
        give_back()

    return docs.mapInArrow(run, schema)
