import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from supportlake.llm import editcount, encode, tokenfiles
from supportlake.llm.bpe import PairIndexBpe
from supportlake.llm.queries import tokenizer_path
from tests.llm.common import empty_table, odd_rows, odd_table, table

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ALPHABET = " \n\tab'sé1٣² 　日!<|>\x1c\x85É.,İΣßÿ÷ạ̈"


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [
        "<|endoftext|>x<|endoftext|>", "aaaaaaaaaaaaaaaaaaa aaaa", "WORD, Word. 'S can't", "a  b   c\n\n d \n e", "a" * 3000, "ab" * 3000,
    ]


def library(path):
    tool = tokenizers.Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def test_pair_index_equals_library():
    tool, bpe = library(BYTE), PairIndexBpe(encode.read_definition(BYTE))
    given = texts()
    for text, ids in zip(given, bpe.encode(given)):
        want = tool.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert bpe.decode(ids).decode() == tool.decode(want, skip_special_tokens=False)
    assert bpe.decode(np.array([160, 65], "<u4").tobytes()).decode() == tool.decode([160, 65], skip_special_tokens=False)


def test_encode_documents(spark):
    tool, docs = library(BYTE), odd_table(spark)
    got = encode.encode_documents(docs, BYTE).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        ids = tool.encode(r.text or "", add_special_tokens=False).ids
        assert r.bpe_ids == ids and r.bpe_n_tokens == len(ids) and r.bpe_text == (r.text or "")
        assert r.bpe_ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.bpe_text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert encode.encode_documents(empty_table(spark), BYTE).count() == 0


def test_token_files_read_back(spark, tmp_path):
    tool = library(WORD)
    given = texts(200) + [None, ""]
    docs = table(spark, given, start=5)
    folder = str(tmp_path / "files")
    manifest = tokenfiles.write_token_files(docs, WORD, 2, folder)
    assert sum(r.n_docs for r in manifest.collect()) == len(given)
    start = 0
    for r in sorted(tokenfiles.read_token_files(spark, folder, keep_ids=True).collect()):
        ids = tool.encode(given[r.doc_id - 5] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_odd_rows_and_empty_table(spark):
    got = tokenfiles.token_files(odd_table(spark), WORD, 2).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in odd_rows())
    rows = sorted(got, key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert tokenfiles.token_files(empty_table(spark), WORD, 2).count() == 0


def test_edits_keep_counts_right():
    tool = library(BYTE)
    tool.encode_special_tokens = True
    counts = editcount.PieceCounts(encode.read_definition(BYTE))
    rng = random.Random(7)
    for text in [t for t in texts(250, 3)] + [" ".join(f"word{i}" for i in range(900))]:
        tree = editcount.Tree.build(text, counts)
        for _ in range(6):
            put = rng.choice(["", "a", " ", "  ", "\n", " foo bar", "é", "<|endoftext|>", "x" * 50, " w" * 300])
            text, n = tree.edit(text, rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 40, 5000]), put, counts)
            assert tree.tokens[1] == len(tool.encode(text, add_special_tokens=False).ids)
            assert tree.chars[1] == len(text)


def test_edit_is_local():
    counts = editcount.PieceCounts(encode.read_definition(BYTE))
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = editcount.Tree.build(text, counts)
    assert tree.edit(text, 50_000, 3, "new", counts)[1] <= 5 * editcount.LEAF


def test_edit_counts_odd_rows(spark):
    tool = library(BYTE)
    tool.encode_special_tokens = True
    trees = editcount.count_tokens(odd_table(spark), BYTE)
    edits = F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(editcount.sample_edits(F.coalesce("text", F.lit("")), F.col("doc_id")))
    got = editcount.apply_edits(trees, edits, BYTE).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r.n_tokens == len(tool.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_edits == (0 if r.doc_id == 4 else 2)
    assert editcount.apply_edits(editcount.count_tokens(empty_table(spark), BYTE), edits, BYTE).count() == 0
