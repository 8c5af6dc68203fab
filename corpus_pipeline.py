"""A corpus from documents to token ids: language, near-duplicates, repeated passages, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm import encode, langid, minhash, mixing, rlz
from supportlake.llm.queries import tokenizer_path
from supportlake.session import materialize
from supportlake.sources.tables import read_input

#: Some stages have no SQL form; tests compare the run with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without a letter and ambiguous ones go. Learns from the rows not held out."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify_languages(docs, model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs)).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier; a document of repeated words alone goes."""
    cut = rlz.remove_repeats(docs)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = left.withColumn("text", F.col("clean_text"))
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source brought to the same share of characters, by Poisson replication; copies are rows of their own."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token ids and digests of ids and decoded text."""
    return encode.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), keep_text=False)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", mix),
    ("bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written and read again before the next."""
    docs = read_input(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
