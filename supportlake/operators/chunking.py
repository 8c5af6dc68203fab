"""Documents to linked, size-limited knowledge chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import markdown as md
from supportlake.functions.text import bind


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 0, other columns kept."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(md.lines(text)).alias("line_no", "line"))


def document_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per heading-scoped prose, table or code segment."""
    kept = [c for c in docs.columns if c != text]
    out = docs.select(*kept, F.posexplode_outer(md.segments(text)).alias("position", "segment"))
    return out.filter(F.col("position").isNotNull()).select(*kept, "position", "segment.path", "segment.kind", "segment.content")


def chunk_documents(docs: DataFrame, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunk drafts of (source, text) documents, neighbours linked by key.

    Everything happens inside the document's row; the only row-count change is
    the final explode, so the plan has no exchange.
    """
    if max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and overlap must be in [0, max_chars)")
    def drafts(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(
            md.chunk_key(F.col("source"), p["path"], p["ordinal"]).alias("source_key"),
            md.chunk_category(p["path"]).alias("category"),
            F.array(md.chunk_question(p["path"])).alias("questions"),
            p["answer"].alias("answer"),
            p["path"].alias("chapter_path"),
            md.classify_content_type(F.col("source"), p["path"]).alias("content_type"),
            md.flag_critical(p["path"], p["answer"]).alias("is_critical"),
        ))

    def linked(items: Column) -> Column:
        return F.transform(items, lambda d, i: F.struct(
            d.alias("draft"),
            F.when(i > 0, F.get(items, i - 1)["source_key"]).alias("previous_source_key"),
            F.get(items, i + 1)["source_key"].alias("next_source_key"),
        ))

    parts = md.numbered_parts(md.segments("text"), max_chars, overlap)
    # The outer explode keeps the optimizer from evaluating the fold a second
    # time as an inferred "array is not empty" filter.
    rows = docs.select("source", F.posexplode_outer(bind(drafts(parts), linked)).alias("position", "item"))
    return rows.filter(F.col("position").isNotNull()).select(
        "source", F.col("position").cast("bigint").alias("position"),
        "item.draft.*", "item.previous_source_key", "item.next_source_key",
    )


def link_neighbors(chunks: DataFrame, source: str, position: str, key: str) -> DataFrame:
    """Previous and next key by (source, position) for chunks that come as rows.

    Positions of a source are 0..n-1, so the neighbours are equi joins on
    position +- 1 and no source, however large, is gathered in one task.
    """
    here = chunks.select(source, position, F.col(key).alias("__key"))
    before = here.select(source, (F.col(position) + 1).alias(position), F.col("__key").alias("previous_source_key"))
    after = here.select(source, (F.col(position) - 1).alias(position), F.col("__key").alias("next_source_key"))
    return chunks.join(before, [source, position], "left").join(after, [source, position], "left")
