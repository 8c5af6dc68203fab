"""Logical inputs of the operators, derived by Spark from the given tables.

``CTE`` holds the same derivations in SQL, so an oracle can start from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.session import path_exists, run_dir
from supportlake.sources.tables import read_input, spread

# Message ids leave room for a billion turns per conversation.
TURNS = 1_000_000_000
TOOL_CALL = '[{"name":"query_order"}]'


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows; some answers become tool calls or tool results so those paths run."""
    raw = read_input(spark, sf, "conversations")
    pick = (F.col("conv_id") + F.col("turn")) % 11
    assistant = F.col("role") == "assistant"
    role = (
        F.when((F.col("role") == "system") | (assistant & (pick == 1)), "tool").otherwise(F.col("role"))
    )
    return raw.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        role.alias("role"),
        F.col("text").alias("content"),
        F.when(assistant & (pick == 3), F.lit(TOOL_CALL)).alias("tool_calls"),
        F.when(role == "tool", F.concat(F.lit("call-"), F.col("turn").cast("string"))).alias("tool_call_id"),
    )


def cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Every third conversation was already read up to its third message."""
    raw = read_input(spark, sf, "conversations").select("conv_id").distinct()
    return raw.filter(F.col("conv_id") % 3 == 0).select(
        F.col("conv_id").cast("string").alias("conversation_id"), (F.col("conv_id") * TURNS + 2).alias("last_message_id")
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation rows with owners, dates and anchors."""
    raw = read_input(spark, sf, "conversations").select("conv_id").distinct()
    return raw.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("user-"), (F.col("conv_id") % 7).cast("string")).alias("user_id"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("created_at"),
        F.when(F.col("conv_id") % 4 == 0, F.col("conv_id") * TURNS + 1).alias("summary_upto_msg_id"),
        F.when(F.col("conv_id") % 5 == 0, F.col("conv_id") * TURNS + 2).alias("layer1_from_msg_id"),
        (F.col("conv_id") * TURNS + 900_000_000).alias("current_id"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_input(spark, sf, "documents")


def documents_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work that is heavy per text."""
    return spread(documents(spark, sf), "doc_id")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that stands for a stored one: written once per application.

    Merges and searches start from tables that exist. Written to the shared
    folder, they are read by every step instead of being derived again.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED or not path_exists(spark, _STORED[key]):
        path = run_dir(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored_in_buckets(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """As ``stored``, for a table that ``build`` writes in buckets of a key (``bucketed``), so that joins by it do not move it."""
    at = (spark.sparkContext.applicationId, sf, name)
    files = _TABLES[at].inputFiles() if at in _TABLES else []  # a file per bucket
    if not files or not path_exists(spark, files[0]):
        _TABLES[at] = build()
    return _TABLES[at]


def content_type_of(source: Column) -> Column:
    """Three content types over the document sources."""
    number = F.regexp_extract(source, r"(\d+)", 1).cast("int") % 3
    return F.when(number == 0, "product_faq").when(number == 1, "after_sales").otherwise("policy")


def chunk_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """One draft per document: the source is its category, neighbours share it."""
    docs = documents_spread(spark, sf)
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", "lang", F.concat(F.lit("doc:"), name, F.lit(":0")).alias("source_key"),
        F.concat(F.col("lang"), F.lit(" / "), F.col("source")).alias("category"),
        F.array(F.concat(F.lit("About "), F.col("source"))).alias("questions"),
        F.col("text").alias("answer"),
        F.array("lang", "source").alias("chapter_path"),
        content_type_of(F.col("source")).alias("content_type"),
        F.lit(False).alias("is_critical"),
        F.lit(None).cast("string").alias("previous_source_key"),
        F.lit(None).cast("string").alias("next_source_key"),
        F.col("doc_id").alias("draft_order"),
    )


CTE = {
    "messages": f"""messages AS (
  SELECT conv_id * {TURNS} + turn AS id, CAST(conv_id AS VARCHAR) AS conversation_id,
    CASE WHEN role = 'system' OR (role = 'assistant' AND (conv_id + turn) % 11 = 1) THEN 'tool' ELSE role END AS role,
    text AS content,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 11 = 3 THEN '{TOOL_CALL}' END AS tool_calls,
    CASE WHEN role = 'system' OR (role = 'assistant' AND (conv_id + turn) % 11 = 1) THEN 'call-' || turn END AS tool_call_id
  FROM conversations)""",
    "cursors": f"""cursors AS (
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id * {TURNS} + 2 AS last_message_id
  FROM conversations WHERE conv_id % 3 = 0)""",
    "convs": f"""convs AS (
  SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conversation_id, 'user-' || (conv_id % 7) AS user_id,
    '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at,
    CASE WHEN conv_id % 4 = 0 THEN conv_id * {TURNS} + 1 END AS summary_upto_msg_id,
    CASE WHEN conv_id % 5 = 0 THEN conv_id * {TURNS} + 2 END AS layer1_from_msg_id,
    conv_id * {TURNS} + 900000000 AS current_id
  FROM conversations)""",
    # Per user message: first qualifying answer before the next user message.
    "user_turns": """grouped AS (
  SELECT *, max(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conversation_id ORDER BY id) AS turn_start FROM messages),
user_turns AS (
  SELECT conversation_id, turn_start AS user_message_id,
    min(CASE WHEN role = 'assistant' AND tool_calls IS NULL AND trim(content) <> '' THEN id END) AS assistant_message_id,
    lead(turn_start) OVER (PARTITION BY conversation_id ORDER BY turn_start) AS next_user_id
  FROM grouped WHERE turn_start IS NOT NULL GROUP BY conversation_id, turn_start)""",
}


def with_cte(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[name] for name in names) + "\n"
