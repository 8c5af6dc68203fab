"""Relational tables with fixed schemas; never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _S, _D, _I, _B, _TS = (
    T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Logical tables of the support application.
APPLICATION_SCHEMAS: dict[str, T.StructType] = {
    "faq": _schema(id=_L, question=_S, answer=_S, category=_S, created_at=_TS),
    "conversations": _schema(
        conversation_id=_S, id=_L, user_id=_S, status=_S, created_at=_TS,
        summary_upto_msg_id=_L, layer1_from_msg_id=_L,
    ),
    "messages": _schema(
        id=_L, conversation_id=_S, role=_S, content=_S, citations=_S, actions=_S,
        tool_calls=_S, tool_call_id=_S, created_at=_TS,
    ),
    "tickets": _schema(
        ticket_no=_S, conversation_id=_S, description=_S, ticket_type=_S, status=_S, created_at=_TS,
    ),
    "refund_applications": _schema(
        request_id=_S, conversation_id=_S, message_id=_L, user_id=_S, order_id=_S,
        request_type=_S, reason=_S, status=_S,
    ),
    "knowledge_chunks": _schema(
        id=_L, source_key=_S, category=_S, questions=T.ArrayType(_S), answer=_S, embedding_text=_S,
        chapter_path=T.ArrayType(_S), content_type=_S, is_critical=_B, is_active=_B,
        previous_chunk_id=_L, next_chunk_id=_L, vector_id=_L, vector_status=_S, content_hash=_S,
    ),
    "knowledge_qa_staging": _schema(
        id=_L, source_user_message_id=_L, source_assistant_message_id=_L, category=_S,
        questions=T.ArrayType(_S), answer=_S, fingerprint=_S, run_id=_S, promoted_at=_TS,
    ),
    "knowledge_extraction_cursor": _schema(conversation_id=_S, last_message_id=_L),
    "low_confidence_questions": _schema(
        conversation_id=_S, raw_question=_S, source=_S, reason=_S, created_at=_TS,
    ),
    "faith_cases": _schema(
        eval_id=_S, bucket=_S, query=_S, strategy=_S, answer=_S, reason=_S, citations=_S, judge_model=_S,
        status=_S, seen_count=_L, first_seen_at=_TS, last_seen_at=_TS, resolution=_S, resolved_at=_TS,
    ),
    "knowledge_hybrid_sync": _schema(collection=_S, chunk_id=_L, content_hash=_S),
    "conversation_summaries": _schema(
        conversation_id=_S, segment=_L, from_msg_id=_L, upto_msg_id=_L, content=_S,
    ),
    "tool_audit_logs": _schema(
        id=_L, conversation_id=_S, tool_call_id=_S, tool_name=_S, source=_S, arguments=_S,
        result_summary=_S, status=_S, error=_S, retry_count=_L, duration_ms=_D, created_at=_TS,
    ),
    "tool_write_receipts": _schema(conversation_id=_S, tool_call_id=_S, status=_S, result=_S),
    "ticket_intents": _schema(
        conversation_id=_S, user_id=_S, operation_id=_S, status=_S, original_request=_S,
    ),
}

# Test tables handed to every registered query.
INPUT_SCHEMAS: dict[str, T.StructType] = {
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "embeddings": _schema(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
    "benchmark": _schema(item_id=_L, text=_S),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "pages": _schema(page_id=_L, url=_S, html=_S),
    "events": _schema(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S),
}


def read_tables(
    spark: SparkSession, folder: str, names: list[str], schemas: dict[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Load ``<folder>/<name>.parquet`` for each name with its declared schema."""
    declared = APPLICATION_SCHEMAS if schemas is None else schemas
    missing = [name for name in names if name not in declared]
    if missing:
        raise KeyError(f"no schema declared for {missing}")
    return {name: spark.read.schema(declared[name]).parquet(f"{folder}/{name}.parquet") for name in names}


def read_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table; TPC-H style tables keep the schema of their own footer."""
    path = f"{folder}/{name}.parquet"
    reader = spark.read.schema(INPUT_SCHEMAS[name]) if name in INPUT_SCHEMAS else spark.read
    return reader.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input of fewer scan tasks than cores before heavy per-row work.

    Scan tasks are bounded by ``spark.sql.files.maxPartitionBytes``, so such an input has at most that many bytes
    per core; any other is spread by its scan and is left alone, however few its files are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
