"""Sinks: versioned snapshots, row journals and the failure log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.session import path_exists


def write_snapshot(df: DataFrame, path: str, keep_pointer: bool = True) -> str:
    """Write a new version folder, then point to it; readers never see half a table.

    Plain Parquet has no MERGE, so a merged table is written beside the old one.
    The pointer is one small file set written last; a failed run leaves it as it was.
    """
    version = uuid.uuid4().hex
    target = f"{path}/versions/{version}"
    df.write.parquet(target)
    if keep_pointer:
        spark = df.sparkSession
        sequence = F.lit(next_sequence(spark, path))
        pointer = spark.range(1).select(F.lit(version).alias("version"), sequence.cast("bigint").alias("sequence"))
        pointer.coalesce(1).write.mode("append").json(f"{path}/pointer")
    return target


POINTER = "version string, sequence bigint"


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    if not path_exists(spark, f"{path}/pointer"):
        return None
    return spark.read.schema(POINTER).json(f"{path}/pointer")


def next_sequence(spark: SparkSession, path: str) -> int:
    found = _pointers(spark, path)
    return 1 if found is None else (found.agg(F.max("sequence")).first()[0] or 0) + 1


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest complete version, or None before the first write."""
    found = _pointers(spark, path)
    if found is None:
        return None
    version = found.orderBy(F.desc("sequence")).first()["version"]
    return spark.read.parquet(f"{path}/versions/{version}")


def write_rows_jsonl(df: DataFrame, path: str) -> None:
    """Journal rows as JSON lines; NULL fields stay visible."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


# Fields of a failure record, in order.
FAILURE_FIELDS = (
    "occurred_at", "conversation_key", "model_identity", "question", "strategy", "evidence", "raw_text",
    "parse_error_type", "inline_numbers", "declared_numbers", "allowed_numbers", "failed_predicates",
)


def append_failure_log(failures: DataFrame, path: str) -> None:
    """Append protocol failures with question, evidence and failed predicates."""
    columns = [F.col(f) if f in failures.columns else F.lit(None).cast("string").alias(f) for f in FAILURE_FIELDS]
    write_rows_jsonl(failures.select(*columns), path)
