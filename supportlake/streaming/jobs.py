"""Structured Streaming jobs built from the batch operators.

Every job runs with ``availableNow``: it takes what is new since its checkpoint
and stops, which is what a scheduled job does. Fingerprints live in Spark's state
store (RocksDB); the sync state is change files that a reader merges; waiting
questions are snapshots in the shared folder. A micro-batch that is run again
writes its own files again, so retries are safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from supportlake.functions import text as tx
from supportlake.operators import conversations as cv
from supportlake.operators import merge as mg
from supportlake.session import materialize, path_exists
from supportlake.sources.sinks import read_snapshot, write_snapshot

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a fingerprint's rows that are reduced before they meet.
SALTS = 64
#: Folders of the sync state by hash of the chunk id, and batches between two compactions.
SYNC_BUCKETS = 32
COMPACT_EVERY = 16


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _append_new(rows: DataFrame, path: str, batch: int) -> None:
    """One folder per batch, overwritten if the batch is run again."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stream_pair_turns(messages: DataFrame, output: str, state: str, checkpoint: str) -> StreamingQuery:
    """Pair turns as messages arrive; a question without an answer waits for it, also when later questions came first.

    Answers may arrive late, questions may not: a question must not arrive after messages that follow it. The state is
    the questions without an answer and the question after each of them, which ends its turn. All state is looked up by
    message id, so a long conversation is as spread out here as in the batch operator.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        waiting = read_snapshot(spark, f"{state}/{number - 1}") if number > 0 else None
        fresh = batch.withColumn("__paired", F.lit(False))
        rows = fresh if waiting is None else fresh.unionByName(waiting)
        plain = rows.drop("__paired")
        paired = rows.filter("__paired").select(F.col("id").alias("user_message_id"))
        turns = materialize(cv.user_turns(plain).join(paired, "user_message_id", "left_anti"), "stream-turns")
        pairs = cv.with_texts(turns.filter(F.col("assistant_message_id").isNotNull()).drop("next_user_id"), plain)
        _append_new(pairs, output, number)
        unanswered = turns.filter(F.col("assistant_message_id").isNull())
        wanted = unanswered.select(F.col("user_message_id").alias("id"), F.lit(False).alias("__ends")).unionByName(
            unanswered.filter(F.col("next_user_id").isNotNull()).select(F.col("next_user_id").alias("id"), F.lit(True).alias("__ends"))
        ).groupBy("id").agg(F.min("__ends").alias("__paired"))
        held = plain.join(wanted, "id").select(*plain.columns, "__paired")
        write_snapshot(held, f"{state}/{number}")
        batch.unpersist()

    return _start(messages, handle, checkpoint)


def stream_redact(messages: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Redacted copy of a message stream: a stateless projection."""
    clean = messages.withColumn("content", tx.redact_pii("content"))
    return (
        clean.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_dedup_writes(calls: DataFrame, output: str, checkpoint: str, lateness: str = "1 hour") -> StreamingQuery:
    """First write per (conversation, tool call id) within the lateness; ``ts`` is event time.

    A row that comes later than ``lateness`` behind the newest of earlier batches is dropped, and counted (``dropped_late_rows``); a repeated
    write is recognised for at least that long.
    """
    unique = calls.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["conversation_id", "tool_call_id"])
    return _append(unique, output, checkpoint)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the heap; the session's own setting is put back."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _first_seen(stream: DataFrame, keys: list[str], arrived: str | None, expiry: str | None) -> DataFrame:
    if arrived is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(arrived, expiry).dropDuplicatesWithinWatermark(keys)


def stage_stream(
    candidates: DataFrame, staging: str, checkpoint: str, redact: bool = True, arrived: str | None = None, expiry: str | None = None
) -> StreamingQuery:
    """Staged candidates as an append-only table: the first of each (fingerprint, source user message) that the state has seen."""
    clean = candidates if not redact else candidates.withColumns({
        "category": tx.redact_pii("category"), "questions": F.transform("questions", tx.redact_pii), "answer": tx.redact_pii("answer"),
    })
    keyed = clean.withColumn("fingerprint", tx.fingerprint("category", "questions", "answer"))
    return _append(_first_seen(keyed, ["fingerprint", "source_user_message_id"], arrived, expiry), staging, checkpoint)


def promote_stream(staged: DataFrame, promoted: str, checkpoint: str, arrived: str | None = None, expiry: str | None = None) -> StreamingQuery:
    """Drafts of fingerprints that were never promoted. A fingerprint of very many rows is reduced to SALTS rows before these meet."""
    salted = staged.withColumn("__salt", F.pmod(F.xxhash64("candidate_id"), F.lit(SALTS)))
    few = _first_seen(salted, ["fingerprint", "__salt"], arrived, expiry).drop("__salt")
    fresh = few.dropDuplicates(["fingerprint"]) if arrived is None else few.dropDuplicatesWithinWatermark(["fingerprint"])
    drafts = fresh.select(
        F.concat(F.lit("conversation:"), "fingerprint").alias("source_key"), "category", "questions", "answer",
        F.array("category").alias("chapter_path"), F.lit("conversation_qa").alias("content_type"), F.lit(False).alias("is_critical"),
        F.col("candidate_id").alias("draft_order"), F.col("fingerprint").alias("content_hash"),
    )
    return _append(drafts, promoted, checkpoint)


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with rocksdb_state(rows.sparkSession):
        return writer.outputMode("append").trigger(availableNow=True).start()


def stream_extract(
    candidates: DataFrame, staging: str, promoted: str, checkpoint: str, redact: bool = True, arrived: str | None = None, expiry: str | None = None
) -> StreamingQuery:
    """Stage candidates and promote new knowledge; both remember fingerprints in Spark's state store and read no earlier output.

    Candidates: candidate_id, source_user_message_id, category, questions, answer. Of copies that arrive in one batch any one is
    staged. The promoting stream reads each staged file once. With ``arrived`` (an event time column) and ``expiry`` the state forgets
    what is older, from the batch after the one that moves the watermark; without them it keeps every fingerprint. ``redact=False`` is for candidates that were redacted before.
    """
    spark = candidates.sparkSession
    stage_stream(candidates, staging, f"{checkpoint}/stage", redact, arrived, expiry).awaitTermination()
    kept = candidates.schema.add("fingerprint", "string")
    staged = spark.readStream.schema(kept).parquet(staging)
    return promote_stream(staged, promoted, f"{checkpoint}/promote", arrived, expiry)


def _sync_bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SYNC_BUCKETS)).cast("int")


_CHANGES = "chunk_id bigint, content_hash string, action string, batch bigint, bucket int"


def _sync_state(spark: SparkSession, state: str, upto: int, buckets: list[int] | None = None) -> DataFrame:
    """(chunk_id, content_hash) after batch ``upto``: the newest compacted table before it, and the last change of each chunk since."""
    based = f"{state}/compacted"
    bases = [r.batch for r in spark.read.schema("batch bigint").json(f"{based}/list").where(F.col("batch") <= upto).collect()] if path_exists(spark, f"{based}/list") else []
    base = max(bases, default=-1)  # one line per compaction
    found = None
    for path, since in ((f"{based}/batch={base}", None), (f"{state}/changes", base)):
        if (since is None and base < 0) or not path_exists(spark, path):
            continue
        rows = spark.read.schema(_CHANGES if since is not None else _CHANGES.replace("batch bigint, ", "")).parquet(path)
        rows = rows.where((F.col("batch") > since) & (F.col("batch") <= upto)) if since is not None else rows.withColumn("batch", F.lit(base).cast("bigint"))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "chunk_id bigint, content_hash string")
    last = found.groupBy("chunk_id").agg(F.max(F.struct("batch", "action", "content_hash")).alias("c"))
    return last.where("c.action = 'upsert'").select("chunk_id", F.col("c.content_hash").alias("content_hash"))


def stream_sync_vectors(chunks: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep the sync state in step with chunk versions that arrive on a stream.

    Rows: id, version (unique, increasing), content_hash, is_active. The last version of a chunk in a batch counts. A batch writes
    what it changes, as files by bucket of the chunk id, after reading the buckets it touches; a reader merges them
    (``latest_state``). Every COMPACT_EVERY batches the merged table is written once more, so that readers meet few files.
    """
    def handle(batch: DataFrame, number: int) -> None:
        from supportlake.operators.scan import first_per_key

        spark = batch.sparkSession
        latest = materialize(first_per_key(batch, ["id"], "version", last=True), "sync-batch")
        ids = latest.select(F.col("id").alias("chunk_id"))
        buckets = [r.b for r in ids.select(_sync_bucket("chunk_id").alias("b")).distinct().collect()]  # at most SYNC_BUCKETS
        # Only chunks of this batch may be deleted; the rest is not in sight.
        touched = _sync_state(spark, state, number - 1, buckets).join(ids, "chunk_id", "left_semi")
        changed = mg.sync_plan(latest, touched).where("action <> 'keep'").withColumn("bucket", _sync_bucket("chunk_id"))
        changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/changes/batch={number}")
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            whole = _sync_state(spark, state, number).select("*", F.lit("upsert").alias("action"), _sync_bucket("chunk_id").alias("bucket"))
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/compacted/batch={number}")
            # Listed when it is whole; a line of a batch that is run again is the same line.
            spark.range(1).select(F.lit(number).cast("bigint").alias("batch")).coalesce(1).write.mode("append").json(f"{state}/compacted/list")

    return _start(chunks, handle, checkpoint)


def latest_state(spark: SparkSession, state: str, number: int) -> DataFrame:
    """(chunk_id, content_hash) after batch ``number`` of ``stream_sync_vectors``."""
    return _sync_state(spark, state, number)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped in all batches of a finished job that are still in its progress log."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def wait(query: StreamingQuery) -> int:
    """Run a job to its end; the number of its last batch (-1 if nothing was new)."""
    query.awaitTermination()
    progress = query.lastProgress
    return progress["batchId"] if progress else -1
