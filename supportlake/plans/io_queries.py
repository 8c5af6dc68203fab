"""Registered queries: file sources, sinks and streaming jobs over the given tables.

Files and streams are written by Spark under the shared folder first, so each
of these reads back what it is meant to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.operators import chunking
from supportlake.operators import guard as gd
from supportlake.plans import adapters as ad
from supportlake.plans.evaluation_queries import evaluation_rows
from supportlake.plans.guard_queries import _GUARD, generations
from supportlake.plans.merge_queries import _STATE, _chunks
from supportlake.plans.conversation_queries import _PAIRS, FINGERPRINT_SQL
from supportlake.plans.registry import query
from supportlake.session import run_dir
from supportlake.sources import files, sinks
from supportlake.sources.tables import read_input
from supportlake.streaming import jobs


@query("src_read_jsonl", """SELECT event_id, event_type AS route, CAST(CASE WHEN event_id % 50 = 7 THEN 'malformed_json' WHEN event_id % 50 = 8 THEN 'missing:run_id' WHEN event_id % 50 = 9 THEN 'type:tokens' END AS VARCHAR) AS problem
    FROM events WHERE event_id % 50 <> 6""")
def src_read_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    row = {"run_id": F.concat(F.lit("r"), n.cast("string")), "route": F.col("event_type"), "message_id": n, "tokens": n % 100}
    def line(**changes) -> Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in {**row, **changes}.items() if c is not None]))
    text = (
        F.when(n % 50 == 6, " ").when(n % 50 == 7, F.concat(F.lit("{bad "), n.cast("string"), F.lit(" "), F.col("event_type")))
        .when(n % 50 == 8, line(run_id=None)).when(n % 50 == 9, line(tokens=F.lit("many"))).otherwise(line())
    )
    path = run_dir(spark, "jsonl")
    read_input(spark, sf, "events").select(text.alias("value")).write.text(path)
    good, bad = files.read_jsonl(spark, path, files.RUN_LOG_SCHEMA, ("run_id",))
    rejected = bad.select(
        F.coalesce(F.get_json_object("value", "$.message_id"), F.regexp_extract("value", r"(\d+)", 1)).cast("bigint").alias("event_id"),
        F.coalesce(F.get_json_object("value", "$.route"), F.regexp_extract("value", r"(\w+)$", 1)).alias("route"), "problem",
    )
    fine = good.select(F.col("message_id").alias("event_id"), "route", F.lit(None).cast("string").alias("problem"))
    return fine.unionByName(rejected)


@query("src_read_cases", """WITH u AS (SELECT DISTINCT user_id AS n FROM events)
    SELECT CASE WHEN n % 17 = 3 THEN 'same' ELSE 'c' || n END AS id, CASE WHEN n % 17 = 3 AND (SELECT count(*) FROM u WHERE n % 17 = 3) > 1 THEN 'duplicate_id' WHEN n % 5 = 1 THEN 'steps_missing' WHEN n % 5 = 2 THEN 'invalid_step' END AS problem FROM u""")
def src_read_cases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("user_id")
    message = F.struct(F.lit("message").alias("kind"), F.lit("hello").alias("message"), F.lit(None).cast("boolean").alias("approve"))
    confirm = F.struct(F.lit("confirmation").alias("kind"), F.lit(None).cast("string").alias("message"), F.when(n % 5 != 2, True).alias("approve"))
    steps = F.when(n % 5 == 1, F.slice(F.array(message), 1, 0)).otherwise(F.array(message, confirm))
    case = F.to_json(F.struct(F.when(n % 17 == 3, "same").otherwise(F.concat(F.lit("c"), n.cast("string"))).alias("id"), steps.alias("steps")))
    path = run_dir(spark, "cases")
    users = read_input(spark, sf, "events").select("user_id").distinct()
    # Every case file is one JSON array over several lines: a file per partition, each with the cases of its users.
    arrays = users.groupBy((n % 64).alias("part")).agg(F.array_sort(F.collect_list(case)).alias("cases"))
    arrays.select("part", F.concat(F.lit("[\n"), F.array_join("cases", ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("part").text(path)
    return files.read_cases(spark, path).select("id", "problem")


@query("src_read_markdown", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc ' || doc_id || '+ü.md' ELSE 'doc-' || doc_id || '.md' END AS source, text FROM documents WHERE text IS NOT NULL AND text <> '')
    SELECT source, length(text) AS n_chars, sha256(text) AS text_sha FROM d""")
def src_read_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Markdown file of its own, with notes of another kind beside them, read back by ``read_markdown``."""
    folder = f"{run_dir(spark, 'markdown')}"
    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc "), n, F.lit("+ü.md"))).otherwise(F.concat(F.lit("doc-"), n, F.lit(".md")))
    docs = ad.documents(spark, sf).where("text is not null and text <> ''").select(name.alias("name"), F.col("text").alias("body"))
    notes = docs.limit(3).select(F.regexp_replace("name", "md$", "txt").alias("name"), "body")
    written = write_files(docs.unionByName(notes), folder)
    assert written
    return files.read_markdown(spark, folder).select("source", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes ``body`` of each row to the file ``name`` of a folder, inside tasks; the number of files."""
    import pyarrow as pa

    def write(batches):
        from pyarrow import fs

        # The path names the store; executors reach it as Spark does.
        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(path, recursive=True)
        n = 0
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


@query("snk_write_snapshot", _STATE + "SELECT id, hash AS content_hash, is_active FROM stored")
def snk_write_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "snapshot")
    chunks = _chunks(spark, sf).select("id", "content_hash", "is_active")
    sinks.write_snapshot(chunks.limit(0), path)
    sinks.write_snapshot(chunks, path)
    return sinks.read_snapshot(spark, path)


@query("snk_write_rows_jsonl", "SELECT 'E' || doc_id AS eval_id, unnest(['dense', 'bm25', 'hybrid', 'hybrid_rerank']) AS strategy FROM labels JOIN documents USING (doc_id)")
def snk_write_rows_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "rows")
    rows = evaluation_rows(spark, sf)
    sinks.write_rows_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path).select("eval_id", "strategy")


@query("snk_append_failure_log", _GUARD + "SELECT id, failed FROM guarded WHERE failed <> ''")
def snk_append_failure_log(spark: SparkSession, sf: str) -> DataFrame:
    path = run_dir(spark, "failures")
    failures = gd.protocol_failures(gd.guard_answers(generations(spark, sf), 0.3))
    sinks.append_failure_log(failures.select(
        F.col("id").cast("string").alias("conversation_key"), F.col("t").alias("question"), "strategy", F.col("raw").alias("raw_text"), "failed_predicates",
    ), path)
    back = spark.read.schema("conversation_key string, failed_predicates array<string>").json(path)
    return back.select(F.col("conversation_key").cast("bigint").alias("id"), F.array_join("failed_predicates", ",").alias("failed"))


# --- streams ---------------------------------------------------------------


def split_stream(spark: SparkSession, rows: DataFrame, name: str, parts: int = 3, order: str = "id") -> DataFrame:
    """The rows as a file stream of several micro-batches, about in the order of ``order``.

    Empty tasks write no file, so a batch may take a few files of the next part: jobs must not rely on the cut.
    """
    path = run_dir(spark, name)
    files = spark.sparkContext.defaultParallelism  # of each part, written by as many tasks
    bounds = rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000).alias("b")).first()["b"]
    previous = None
    for upper in [*sorted(set(bounds)), None]:
        part = rows if previous is None else rows.filter(F.col(order) > previous)
        part = part if upper is None else part.filter(F.col(order) <= upper)
        part.repartition(files, order).write.mode("append").parquet(path)
        previous = upper
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def arrival_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages by arrival: turn by turn over all conversations, so that batches cut them."""
    return ad.messages(spark, sf).withColumn("arrival", (F.col("id") % ad.TURNS) * 1_000_000 + F.floor(F.col("id") / ad.TURNS))


@query("str_pair_turns", _PAIRS + " SELECT conversation_id, user_message_id, assistant_message_id FROM pairs")
def str_pair_turns(spark: SparkSession, sf: str) -> DataFrame:
    base = run_dir(spark, "pair-turns")
    stream = split_stream(spark, arrival_messages(spark, sf), "pair-input", order="arrival").drop("arrival")
    jobs.wait(jobs.stream_pair_turns(stream, f"{base}/out", f"{base}/state", f"{base}/checkpoint"))
    out = spark.read.parquet(f"{base}/out")
    return out.select("conversation_id", "user_message_id", "assistant_message_id")


@query("str_redact")
def str_redact(spark: SparkSession, sf: str) -> DataFrame:
    base = run_dir(spark, "redact")
    messages = ad.messages(spark, sf).select("id", "content")
    jobs.wait(jobs.stream_redact(split_stream(spark, messages, "redact-input"), f"{base}/out", f"{base}/checkpoint"))
    return spark.read.schema("id bigint, content string").parquet(f"{base}/out")


@query("str_dedup_writes", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS conversation_id, props AS tool_call_id FROM events")
def str_dedup_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Writes in the order of their time, an hour of lateness: a write that is repeated later than that is a new one, so keys are counted once."""
    base = run_dir(spark, "dedup")
    calls = read_input(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("conversation_id"), F.col("props").alias("tool_call_id")
    )
    stream = split_stream(spark, calls.withColumn("at", F.unix_micros("ts")), "dedup-input", order="at").drop("at")
    jobs.wait(jobs.stream_dedup_writes(stream, f"{base}/out", f"{base}/checkpoint", "1 hour"))
    return spark.read.schema(calls.schema).parquet(f"{base}/out").select("conversation_id", "tool_call_id").distinct()


_REDACTED_FP = FINGERPRINT_SQL.format(
    "'copies' || chr(10) || 'q' || chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '[0-9@_-]', '', 'g'), '(?i)(ord|tkt|ticket|case)', 'x', 'g')"
    " || ' mail [EMAIL], phone [PHONE].', '^\\s+|\\s+$', '', 'g')"
)


@query("str_extract", f"SELECT DISTINCT 'conversation:' || {_REDACTED_FP} AS source_key FROM documents WHERE text IS NOT NULL")
def str_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as candidates with an address and a number of their own, which redaction must take away before texts are compared.

    Characters and words that other patterns could take are removed from the document first, so the oracle knows what stays.
    """
    base = run_dir(spark, "extract")
    n = F.col("doc_id")
    plain = F.regexp_replace(F.regexp_replace("text", "[0-9@_-]", ""), "(?i)(ord|tkt|ticket|case)", "x")
    personal = F.concat(F.lit(" mail u"), (n % 97).cast("string"), F.lit("@example.org, phone 138"), F.lpad((n % 89).cast("string"), 8, "0"), F.lit("."))
    rows = ad.documents(spark, sf).where("text is not null").select(
        n.alias("candidate_id"), F.lit("copies").alias("category"), F.array(F.lit("q")).alias("questions"),
        F.concat(plain, personal).alias("answer"), (n % 2).alias("source_user_message_id"),
    )
    stream = split_stream(spark, rows, "extract-input", order="candidate_id")
    jobs.wait(jobs.stream_extract(stream, f"{base}/staging", f"{base}/promoted", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/promoted").select("source_key")


@query(
    "str_sync_vectors",
    """WITH v AS (SELECT vec_id % 200 AS id, vec_id AS version FROM embeddings), l AS (SELECT id, max(version) AS version FROM v GROUP BY 1)
       SELECT id AS chunk_id, 'h' || (version // 400) AS content_hash FROM l WHERE version % 7 <> 0""",
)
def str_sync_vectors(spark: SparkSession, sf: str) -> DataFrame:
    base = run_dir(spark, "sync")
    n = F.col("vec_id")
    versions = read_input(spark, sf, "embeddings").select(
        (n % 200).alias("id"), n.alias("version"), F.concat(F.lit("h"), F.floor(n / 400).cast("string")).alias("content_hash"), (n % 7 != 0).alias("is_active")
    )
    stream = split_stream(spark, versions, "sync-input", order="version")
    last = jobs.wait(jobs.stream_sync_vectors(stream, f"{base}/state", f"{base}/checkpoint"))
    return jobs.latest_state(spark, f"{base}/state", last)
