"""Streams whose state is Spark's own, or change files: restarts, late rows, bytes written."""

import datetime as dt

from pyspark.sql import functions as F

from supportlake.plans.catalog import QUERIES
from supportlake.session import run_dir
from supportlake.streaming import jobs

CANDIDATES = "candidate_id long, category string, questions array<string>, answer string, source_user_message_id long"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_fingerprints_survive_restarts(spark):
    base = run_dir(spark, "restart")
    parts = [[(i, "c", ["q"], f"text {i % 4}", i % 3) for i in range(k, k + 6)] for k in (0, 4, 8, 30)]
    for part in parts:  # every run is a new query on the same checkpoint
        stream = feed(spark, f"{base}/in", part, CANDIDATES)
        jobs.wait(jobs.stream_extract(stream, f"{base}/staging", f"{base}/promoted", f"{base}/checkpoint"))
    staged = spark.read.parquet(f"{base}/staging")
    every = {(f"text {i % 4}", i % 3) for part in parts for i, *_ in part}
    got = [(r.answer, r.source_user_message_id) for r in staged.collect()]
    assert sorted(got) == sorted(every)
    assert sorted(r.answer for r in spark.read.parquet(f"{base}/promoted").collect()) == [f"text {i}" for i in range(4)]


def test_no_batch_reads_earlier_output(spark):
    base = run_dir(spark, "plans")
    stream = feed(spark, f"{base}/in", [(1, "c", ["q"], "a", 1)], CANDIDATES)
    query = jobs.stage_stream(stream, f"{base}/staging", f"{base}/c")
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    scans = [line for line in plan.split("\n") if "Scan" in line]
    assert "StreamingDeduplicate" in plan and len(scans) == 1 and "/staging" not in scans[0]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # the session's own setting is back
    progress = query.lastProgress["stateOperators"][0]
    assert progress["numRowsTotal"] == 1 and any(k.startswith("rocksdb") for k in progress["customMetrics"])


def test_expired_fingerprints_are_forgotten(spark):
    base = run_dir(spark, "expiry")
    schema = CANDIDATES + ", at timestamp"
    day = dt.datetime(2024, 1, 1)
    for k, hours in enumerate((0, 1, 100, 101)):
        stream = feed(spark, f"{base}/in", [(k, "c", ["q"], "same", 1, day + dt.timedelta(hours=hours))], schema)
        jobs.wait(jobs.stream_extract(stream, f"{base}/staging", f"{base}/promoted", f"{base}/checkpoint", arrived="at", expiry="24 hours"))
    assert sorted(r.candidate_id for r in spark.read.parquet(f"{base}/staging").collect()) == [0, 3]  # the batch that moves the watermark is still compared


def test_late_writes_are_dropped_and_counted(spark):
    base = run_dir(spark, "late-writes")
    schema = "event_id long, ts timestamp, conversation_id string, tool_call_id string"
    start = dt.datetime(2024, 1, 1)
    minutes = lambda m: start + dt.timedelta(minutes=m)
    batches = [[(1, minutes(0), "c", "a"), (2, minutes(300), "c", "b")], [(3, minutes(301), "c", "b"), (4, minutes(10), "c", "late"), (5, minutes(280), "c", "in time")]]
    for rows in batches:
        stream = feed(spark, f"{base}/in", rows, schema)
        query = jobs.stream_dedup_writes(stream, f"{base}/out", f"{base}/checkpoint", "1 hour")
        jobs.wait(query)
    assert sorted(r.event_id for r in spark.read.schema(schema).parquet(f"{base}/out").collect()) == [1, 2, 5]
    assert jobs.dropped_late_rows(query) == 1


def test_sync_state_is_merged_from_changes(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 3)
    base = run_dir(spark, "merge-on-read")
    schema = "id long, version long, content_hash string, is_active boolean"
    state, version, size = {}, 0, []
    for k in range(7):
        rows = []
        for i in range(400 if k == 0 else 5):
            version += 1
            chunk = i if k == 0 else (k * 31 + i * 7) % 420
            rows.append((chunk, version, f"h{version % 50}" if k != 4 else state.get(chunk), (version % 4 != 0) if k != 4 else True))
        for chunk, _, hashed, active in rows:
            state.pop(chunk, None)
            if active:
                state[chunk] = hashed
        stream = feed(spark, f"{base}/in", rows, schema)
        last = jobs.wait(jobs.stream_sync_vectors(stream, f"{base}/state", f"{base}/checkpoint"))
        assert {r.chunk_id: r.content_hash for r in jobs.latest_state(spark, f"{base}/state", last).collect()} == state
        size.append(spark.read.parquet(f"{base}/state/changes").where(F.col("batch") == k).count())
    assert size[0] > 250 and max(size[1:]) <= 5  # a batch writes what it changes, not the state
    assert sorted(r.batch for r in spark.read.json(f"{base}/state/compacted/list").collect()) == [2, 5]
    early = jobs.latest_state(spark, f"{base}/state", 1).count()  # an earlier batch can still be read
    assert early > 200


def test_registered_extraction_redacts(spark, sf):
    keys = [r.source_key for r in QUERIES["str_extract"](spark, sf).collect()]
    assert len(keys) == len(set(keys)) > 100
