"""Evaluation figures by hand, files, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from supportlake.operators import conversations as cv
from supportlake.operators import evaluation as ev
from supportlake.plans import adapters as ad
from supportlake.plans import io_queries as io
from supportlake.plans.catalog import ORACLES, QUERIES
from supportlake.session import run_dir
from supportlake.sources import files, sinks
from supportlake.sources.tables import APPLICATION_SCHEMAS, read_tables
from supportlake.streaming import jobs


def test_metrics_by_hand(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 1), (3, "a", 1)], "query_id long, item string, rank long")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "query_id long, item string")
    out = {r["query_id"]: r for r in ev.retrieval_metrics(asked, ranked, relevant, (1, 3, 5)).collect()}
    one = out[1]
    assert (one["recall_at_1"], one["recall_at_3"], one["recall_at_5"], one["all_evidence_at_3"], one["all_evidence_at_5"], one["mrr"]) == (0.0, 0.5, 1.0, 0.0, 1.0, 0.5)
    assert out[2]["mrr"] == 0.0 and out[2]["recall_at_5"] == 0.0
    assert out[3]["mrr"] is None and out[3]["recall_at_1"] is None and out[3]["all_evidence_at_1"] is None


def test_calibration_needs_both_classes_and_takes_lowest(spark):
    schema = "split string, strategy string, error string, should_refuse boolean, top_score double"
    rows = [("calibration", "hybrid_rerank", None, False, 0.9), ("calibration", "hybrid_rerank", None, True, None), ("test", "hybrid_rerank", None, True, 1.0), ("calibration", "hybrid_rerank", "x", False, 0.0)]
    best = ev.calibrate_threshold(spark.createDataFrame(rows, schema)).first()
    assert (best["threshold"], best["balanced_accuracy"], best["calibration_cases"]) == (0.05, 1.0, 2)
    assert ev.calibrate_threshold(spark.createDataFrame(rows[:1], schema)).count() == 0


def test_correctness_verdicts(spark):
    fact = "struct<index:int,covered:boolean,contradicted:boolean,reason:string>"
    rows = [
        ([(1, True, False, "b"), (0, True, False, "a")], 2, False, False), ([(0, True, True, "a"), (1, False, False, "b")], 2, False, False),
        ([(0, True, False, "a"), (0, True, False, "b")], 2, False, False), ([], 0, False, False), ([], 0, True, True), ([], 2, False, True),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, f array<{fact}>, n int, s boolean, r boolean")
    got = frame.select("i", *[c.alias(k) for k, c in ev.correctness_score("f", "n", "s", "r").items()]).orderBy("i").collect()
    assert [(r["score"], r["fact_coverage"], r["error"]) for r in got] == [
        (1.0, 1.0, None), (0.0, 0.0, None), (None, None, "missing_or_duplicate_fact_index"), (None, None, "facts_required"), (1.0, None, None), (0.0, None, None),
    ]
    assert got[1]["reason"] == "a；b"


def test_case_outcomes_keep_expected_checks_of_failed_steps(spark):
    expected = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("c", 2, "z"), ("d", 1, "x")], "case_id string, step int, check string")
    actual = spark.createDataFrame([("c", 1, "x", True), ("c", 2, "y", True), ("d", 1, "x", True)], "case_id string, step int, check string, ok boolean")
    steps = spark.createDataFrame([("c", 1, None, 1), ("c", 2, "Boom", 0), ("d", 1, None, -1), ("e", 1, None, 0)], "case_id string, step int, error string, ticket_delta long")
    out = ev.case_outcomes(expected, actual, steps)
    got = {r["case_id"]: (r["status"], r["n_checks"], r["n_passed"], r["passed"]) for r in out.collect()}
    assert got == {"c": ("error", 4, 1, False), "d": ("completed", 2, 2, True), "e": ("completed", 1, 1, True)}
    total = ev.outcome_summary(out).first()
    assert (total["passed"], total["tickets_created_total"], total["cases_with_ticket_created"]) == (2, 1, 1)


def test_corpus_digest_ignores_order_and_sees_edits(spark):
    rows = [(f"k{i}", f"text {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "source_key string, answer string")
    digest = ev.corpus_digest(frame).first()
    assert ev.corpus_digest(frame.repartition(7).orderBy(F.rand(1))).first() == digest
    for column in ("source_key", "answer"):  # a NULL is seen, in any row
        hidden = frame.withColumn(column, F.when(F.col("source_key") != "k3", F.col(column)))
        assert ev.corpus_digest(hidden).first() not in (digest, ev.corpus_digest(frame.where("source_key <> 'k3'")).first())
    kept = [("a", digest["n_chunks"], digest["digest"]), ("b", 1, digest["digest"]), ("c", digest["n_chunks"], "x"), ("d", None, None)]
    manifest = frame.sparkSession.createDataFrame(kept, "name string, n_chunks long, digest string")
    status = {r["name"]: r["status"] for r in ev.check_manifest(ev.corpus_digest(frame), manifest).collect()}
    assert status == {"a": "same", "b": "count_differs", "c": "digest_differs", "d": "count_differs"}
    assert ev.corpus_digest(frame.withColumn("answer", F.when(F.col("source_key") == "k3", "x").otherwise(F.col("answer")))).first() != digest


def test_latency_quantiles(spark, sf):
    values = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value").collect():
        values.setdefault(r[0], []).append(r[1])
    for r in QUERIES["evl_latency_quantiles"](spark, sf).collect():
        ordered = sorted(values[r["strategy"]])
        assert [r["p50"], r["p95"]] == [ordered[-(-len(ordered) // 2) - 1], ordered[-(-len(ordered) * 95 // 100) - 1]]


def test_latency_quantiles_are_exact_for_large_groups_and_odd_values(spark, sf, tmp_path):
    n = 1_200_001
    value = F.when(F.col("id") % 3 == 0, F.rand(5) * 1e-3).otherwise(F.exp(F.randn(6)))
    hot = spark.range(n).select(F.lit("hot").alias("event_type"), value.alias("value"))
    odd = [(None, 2.0), (None, 1.0), ("one", 7.0), ("void", None), ("gaps", 1.0), ("gaps", None), ("gaps", None), ("same", 3.0), ("same", 3.0)]
    events = spark.read.parquet(f"{sf}/events.parquet").limit(0)
    small = spark.createDataFrame(odd, "event_type string, value double")
    events.unionByName(hot.unionByName(small), allowMissingColumns=True).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["strategy"]: (r["p50"], r["p95"]) for r in QUERIES["evl_latency_quantiles"](spark, str(tmp_path)).collect()}
    kept = spark.read.parquet(f"{tmp_path}/events.parquet").where("event_type = 'hot'").select("value").toArrow().column(0).to_numpy()
    ordered = sorted(kept)
    assert got.pop("hot") == (ordered[-(-n // 2) - 1], ordered[-(-n * 95 // 100) - 1])
    assert got == {None: (1.0, 2.0), "one": (7.0, 7.0), "void": (None, None), "gaps": (None, None), "same": (3.0, 3.0)}


def test_jsonl_rejects_carry_line_numbers(spark, tmp_path):
    lines = ['{"run_id":"a","tokens":1}', "", "{bad", '{"tokens":1}', '{"run_id":"b","tokens":"many"}', '["x"]']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    good, bad = files.read_jsonl(spark, str(tmp_path / "log.jsonl"), files.RUN_LOG_SCHEMA, ("run_id",))
    assert [r["run_id"] for r in good.collect()] == ["a"]
    assert {(r["line"], r["problem"]) for r in bad.collect()} == {(3, "malformed_json"), (4, "missing:run_id"), (5, "type:tokens"), (6, "malformed_json")}


def test_many_markdown_files_share_few_tasks(spark, tmp_path, monkeypatch):
    """the scan deals 32 files to a partition; tasks take several of these."""
    for i in range(200):
        (tmp_path / f"n {i}+ü.md").write_text(f"text {i}")
    monkeypatch.setattr(files, "TASKS_PER_CORE", 1)
    plain = spark.read.option("pathGlobFilter", "*.md").text(str(tmp_path), wholetext=True)
    read = files.read_markdown(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < plain.rdd.getNumPartitions()
    assert {(r.source, r.text) for r in read.collect()} == {(f"n {i}+ü.md", f"text {i}") for i in range(200)}


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "b é+1.md").write_text("# B\nx")
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "c.txt").write_text("no")
    rows = files.read_markdown(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["text"]) for r in rows] == [("a.md", "# A"), ("b é+1.md", "# B\nx")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_markdown(spark, str(tmp_path / "none"))


def test_markdown_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 7)
    monkeypatch.setattr(files, "READ_BYTES", 64)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "other.md").write_text("elsewhere")
    odd = {"a b+ü%20#?.md": "ä\r\n\ufeff😀\n".encode(), "bad.md": b"no \xff utf-8", "_x=1.md": b"kept", **{f"n{i}.md": b"text %d" % i for i in range(60)}}
    for name, text in {**odd, "empty.md": b"", "_x.md": b"hidden", ".y.md": b"hidden", "z.MD": b"other", "z.md.txt": b"other"}.items():
        (tmp_path / name).write_bytes(text)
    def rows(frame):
        return sorted((r.source, bytes(r.text)) for r in frame.select("source", F.col("text").cast("binary").alias("text")).collect())
    read = files.read_markdown(spark, str(tmp_path))
    assert not [f for f in read.inputFiles() if f.endswith(".md")]
    assert rows(read) == rows(files.scan_markdown(spark, str(tmp_path))) == sorted(odd.items())
    # Patterns, single files and partitioned folders are left to Spark's scan.
    assert rows(files.read_markdown(spark, f"{tmp_path}/s*b")) == rows(files.read_markdown(spark, f"{tmp_path}/sub/other.md")) == [("other.md", b"elsewhere")]
    (tmp_path / "parts" / "lang=en").mkdir(parents=True)
    (tmp_path / "parts" / "lang=en" / "p.md").write_text("part")
    assert rows(files.read_markdown(spark, f"file://{tmp_path}/parts")) == [("p.md", b"part")]
    (tmp_path / "void").mkdir()
    (tmp_path / "void" / "empty.md").write_text("")
    with pytest.raises(FileNotFoundError):
        files.read_markdown(spark, str(tmp_path / "void"))


def test_case_files(spark, tmp_path):
    cases = [
        {"id": "a", "steps": [{"kind": "message", "message": "hi"}, {"kind": "confirmation", "approve": True}]}, {"id": "a", "steps": [{"kind": "message", "message": "x"}]},
        {"id": "b", "steps": []}, {"id": "c", "steps": [{"kind": "confirmation"}]}, {"id": "d", "steps": [{"kind": "jump"}]}, {"steps": []}, {"id": "e", "steps": [{"kind": "message", "message": "x"}]},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    got = sorted((r["id"] or "", r["problem"] or "") for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect())
    assert got == [("", "id_missing"), ("a", "duplicate_id"), ("a", "duplicate_id"), ("b", "steps_missing"), ("c", "invalid_step"), ("d", "invalid_step"), ("e", "")]


def test_snapshots_point_to_the_last_version(spark):
    path = run_dir(spark, "snap")
    assert sinks.read_snapshot(spark, path) is None
    for n in (1, 2, 3):
        sinks.write_snapshot(spark.range(n), path)
    assert sinks.read_snapshot(spark, path).count() == 3


def test_tables_keep_their_schema(spark, tmp_path):
    spark.createDataFrame([], APPLICATION_SCHEMAS["messages"]).write.parquet(str(tmp_path / "messages.parquet"))
    assert read_tables(spark, str(tmp_path), ["messages"])["messages"].schema == APPLICATION_SCHEMAS["messages"]
    with pytest.raises(KeyError):
        read_tables(spark, str(tmp_path), ["nothing"])


def test_streamed_pairs_equal_batch_pairs(spark, sf):
    columns = ["conversation_id", "user_message_id", "assistant_message_id"]
    streamed = QUERIES["str_pair_turns"](spark, sf).select(*columns)
    batch = cv.pair_turns(ad.messages(spark, sf)).select(*columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_answers_may_come_after_later_questions(spark):
    from supportlake.session import run_dir

    base = run_dir(spark, "late")
    schema = "id long, conversation_id string, role string, content string, tool_calls string, tool_call_id string"
    batches = [
        [(1, "c", "user", "q1", None, None)], [(3, "c", "user", "q2", None, None)],
        [(2, "c", "assistant", "a1", None, None), (4, "c", "assistant", "a2", None, None)],
        [(5, "c", "assistant", "more", None, None), (7, "c", "user", "q3", None, None)], [(8, "c", "assistant", "a3", None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.wait(jobs.stream_pair_turns(stream, f"{base}/out", f"{base}/state", f"{base}/checkpoint"))
    got = sorted((r["user_message_id"], r["assistant_message_id"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, 2), (3, 4), (7, 8)]


def test_streamed_redaction_equals_batch(spark, sf):
    want = {r["id"]: r["redacted"] for r in QUERIES["txt_redact_messages"](spark, sf).collect()}
    assert {r["id"]: r["content"] for r in QUERIES["str_redact"](spark, sf).collect()} == want


def test_extraction_stream_redacts_and_resumes(spark):
    base = run_dir(spark, "resume")
    schema = "candidate_id long, category string, questions array<string>, answer string, source_user_message_id long"
    rows = [(1, "c", ["q"], "mail a@b.cc", 1), (2, "c", ["q"], "mail x@y.zz", 2), (3, "c", ["q"], "other", 3)]
    path = f"{base}/in"
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.wait(jobs.stream_extract(stream, f"{base}/staging", f"{base}/promoted", f"{base}/checkpoint"))
    staged = spark.read.parquet(f"{base}/staging")
    assert sorted(r["answer"] for r in staged.collect()) == ["mail [EMAIL]", "mail [EMAIL]", "other"]
    assert spark.read.parquet(f"{base}/promoted").count() == 2


def test_split_stream_covers_all_rows(spark, sf):
    base = run_dir(spark, "cover")
    rows = ad.messages(spark, sf).select("id")
    stream = io.split_stream(spark, rows, "cover-in")
    stream.writeStream.format("parquet").option("path", f"{base}/o").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{base}/o").count() == rows.count()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
