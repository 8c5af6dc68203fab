"""Answer guarding, ledgers, routing and run logs on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from supportlake.operators import guard as gd
from supportlake.operators import logs as lg
from supportlake.operators import merge as mg
from supportlake.operators import routing as ro


def outputs(spark, values, columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return frame.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


def test_intents_are_strict(spark):
    values = [
        '{"intent":"物流","confidence":0.9}', '{"confidence":1,"intent":"其他"}', '{"intent":"物流","confidence":true}', '{"intent":"物流","confidence":"0.9"}',
        '{"intent":"物流","intent":"订单","confidence":0.9}', '{"intent":"天气","confidence":0.9}', '{"intent":"物流","confidence":1.1}',
        '{"intent":"物流","confidence":0.9,"x":1}', '[1]', '{"intent":"物流","confidence":0.9} tail', None, '{"intent":"物流","confidence":1e-1}',
    ]
    got = outputs(spark, values, ro.parse_intents("v"))
    assert [r["intent"] for r in got] == ["物流", "其他", *[None] * 9, "物流"]
    assert got[0]["confidence"] == 0.9 and got[1]["confidence"] == 1.0 and got[11]["confidence"] == 0.1
    assert got[2]["intent_error"] == got[3]["intent_error"] == "confidence_not_a_number"


def test_reference_must_keep_unresolved_question(spark):
    values = ['{"question":"new","reference_resolved":true}', '{"question":"old","reference_resolved":false}', '{"question":"new","reference_resolved":false}', '{"question":" ","reference_resolved":true}', '{"question":"new","reference_resolved":1}']
    got = outputs(spark, values, ro.parse_reference("v", F.lit("old")))
    assert [(r["resolved_question"], r["reference_resolved"]) for r in got] == [("new", True), ("old", False), ("old", False), ("old", False), ("old", False)]


def test_routes(spark):
    frame = spark.createDataFrame([("物流", 0.54), ("物流", 0.55), ("其他", 0.9), (None, None)], "intent string, confidence double")
    got = [(r["route"], r["stop_reason"]) for r in ro.route_turns(frame).collect()]
    assert got == [("other", "low_intent_confidence"), ("business", None), ("other", "other_intent"), (None, "invalid_intent")]


def test_only_whole_status_questions_override(spark):
    values = ["还在保吗？", "请问订单DEMO-1001的现在还在保吗", "退款进度", "退款进度怎么样？能退吗", "保修期还有多久", "DEMO-1001 在保", "商品是否在保修期内"]
    got = outputs(spark, values, {"o": ro.route_overrides("v", F.lit("high_risk"), F.lit(False))})
    assert [r["o"] for r in got] == ["business", "business", "business", "high_risk", "business", "high_risk", "business"]


def test_order_reference_follows_history(spark):
    schema = "conversation_id string, id long, question string, resolved_question string, reference_resolved boolean, previous_order string"
    rows = [
        ("a", 1, "demo-1001 好吗", "demo-1001 好吗", True, None), ("a", 2, "它呢", "DEMO-1001 呢", True, None), ("a", 3, "它呢", "DEMO-1002 呢", True, None),
        ("a", 4, "它呢", "它呢", False, None), ("a", 5, "DEMO-1002", "DEMO-1001", True, None), ("a", 6, "它呢", "它呢", True, None),
        ("b", 1, "它呢", "它呢", True, "DEMO-1003"), ("b", 2, "DEMO-1001 DEMO-1002", "x", True, None), ("c", 1, "它呢", "它呢", True, None),
    ]
    out = {(r["conversation_id"], r["id"]): r for r in ro.resolve_order_id(spark.createDataFrame(rows, schema)).collect()}
    got = {k: r["order_id"] for k, r in out.items()}
    assert got == {
        ("a", 1): "DEMO-1001", ("a", 2): "DEMO-1001", ("a", 3): None, ("a", 4): None, ("a", 5): "DEMO-1002", ("a", 6): None,
        ("b", 1): "DEMO-1003", ("b", 2): None, ("c", 1): None,
    }
    assert out[("a", 5)]["resolver_conflict"] and out[("a", 5)]["resolved_question"] == "DEMO-1002" and not out[("a", 5)]["reference_resolved"]


def test_ticket_classes_and_state(spark):
    values = ["请帮我创建工单", "帮我建个工单吗？", "如何创建工单", "我不想建工单", "取消工单", "不要取消工单", "“取消工单”", "工单", ""]
    got = outputs(spark, values, {"o": ro.ticket_request_class("v")})
    assert [r["o"] for r in got] == ["explicit", "none", "none", "cancel", "cancel", "none", "none", "none", "none"]
    rows = [("a", 1, "取消工单"), ("a", 2, "请帮我创建工单"), ("b", 3, "请帮我创建工单"), ("b", 4, "工单取消吧"), ("c", 5, "取消工单"), ("d", 6, "请帮我创建工单"), ("d", 7, "取消工单"), ("d", 8, "麻烦提交工单")]
    frame = spark.createDataFrame([(*r, "user") for r in rows], "conversation_id string, id long, content string, role string")
    state = {r["conversation_id"]: (r["status"], r["original_request"]) for r in ro.ticket_intent_state(frame).collect()}
    assert state == {"a": ("requested", "请帮我创建工单"), "b": ("cancelled", "请帮我创建工单"), "d": ("requested", "麻烦提交工单")}


def test_generation_parsing_is_lenient_for_flags_only(spark):
    base = {"sufficient": True, "reason": "", "answer": "a [1]", "cited_numbers": [1]}
    values = [json.dumps({**base, **c}) for c in ({}, {"sufficient": "no"}, {"sufficient": 2}, {"sufficient": None}, {"cited_numbers": ["2", 3.0]}, {"cited_numbers": [1.5]}, {"answer": 1}, {"extra": 1})]
    got = outputs(spark, [*values, "", None, "{"], gd.parse_generation("v"))
    bad = "generation_result_schema_invalid"
    assert [r["failure"] for r in got] == [None, None, bad, bad, None, bad, bad, None, "structured_output_missing", "structured_output_missing", "structured_output_parse_error"]
    assert got[1]["sufficient"] is False and got[4]["cited_numbers"] == [2, 3]


def test_citation_predicates(spark):
    rows = [("x [1] [2]", [2, 1, 1]), ("x", []), (" ", []), ("x [7]", [7]), ("x [01]", [1]), ("x [1]", [2])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, d array<long>")
    allowed = F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])
    got = [r["o"] for r in frame.select("i", gd.check_citations("a", "d", allowed).alias("o")).orderBy("i").collect()]
    assert got == [[], ["inline_citations_missing"], ["answer_empty", "inline_citations_missing"], ["inline_citation_not_allowed"], [], ["declared_citations_mismatch"]]


def test_loop_limits(spark):
    rows = [("r", i, f"s{i}", 100) for i in range(1, 9)] + [("q", 1, "s", 5), ("q", 2, "s", 5), ("q", 3, "t", 5)] + [("p", 1, "a", 900), ("p", 2, "b", 200), ("p", 3, "c", 1)]
    frame = spark.createDataFrame(rows, "run_id string, id long, signature string, tokens long").withColumn("id", F.col("id") + F.when(F.col("run_id") == "q", 100).when(F.col("run_id") == "p", 200).otherwise(0))
    out = lg.audit_loop_limits(frame, 6, 1000).orderBy("id").collect()
    assert [r["verdict"] for r in out] == ["executed"] * 6 + ["tool_limit", "stopped", "executed", "repeated_tool", "stopped", "executed", "executed", "token_budget"]


def test_low_confidence_entries(spark):
    known = spark.createDataFrame([("c",)], "conversation_id string")
    rows = [("c", "q", "self_check"), ("c", " ", "self_check"), ("c", "q", "x"), ("d", "q", "user_feedback")]
    good, bad = gd.append_low_confidence(spark.createDataFrame(rows, "conversation_id string, raw_question string, source string"), known)
    assert good.count() == 1 and sorted(r["error"] for r in bad.collect()) == ["invalid_low_confidence_entry"] * 2 + ["unknown_conversation"]


CHUNKS = (
    "id long, source_key string, category string, questions array<string>, answer string, embedding_text string, chapter_path array<string>, "
    "content_type string, is_critical boolean, is_active boolean, previous_chunk_id long, next_chunk_id long, vector_id long, vector_status string, content_hash string"
)
DRAFTS = (
    "source_key string, category string, questions array<string>, answer string, chapter_path array<string>, content_type string, is_critical boolean, "
    "previous_source_key string, next_source_key string, draft_order long"
)


def draft(key, answer, order, before=None, after=None):
    return (key, "c", ["q"], answer, ["c"], "policy", False, before, after, order)


def test_upsert_is_idempotent_and_resets_only_what_changed(spark):
    empty = spark.createDataFrame([], CHUNKS)
    first = spark.createDataFrame([draft("a", "x.", 1, None, "b"), draft("b", "y", 2, "a", "z"), draft("a", "x", 3, None, "b")], DRAFTS)
    one = mg.resolve_neighbors(mg.upsert_drafts(empty, first), first)
    rows = {r["source_key"]: r for r in one.collect()}
    assert (rows["b"]["id"], rows["a"]["id"], rows["a"]["answer"]) == (1, 2, "x")
    assert rows["a"]["next_chunk_id"] == 1 and rows["b"]["previous_chunk_id"] == 2 and rows["b"]["next_chunk_id"] is None
    vectors = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, vector_id long")
    done = mg.mark_vectorized(one, vectors)
    assert mg.pending_chunks(done).count() == 0
    again = {r["source_key"]: r for r in mg.upsert_drafts(done, first).collect()}
    assert {k: (r["id"], r["vector_id"], r["vector_status"]) for k, r in again.items()} == {"a": (2, 2, "vectorized"), "b": (1, 1, "vectorized")}
    edited = spark.createDataFrame([draft("a", "x!", 1), draft("n", "new", 2)], DRAFTS)
    after = {r["source_key"]: r for r in mg.upsert_drafts(done, edited).collect()}
    assert after["a"]["vector_id"] is None and after["a"]["content_hash"] == again["a"]["content_hash"]
    assert after["n"]["id"] == 3 and after["b"]["vector_id"] == 1


def test_retired_document_comes_back_pending(spark):
    first = spark.createDataFrame([draft("doc:s:1", "x", 1), draft("doc:s:2", "y", 2)], DRAFTS)
    stored = mg.mark_vectorized(mg.upsert_drafts(spark.createDataFrame([], CHUNKS), first), spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, vector_id long"))
    sources = spark.createDataFrame([("s",)], "source string")
    gone = mg.retire_missing_documents(stored, sources, first.filter("source_key = 'doc:s:1'"))
    assert [(r["id"], r["stale"]) for r in gone.filter("NOT is_active").collect()] == [(2, True)]
    cleared = mg.clear_vectors(gone.drop("stale"), gone.filter("stale"))
    assert cleared.filter("id = 2").first()["vector_id"] is None
    back = mg.upsert_drafts(cleared, first).filter("id = 2").first()
    assert back["is_active"] and back["vector_status"] == "pending"
    assert {r["source"] for r in mg.registered_sources(cleared).collect()} == {"s"}


def test_sync_plan_and_commit(spark):
    chunks = spark.createDataFrame([(1, "h1", True), (2, "h2", True), (3, "h3", False), (4, "h4", True)], "id long, content_hash string, is_active boolean")
    sync = spark.createDataFrame([(1, "h1"), (2, "old"), (3, "h3"), (9, "h9")], "chunk_id long, content_hash string")
    plan = mg.sync_plan(chunks, sync)
    assert {r["chunk_id"]: r["action"] for r in plan.collect()} == {1: "keep", 2: "upsert", 3: "delete", 4: "upsert", 9: "delete"}
    moved = chunks.withColumn("content_hash", F.when(F.col("id") == 4, "h5").otherwise(F.col("content_hash")))
    state = {r["chunk_id"]: r["content_hash"] for r in mg.commit_sync(sync, plan, moved).collect()}
    assert state == {1: "h1", 2: "h2"}
    assert tuple(mg.sync_counts(plan).first()) == (3, 2, 2)


def test_vector_rows_are_checked(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "t", "c"), (2, [1.0], "t", "c"), (3, [nan, 1.0], "t", "c"), (4, [inf, 1.0], "t", "c"), (5, [1.0, 1.0], "é" * 32768, "c"), (6, [1.0, 1.0], "t", "x" * 513), (7, [1.0, 1.0], "t", "c"), (7, [1.0, 1.0], "t", "c"), (8, None, "t", "c")]
    frame = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, text string, category string")
    got = sorted((r["chunk_id"], r["problem"] or "") for r in mg.validate_vectors(frame, 2).collect())
    assert got == [(1, ""), (2, "dimension"), (3, "not_finite"), (4, "not_finite"), (5, "text_bytes"), (6, "category_bytes"), (7, "duplicate_id"), (7, "duplicate_id"), (8, "dimension")]


@pytest.mark.parametrize("status,resolution,error", [("已解决", "ok", None), ("已解决", " ", "resolution_required"), ("已解决", "x" * 301, "resolution_required"), ("未解决", None, None), ("done", "ok", "invalid_disposition")])
def test_case_resolution(spark, status, resolution, error):
    ledger = spark.createDataFrame([("E1", "未解决", None, None)], "eval_id string, status string, resolution string, resolved_at string")
    decisions = spark.createDataFrame([("E1", status, resolution), ("E9", "未解决", None)], "eval_id string, status string, resolution string")
    out, errors = gd.resolve_cases(ledger, decisions, F.lit("now"))
    found = {r["eval_id"]: r["error"] for r in errors.collect()}
    assert found["E9"] == "unknown_case" and found.get("E1") == error
    assert out.first()["resolution"] == ("ok" if error is None and status == "已解决" else None)
