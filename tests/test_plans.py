"""Physical plans of the queries that must stay spread out."""

import pytest
from pyspark.sql import functions as F

from supportlake.plans.catalog import QUERIES

SPREAD = (
    "chk_chunk_documents", "cnv_pair_turns", "cnv_advance_cursor", "cnv_exact_dedup", "cnv_budget_batches", "ctx_turn_groups",
    "mrg_retire_missing_documents", "mrg_sync_plan", "log_permission_join", "log_audit_loop_limits", "evl_paired_comparisons",
    "ret_dense_topk", "ret_bm25_topk",
)


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPREAD)
def test_no_pairwise_joins(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


ONCE = (
    "cnv_pair_turns", "cnv_advance_cursor", "cnv_budget_batches", "cnv_batch_stats", "cnv_validate_candidates", "ctx_layer1",
    "ctx_layer2_shorten", "ctx_layer2_overflow", "ctx_summary_batch", "ctx_context_view", "log_audit_loop_limits",
)


@pytest.mark.parametrize("name", ONCE)
def test_running_values_do_not_multiply_scans(spark, sf, name):
    text = plan(spark, sf, name)
    print(name, text.count("FileScan parquet"), text.count("conversations.parquet"))
    assert text.count("conversations.parquet") <= 6


def test_top_k_limits_each_task_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "ret_dense_topk")


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(spark, sf, "cnv_pending_conversations")
    assert "text" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "props" not in plan(spark, sf, "log_context_report").split("ReadSchema:")[1].split("\n")[0]


def test_chunk_table_is_joined_in_its_buckets(spark):
    """An upsert moves neither the chunk table nor the drafts: both lie in buckets of the key."""
    from supportlake.operators import merge as mg
    from supportlake.session import bucketed
    from tests.test_guard_routing_logs import CHUNKS

    rows = [("k%d" % i, "c", ["q"], f"a{i}", ["p"], "policy", False, None, None, i) for i in range(300)]
    schema = "source_key string, category string, questions array<string>, answer string, chapter_path array<string>, content_type string, is_critical boolean, previous_source_key string, next_source_key string, draft_order long"
    latest = mg.latest_drafts(spark.createDataFrame(rows + [("k7", *rows[3][1:-1], 999)], schema))
    assert latest.count() == 300 and latest.where("source_key = 'k7'").first().answer == "a3"
    chunks = bucketed(spark.createDataFrame([], CHUNKS), "source_key", "plan_chunks")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = chunks.join(latest.select("source_key", "draft_order"), "source_key", "full_outer")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        merged = mg.upsert_drafts(chunks, latest, latest=True)
        assert sorted(r.id for r in merged.collect()) == list(range(1, 301))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dataset_rules_read_the_cases_twice(spark, sf):
    from supportlake.operators import evaluation as ev
    from supportlake.plans.evaluation_queries import _dataset

    seen = []
    real, ev.materialize = ev.materialize, lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
    try:
        plan = ev.validate_dataset(*_dataset(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        ev.materialize = real
    # The cases for marks and for groups, and the sources once.
    assert sum(text.count("documents.parquet") for text in [*seen, plan]) <= 3


def test_an_upsert_writes_no_texts_and_buckets_are_not_sorted(spark, monkeypatch):
    """chunk tables are written as their rows come, and an upsert is a view that joins digests, not texts."""
    from supportlake.operators import merge as mg
    from supportlake.session import bucketed
    from tests.test_guard_routing_logs import CHUNKS

    rows = [("k%d" % i, "c", ["q"], f"a{i}", ["p"], "policy", False, None, None, i) for i in range(40)]
    schema = "source_key string, category string, questions array<string>, answer string, chapter_path array<string>, content_type string, is_critical boolean, previous_source_key string, next_source_key string, draft_order long"
    latest = mg.latest_drafts(spark.createDataFrame(rows, schema))
    old = mg.upsert_drafts(spark.createDataFrame([], CHUNKS), latest, latest=True).where("id <= 30")
    chunks = bucketed(mg.mark_vectorized(old, spark.createDataFrame([(i, i) for i in range(1, 31)], "chunk_id long, vector_id long")), "source_key", "plain_chunks")
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("plain_chunks"))
    told = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}
    assert told["Bucket Columns"] == "[`source_key`]" and told.get("Sort Columns", "[]") == "[]"
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    wide = []
    monkeypatch.setattr(mg, "bucketed", lambda *a, **b: wide.append(a) or bucketed(*a, **b))
    # k1 changes its answer, k2 only its heading.
    edited = latest.withColumns({"embedding_text": F.when(F.col("source_key") == "k1", "new").otherwise(F.col("embedding_text"))})
    merged = mg.upsert_drafts(chunks, edited, latest=True)
    assert not wide
    found = {r.source_key: r for r in merged.collect()}
    assert [found[f"k{i}"].vector_id for i in (0, 1, 2, 35)] == [1, None, 3, None] and found["k1"].embedding_text == "new"
    assert sorted(r.id for r in found.values()) == list(range(1, 41))
    text = merged.select("source_key", "id", "vector_id")._jdf.queryExecution().executedPlan().toString()
    assert all("answer" not in scan.split("\n")[0] for scan in text.split("ReadSchema:")[1:])
