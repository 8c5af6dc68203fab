"""Run logs and tool audits: latest runs, usage, permissions, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.operators.merge import flag_member
from supportlake.operators.scan import first_per_key, ordered_lists, running

# Log event names and the write tool.
DOWNGRADE_PREFIX = "层1 降级"
MODEL_CONTEXT_EVENT = "model_ctx"
WRITE_TOOL = "create_ticket"


def latest_run_per_conversation(runs: DataFrame, order: str) -> DataFrame:
    """Last log record of each conversation by a unique integer order."""
    return first_per_key(runs, ["conversation_id"], order, last=True)


def first_positive(*cols: Column) -> Column:
    """First positive value among several spellings of a usage field."""
    return F.coalesce(*[F.when(c > 0, c) for c in cols])


def measured_usage(total: Column, input_estimate: Column, output_estimate: Column) -> dict[str, Column]:
    """Tokens of a call: measured where the provider gave a positive total."""
    measured = F.coalesce(total > 0, F.lit(False))
    return {
        "tokens": F.when(measured, total).otherwise(input_estimate + output_estimate).cast("bigint"),
        "estimated": ~measured,
    }


def usage_rollup(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens by keys and stage with subtotals. Runs: keys, usage array<struct<stage,tokens,estimated>>."""
    rows = runs.select(*keys, F.explode("usage").alias("u")).select(*keys, "u.stage", "u.tokens", "u.estimated")
    estimated = F.sum(F.when(F.col("estimated"), F.col("tokens")).otherwise(0))
    return rows.rollup(*keys, "stage").agg(
        F.sum("tokens").alias("tokens"), estimated.alias("estimated_tokens"), F.count("*").alias("calls"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def context_log_report(log: DataFrame, keys: list[str]) -> DataFrame:
    """Downgrades, summaries and the largest model input per group."""
    return log.groupBy(*keys).agg(
        F.count_if(F.col("event").startswith(DOWNGRADE_PREFIX)).alias("downgrades"),
        F.count_if(F.col("event") == "summary done").alias("summaries"),
        F.max(F.when(F.col("event") == MODEL_CONTEXT_EVENT, F.col("tokens"))).alias("max_input_tokens"),
    )


def audit_status_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tool_name", "source", "status").agg(
        F.count("*").alias("calls"), F.sum("retry_count").alias("retries"), F.count_if(F.col("retry_count") > 0).alias("retried_calls"),
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    )


def permission_join(calls: DataFrame, policy: DataFrame, salt_by: str) -> DataFrame:
    """Permission per call: builtin tools by name, external ones only if listed as read.

    Policy: server, tool_name, permission. The lookup is salted by a column of
    many values, as one tool may take most calls.
    """
    pair = F.concat_ws("\x00", "source", "tool_name")
    listed = policy.filter(F.col("permission") == "read").select(
        F.concat_ws("\x00", F.concat(F.lit("mcp:"), "server"), "tool_name").alias("pair")
    )
    flagged = flag_member(calls, pair, listed, "pair", "__read", salt_by)
    builtin = F.col("source") == "builtin"
    permission = (
        F.when(builtin & (F.col("tool_name") == WRITE_TOOL), "write").when(builtin | F.col("__read"), "read").otherwise("deny")
    )
    return flagged.withColumn("permission", permission).drop("__read")


def classify_calls(calls: DataFrame) -> DataFrame:
    """One status and error class per call, first matching rule wins.

    Calls: registered, arguments_valid, permission, ticket_requested, confirmed,
    already_submitted, outcome ∈ {ok, empty, timeout, error}.
    """
    denied = (F.col("permission") == "deny") | (
        (F.col("permission") == "write") & ~(F.col("ticket_requested") & F.col("confirmed"))
    )
    repeated = (F.col("permission") == "write") & F.col("already_submitted")
    status = (
        F.when(~F.col("registered"), "permission_denied").when(~F.col("arguments_valid"), "validation_blocked")
        .when(denied | repeated, "permission_denied").when(F.col("outcome") == "ok", "success")
        .when(F.col("outcome") == "timeout", "timeout").otherwise("failed")
    )
    error = (
        F.when(~F.col("registered"), "permission_denied").when(~F.col("arguments_valid"), "invalid_arguments")
        .when(denied | repeated, "permission_denied").when(F.col("outcome") == "empty", "not_found")
        .when(F.col("outcome") != "ok", "execution_error")
    )
    return calls.withColumns({"status": status, "error_class": error})


def audit_loop_limits(
    calls: DataFrame, max_calls: int = 6, max_tokens: int = 12000, run: str = "run_id", order: str = "id"
) -> DataFrame:
    """Replay tool calls of each run against the limits; ``verdict`` per call.

    Before the first violation every call ran, so a call's position is the
    number of calls made. The first violation names its reason, later calls of
    the run are stopped. Calls: run, order (unique integer), signature, tokens.
    """
    firsts = calls.groupBy(run, "signature").agg(F.min(order).alias("__first"))
    counted = running(
        calls, [run], order,
        {"calls_before": ("sum", F.lit(1).cast("bigint")), "tokens_before": ("sum", F.col("tokens"))}, inclusive=False,
    )
    # Joining on the salted order keeps one much repeated signature spread out.
    repeats = calls.select(run, "signature", F.col(order)).join(
        firsts.withColumnRenamed("__first", order), [run, "signature", order], "left_anti"
    ).select(order, F.lit(True).alias("__again"))
    flagged = counted.join(repeats, order, "left")
    reason = (
        F.when(F.col("__again"), "repeated_tool").when(F.col("calls_before") >= max_calls, "tool_limit")
        .when(F.col("tokens_before") >= max_tokens, "token_budget")
    )
    marked = flagged.withColumn("__reason", reason)
    judged = running(marked, [run], order, {"__stops_before": ("sum", F.when(F.col("__reason").isNotNull(), 1).otherwise(0))}, inclusive=False)
    verdict = F.when(F.col("__stops_before") > 0, "stopped").when(F.col("__reason").isNotNull(), F.col("__reason")).otherwise("executed")
    return judged.withColumn("verdict", verdict).drop("__again", "__reason", "__stops_before")


def dedup_writes(calls: DataFrame, order: str) -> DataFrame:
    """First write per (conversation, tool call id)."""
    return first_per_key(calls, ["conversation_id", "tool_call_id"], order)


def fold_run_events(events: DataFrame) -> DataFrame:
    """One row per run: answer text, tool names, previews, errors and nodes in order.

    Events: run_id, id (unique integer), event, content, tool_name, node, preview, message. A run
    is one answered turn; its text has to be one value in the result. Events are put together by blocks of ids.
    """
    def of(kind: str, field: str) -> Column:
        return F.when(F.col("event") == kind, F.col(field))

    folded = ordered_lists(
        events, ["run_id"], "id",
        {
            "answer": of("token", "content"), "tool_names": of("tool_status", "tool_name"), "previews": of("ticket_preview", "preview"),
            "error_messages": of("error", "message"), "workflow_nodes": of("workflow_status", "node"),
        },
        {"has_error_event": F.col("event") == "error"},
    )
    return folded.select(
        "run_id", F.array_join("answer", "").alias("answer"), "tool_names", "previews", "has_error_event", "error_messages", "workflow_nodes"
    )
