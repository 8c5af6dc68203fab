"""Checking generated answers, and the two quality ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import jsonval as js
from supportlake.functions import text as tx
from supportlake.operators.scan import first_per_key

# Refusal text, reasons, source labels and case states.
REFUSAL = "抱歉，现有知识库没有足够证据回答这个问题，我无法确认。建议联系人工客服核实。"
REASON_EVIDENCE = "检索证据为空或低于校准阈值"
REASON_FORMAT = "生成输出无法解析或不符合结构约束"
REASON_INSUFFICIENT = "生成自评证据不足"
REASON_CITATIONS = "答案引用缺失、越界或与声明不一致"
LOW_CONFIDENCE_SOURCES = ("retrieval_low_conf", "self_check", "user_feedback")
OPEN_STATE = "未解决"
CASE_STATES = (OPEN_STATE, "已解决", "无需解决")
MAX_RESOLUTION = 300
TRUE_WORDS = ("true", "1", "1.0", "yes", "on", "t", "y")
FALSE_WORDS = ("false", "0", "0.0", "no", "off", "f", "n")


def parse_generation(raw: Column | str) -> dict[str, Column]:
    """Typed fields of a generation, or the class of what is wrong with it.

    Booleans and numbers are read leniently ("yes", 1, "2"), text is not.
    """
    raw = tx._c(raw)

    def build(v: Column) -> Column:
        word = F.lower(js.value(v, "$.sufficient", "string"))
        scalar = js.kind(v, "$.sufficient").rlike("^(BOOLEAN|STRING|BIGINT|DECIMAL|DOUBLE)")
        sufficient = F.when(scalar & word.isin(*TRUE_WORDS), True).when(scalar & word.isin(*FALSE_WORDS), False)
        numbers = F.transform(
            js.value(v, "$.cited_numbers", "array<variant>"),
            lambda n: F.regexp_extract(F.try_variant_get(n, "$", "string"), r"^\s*([+-]?\d+)(?:\.0*)?\s*$", 1).try_cast("bigint"),
        )
        typed = (
            js.is_object(v) & sufficient.isNotNull() & js.is_string(v, "$.reason") & js.is_string(v, "$.answer")
            & numbers.isNotNull() & ~F.exists(numbers, lambda n: n.isNull())
        )
        failure = (
            F.when(raw.isNull() | tx.is_blank(raw), "structured_output_missing")
            .when(v.isNull(), "structured_output_parse_error")
            .when(~F.coalesce(typed, F.lit(False)), "generation_result_schema_invalid")
        )
        return F.struct(
            failure.alias("failure"), sufficient.alias("sufficient"), js.value(v, "$.reason", "string").alias("reason"),
            js.value(v, "$.answer", "string").alias("answer"), numbers.alias("cited_numbers"),
        )

    out = js.read_object(raw, build)
    fields = {f: F.when(out["failure"].isNull(), out[f]) for f in ("sufficient", "reason", "answer", "cited_numbers")}
    return {"failure": out["failure"], **fields}


def inline_numbers(answer: Column | str) -> Column:
    """Distinct [n] marks of an answer; marks too long for a bigint become -1."""
    found = F.regexp_extract_all(tx._c(answer), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.coalesce(n.try_cast("bigint"), F.lit(-1).cast("bigint"))))


def check_citations(answer: Column | str, declared: Column | str, allowed: Column | str) -> Column:
    """Failed predicates of an answer's citations, in fixed order; empty if all hold."""
    inline = inline_numbers(answer)
    declared, allowed = F.array_distinct(tx._c(declared)), tx._c(allowed)
    failed = [
        F.when(tx.is_blank(answer), "answer_empty"),
        F.when(F.size(inline) == 0, "inline_citations_missing"),
        F.when(F.size(F.array_except(inline, allowed)) > 0, "inline_citation_not_allowed"),
        F.when(
            (F.size(F.array_except(inline, declared)) > 0) | (F.size(F.array_except(declared, inline)) > 0),
            "declared_citations_mismatch",
        ),
    ]
    return F.array_compact(F.array(*failed))


def guard_answers(rows: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Decide per row whether the answer may be shown.

    Rows: strategy, evidence_numbers array<bigint>, top_score, raw. The first
    matching rule wins: evidence, format, self-judged sufficiency, citations.
    """
    if not 0 <= min_score <= 1:
        raise ValueError("the rerank threshold must be in [0, 1]")
    parsed = rows.withColumns({f"g_{name}": c for name, c in parse_generation("raw").items()})
    failed = check_citations("g_answer", "g_cited_numbers", "evidence_numbers")
    parsed = parsed.withColumn("failed_predicates", F.when(F.col("g_failure").isNull() & F.col("g_sufficient"), failed))
    weak = (F.size("evidence_numbers") == 0) | (
        (F.col("strategy") == "hybrid_rerank") & F.coalesce(F.col("top_score") < min_score, F.lit(True))
    )
    stated = F.when(F.col("g_reason") != "", F.col("g_reason")).otherwise(F.lit(REASON_INSUFFICIENT))
    reason = (
        F.when(weak, REASON_EVIDENCE)
        .when(F.col("g_failure").isNotNull(), REASON_FORMAT)
        .when(~F.col("g_sufficient"), stated)
        .when(F.size("failed_predicates") > 0, REASON_CITATIONS)
        .otherwise(F.lit(""))
    )
    refused = weak | F.col("g_failure").isNotNull() | ~F.col("g_sufficient") | (F.size("failed_predicates") > 0)
    refused = F.coalesce(refused, F.lit(True))
    source = F.when(weak, "retrieval_low_conf").when(refused, "self_check").otherwise("")
    predicates = F.when(~weak & F.col("g_failure").isNotNull(), F.array("g_failure")).when(~weak, F.col("failed_predicates"))
    return parsed.select(
        *rows.columns,
        F.when(refused, F.lit(REFUSAL)).otherwise(F.col("g_answer")).alias("answer"),
        refused.alias("refused"), reason.alias("refusal_reason"), source.alias("refusal_source"),
        F.coalesce(predicates, F.array().cast("array<string>")).alias("failed_predicates"),
    )


def protocol_failures(guarded: DataFrame) -> DataFrame:
    """Rows for the failure log: generations that broke the output protocol."""
    return guarded.filter(F.size("failed_predicates") > 0)


def append_low_confidence(entries: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) low-confidence questions; rejected rows say why.

    Conversations are looked up salted, as one may own most entries.
    """
    from supportlake.operators.merge import flag_member

    checked = flag_member(
        entries, F.col("conversation_id"), conversations, "conversation_id", "__known", "raw_question"
    ).withColumn(
        "error",
        F.when(
            ~F.coalesce(F.col("source").isin(*LOW_CONFIDENCE_SOURCES), F.lit(False)) | F.coalesce(tx.is_blank("raw_question"), F.lit(True)),
            "invalid_low_confidence_entry",
        ).when(~F.col("__known"), "unknown_conversation"),
    ).drop("__known")
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


_CASE_FIELDS = ("bucket", "query", "strategy", "answer", "reason", "citations", "judge_model")


def upsert_faith_cases(ledger: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Ledger after recording fabrications; the last row (highest ``seq``) of an id wins.

    A known case counts up, is seen now and reopens without its resolution.
    """
    counts = found.groupBy("eval_id").agg(F.count("*").alias("__n"))
    last = first_per_key(found, ["eval_id"], "seq", last=True).select(
        "eval_id", *[F.col(c).alias(f"new_{c}") for c in _CASE_FIELDS]
    ).join(counts, "eval_id")
    both = ledger.join(last, "eval_id", "full_outer")
    hit = F.col("__n").isNotNull()
    return both.withColumns({
        **{c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in _CASE_FIELDS},
        "seen_count": (F.coalesce("seen_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("bigint"),
        "first_seen_at": F.coalesce("first_seen_at", now),
        "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")),
        "status": F.when(hit, F.lit(OPEN_STATE)).otherwise(F.col("status")),
        "resolution": F.when(~hit, F.col("resolution")),
    }).select(*ledger.columns)


def resolve_cases(ledger: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger, errors) after decisions (eval_id, status, resolution), one per case."""
    text = tx.strip(F.coalesce("new_resolution", F.lit("")))
    wanted = decisions.select("eval_id", F.col("status").alias("new_status"), F.col("resolution").alias("new_resolution"))
    checked = wanted.join(ledger.select("eval_id", F.lit(True).alias("__known")), "eval_id", "left").withColumn(
        "error",
        F.when(~F.coalesce(F.col("new_status").isin(*CASE_STATES), F.lit(False)), "invalid_disposition")
        .when((F.col("new_status") != OPEN_STATE) & ~F.length(text).between(1, MAX_RESOLUTION), "resolution_required")
        .when(F.col("__known").isNull(), "unknown_case"),
    )
    good = checked.filter(F.col("error").isNull()).select("eval_id", "new_status", text.alias("new_resolution"))
    closes = F.col("new_status").isNotNull() & (F.col("new_status") != OPEN_STATE)
    out = ledger.join(good, "eval_id", "left").withColumns({
        "resolution": F.when(closes, F.col("new_resolution")).when(F.col("new_status").isNull(), F.col("resolution")),
        "resolved_at": F.when(closes, now).otherwise(F.col("resolved_at")),
        "status": F.coalesce("new_status", "status"),
    })
    return out.select(*ledger.columns), checked.filter(F.col("error").isNotNull()).select("eval_id", "error")


def list_cases(ledger: DataFrame, status: str | None = None) -> DataFrame:
    out = ledger if not status else ledger.filter(F.col("status") == status)
    return out.orderBy(F.desc("last_seen_at"), "eval_id")


def detect_fabrication(rows: DataFrame) -> DataFrame:
    """Reranked answers below full faithfulness that no foreign error explains away."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    own = no_error | F.coalesce(F.col("error_stage") == "correctness_judge", F.lit(False))
    return rows.filter((F.col("strategy") == "hybrid_rerank") & (F.col("faithfulness") < 1) & own)
