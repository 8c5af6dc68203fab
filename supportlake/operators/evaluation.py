"""Scoring retrieval, answers, routing and datasets against labels."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import jsonval as js
from supportlake.functions import text as tx
from supportlake.operators.retrieval import STRATEGIES
from supportlake.session import materialize

# Judge stages, dataset enumerations, thresholds, replay fields.
JUDGE_STAGES = ("faithfulness_judge", "correctness_judge")
REJUDGE_STAGES = ("judge", "faithfulness_judge", "correctness_judge")
BUCKETS = ("A_policy", "B_model", "C_colloquial", "D_unknown", "E_multi")
DIFFICULTIES = ("easy", "medium", "hard")
SPLITS = ("calibration", "test")
MIN_BUCKET_CASES = 60
MAX_EVAL_ID = 16
MAX_QUERY = 512
WIN_MARGIN = 1e-9
REASON_SEPARATOR = "；"
CLAIM_SEPARATOR = "："
NO_CLAIMS = "没有可核查事实声明"
REFUSAL_REASON = "按应否拒答标注核对"
REPLAY_FIELDS = (
    "eval_id", "query", "strategy", "split", "bucket", "difficulty",
    "should_refuse", "required_facts", "answer", "citations", "refused", "metrics",
)
MAX_OUTPUT_CHARS = 250


# --- retrieval metrics -----------------------------------------------------


def metrics_from_flags(hits: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall, all-evidence and MRR per query from hits (query_id, item, rank, relevant)
    and totals (query_id, n_relevant); NULL where a query has nothing relevant."""
    good = F.when(F.col("relevant"), F.col("rank"))
    # One row per distinct relevant item at its first position.
    firsts = hits.groupBy("query_id", "item").agg(F.min(good).alias("r"))
    found = firsts.groupBy("query_id").agg(
        *[F.count_if(F.col("r") <= k).alias(f"__hit{k}") for k in ks], F.min("r").alias("__first")
    )
    n = F.col("n_relevant")
    out = totals.join(found, "query_id", "left")
    columns = []
    for k in ks:
        hit = F.coalesce(f"__hit{k}", F.lit(0))
        columns.append(F.when(n > 0, hit / n).alias(f"recall_at_{k}"))
    for k in ks:
        hit = F.coalesce(f"__hit{k}", F.lit(0))
        columns.append(F.when(n > 0, (hit == n).cast("double")).alias(f"all_evidence_at_{k}"))
    mrr = F.when(n > 0, F.coalesce(1.0 / F.col("__first"), F.lit(0.0))).alias("mrr")
    return out.select("query_id", "n_relevant", *columns, mrr)


def retrieval_metrics(
    queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)
) -> DataFrame:
    """Metrics from labelled pairs. Ranked: query_id, item, rank. Relevant: query_id, item."""
    pairs = relevant.select("query_id", "item").distinct()
    counts = pairs.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    totals = queries.select("query_id").join(counts, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    flagged = ranked.join(pairs.withColumn("__rel", F.lit(True)), ["query_id", "item"], "left")
    return metrics_from_flags(flagged.withColumn("relevant", F.coalesce("__rel", F.lit(False))), totals, ks)


# --- answer summaries ------------------------------------------------------


def has_error(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def metric_available(metric: str) -> Column:
    """Present, and no error or only the other judge's.

    "Field present but NULL" differs from "field absent", so rows carry a
    ``<metric>_error_present`` flag.
    """
    other = (
        F.col(f"{metric}_error_present") & F.col(f"{metric}_error").isNull()
        & F.coalesce(F.col("error_stage").isin(*JUDGE_STAGES), F.lit(False))
    )
    return F.col(metric).isNotNull() & (~has_error(F.col("error")) | F.coalesce(other, F.lit(False)))


def _mean(value: Column, where: Column | None = None) -> Column:
    return F.avg(value if where is None else F.when(where, value))


def summary_aggregates(metrics: tuple[str, ...]) -> list[Column]:
    """All figures of one report row; claims were counted per row before."""
    known, unknown = ~F.col("should_refuse"), F.col("should_refuse")
    faith, correct = F.col("__faith"), F.col("__correct")
    refused = F.col("refused").cast("double")
    claims = F.sum(F.when(faith, F.col("__claims")))
    return [
        F.count("*").alias("cases"),
        F.count_if(has_error(F.col("error"))).alias("error_count"),
        F.count_if(has_error(F.col("faithfulness_error"))).alias("faithfulness_error_count"),
        F.count_if(has_error(F.col("correctness_error"))).alias("correctness_error_count"),
        _mean(F.col("correctness"), correct).alias("answer_accuracy"),
        F.count_if(correct).alias("answer_accuracy_cases"),
        _mean(F.col("fact_coverage"), correct).alias("fact_coverage"),
        F.count("mrr").alias("retrieval_cases"),
        F.count_if(known).alias("known_cases"),
        F.count_if(unknown).alias("unknown_cases"),
        F.avg(tx.is_blank(F.coalesce("answer", F.lit(""))).cast("double")).alias("empty_answer_rate"),
        F.coalesce(claims, F.lit(0)).alias("faithfulness_claims"),
        F.when(claims > 0, F.sum(F.when(faith, F.col("__supported"))) / claims).alias("faithfulness_micro"),
        _mean(F.col("faithfulness"), faith).alias("faithfulness"),
        F.count_if(faith).alias("faithfulness_cases"),
        _mean(refused, known).alias("known_false_refusal_rate"),
        _mean(refused, unknown).alias("unknown_refusal_rate"),
        F.avg("latency_seconds").alias("latency_seconds"),
        *[F.avg(m).alias(m) for m in metrics],
    ]


def _prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "__faith": metric_available("faithfulness"), "__correct": metric_available("correctness"),
        "__claims": F.coalesce(F.size("claims"), F.lit(0)).cast("bigint"),
        "__supported": F.coalesce(F.size(F.filter("claims", lambda c: c["supported"])), F.lit(0)).cast("bigint"),
    })


def summarize(rows: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    return _prepared(rows).groupBy(*keys).agg(*summary_aggregates(metrics))


def grouped_report(rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ("bucket", "difficulty", "split")) -> DataFrame:
    """Summaries by strategy over everything, each grouping column, and each tag."""
    ready = _prepared(rows)
    strategy = F.col("strategy")
    sets = [[strategy], *[[strategy, F.col(c)] for c in by]]
    figures = summary_aggregates(metrics)
    grouped = ready.groupingSets(sets, strategy, *[F.col(c) for c in by]).agg(*figures, F.grouping_id().alias("__g"))
    # grouping_id has one bit per column, set where the column was aggregated away.
    everything = (1 << len(by)) - 1
    kind, value = F.lit("all"), F.lit("all")
    for i, c in enumerate(by):
        here = F.col("__g") == everything - (1 << (len(by) - 1 - i))
        kind, value = F.when(here, c).otherwise(kind), F.when(here, F.col(c)).otherwise(value)
    names = grouped.columns[1 + len(by) : -1]
    flat = grouped.select("strategy", kind.alias("kind"), value.alias("value"), *names)
    tags = ready.withColumn("value", F.explode("challenge_tags")).groupBy("strategy", "value").agg(*figures)
    return flat.unionByName(tags.select("strategy", F.lit("challenge_tags").alias("kind"), "value", *names))


def paired_comparisons(rows: DataFrame, metrics: tuple[str, ...], strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Wins, ties and mean right-left difference per strategy pair, split and metric."""
    place = F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy"))
    values = F.array(*[F.col(m).cast("double") for m in metrics], F.when(metric_available("correctness"), F.col("correctness")))
    base = rows.filter(place > 0).select("eval_id", "split", place.alias("p"), "strategy", values.alias("v"))
    left = base.select("eval_id", "split", F.col("p").alias("lp"), F.col("strategy").alias("left_strategy"), F.col("v").alias("lv"))
    right = base.select("eval_id", "split", F.col("p").alias("rp"), F.col("strategy").alias("right_strategy"), F.col("v").alias("rv"))
    pairs = left.join(right, ["eval_id", "split"]).filter("lp < rp")
    deltas = F.array(*[
        F.struct(F.lit(m).alias("metric"), (F.get("rv", F.lit(i)) - F.get("lv", F.lit(i))).alias("delta"))
        for i, m in enumerate((*metrics, "correctness"))
    ])
    long = pairs.select(
        "left_strategy", "right_strategy", F.explode(F.array(F.lit("all"), "split")).alias("split"), deltas.alias("z")
    ).select("left_strategy", "right_strategy", "split", F.explode("z").alias("z"))
    delta = F.col("z.delta")
    return long.groupBy("split", "left_strategy", "right_strategy", F.col("z.metric").alias("metric")).agg(
        F.count(delta).alias("pairs"), F.count_if(delta < -WIN_MARGIN).alias("left_wins"),
        F.count_if(F.abs(delta) <= WIN_MARGIN).alias("ties"), F.count_if(delta > WIN_MARGIN).alias("right_wins"),
        F.avg(delta).alias("mean_delta"),
    )


# --- thresholds ------------------------------------------------------------


def _unpivot(one_row: DataFrame, thresholds: list[float], names: list[str], keys: list[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(t).cast("double").alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in names])
        for i, t in enumerate(thresholds)
    ]
    return one_row.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def calibration_curve(rows: DataFrame, strategy: str = "hybrid_rerank") -> DataFrame:
    """Balanced accuracy at each threshold 0, 0.05 .. 1; one pass, no row is repeated."""
    thresholds = [i / 100 for i in range(0, 101, 5)]
    chosen = rows.filter((F.col("split") == "calibration") & (F.col("strategy") == strategy) & ~has_error(F.col("error")))
    score, negative = F.coalesce("top_score", F.lit(0.0)), F.col("should_refuse")
    counts = [F.count_if(~negative).alias("positives"), F.count_if(negative).alias("negatives")]
    for i, t in enumerate(thresholds):
        counts += [F.count_if(~negative & (score >= t)).alias(f"kept_{i}"), F.count_if(negative & (score < t)).alias(f"cut_{i}")]
    curve = _unpivot(chosen.agg(*counts), thresholds, ["kept", "cut"], ["positives", "negatives"])
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    balanced = F.when(both, (F.col("kept") / F.col("positives") + F.col("cut") / F.col("negatives")) / 2)
    return curve.withColumn("balanced_accuracy", balanced)


def calibrate_threshold(rows: DataFrame, strategy: str = "hybrid_rerank") -> DataFrame:
    """Best threshold, the lowest among equals; no row if a class is missing."""
    curve = calibration_curve(rows, strategy).filter(F.col("balanced_accuracy").isNotNull())
    return curve.orderBy(F.desc("balanced_accuracy"), "threshold").limit(1).select(
        "threshold", "balanced_accuracy", (F.col("positives") + F.col("negatives")).alias("calibration_cases")
    )


def sweep_faq_thresholds(cases: DataFrame, hits: DataFrame, chunks: DataFrame, thresholds: list[float]) -> DataFrame:
    """Correct positives and false positives per threshold, and the best perfect one.

    Cases: case_id, expected ∈ {hit, miss}, source, answer_contains. Hits:
    case_id, chunk_id, score. A case counts from its best matching (or any) hit
    upward, so one number per case is enough for all thresholds.
    """
    if not thresholds or any(not 0 <= t <= 1 for t in thresholds):
        raise ValueError("thresholds must be between 0 and 1")
    thresholds = sorted(set(thresholds))
    stored = chunks.select(F.col("id").alias("chunk_id"), "source_key", "answer")
    joined = cases.join(hits, "case_id").join(stored, "chunk_id")
    name = F.regexp_extract("source", r"([^/]*)/*$", 1)
    matches = F.col("source_key").contains(name) & F.col("answer").contains(F.col("answer_contains"))
    counted = F.when((F.col("expected") == "miss") | matches, F.col("score"))
    best = joined.groupBy("case_id").agg(F.max(counted).alias("best"))
    scored = cases.select("case_id", "expected").join(best, "case_id", "left")
    positive, negative = F.col("expected") == "hit", F.col("expected") == "miss"
    counts = [F.count_if(positive).alias("positive_cases"), F.count_if(negative).alias("negative_cases")]
    for i, t in enumerate(thresholds):
        reached = F.coalesce(F.col("best") >= t, F.lit(False))
        counts += [F.count_if(positive & reached).alias(f"correct_{i}"), F.count_if(negative & reached).alias(f"false_{i}")]
    rows = _unpivot(scored.agg(*counts), thresholds, ["correct", "false"], ["positive_cases", "negative_cases"])
    perfect = (F.col("correct") == F.col("positive_cases")) & (F.col("false") == 0)
    best_t = rows.agg(F.max(F.when(perfect, F.col("threshold")))).scalar()
    return rows.select(
        "threshold", F.col("correct").alias("answer_source_correct"), "positive_cases",
        F.try_divide("correct", "positive_cases").alias("positive_recall"), F.col("false").alias("negative_false_positives"),
        "negative_cases", F.try_divide("false", "negative_cases").alias("negative_false_positive_rate"),
        best_t.alias("selected_threshold"),
    )


# --- judges ----------------------------------------------------------------


def faithfulness_score(claims: Column | str) -> dict[str, Column]:
    """Supported share of the claims and what the unsupported ones lack."""
    claims = tx._c(claims)
    supported = F.size(F.filter(claims, lambda c: c["supported"]))
    missing = F.transform(F.filter(claims, lambda c: ~c["supported"]), lambda c: F.concat(c["claim"], F.lit(CLAIM_SEPARATOR), c["reason"]))
    some = F.size(claims) > 0
    return {
        "score": F.when(some, supported / F.size(claims)),
        "reason": F.when(some, F.array_join(missing, REASON_SEPARATOR)).otherwise(F.lit(NO_CLAIMS)),
    }


def correctness_score(
    facts: Column | str, n_required: Column | str, should_refuse: Column | str, refused: Column | str
) -> dict[str, Column]:
    """Refusal agreement, or coverage of the required facts; ``error`` if verdicts are not 0..n-1."""
    facts, n, should, did = tx._c(facts), tx._c(n_required), tx._c(should_refuse), tx._c(refused)
    refusal = should | did
    ordered = F.array_sort(F.transform(facts, lambda f: f["index"].cast("bigint")))
    wanted = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    error = (
        F.when(refusal, F.lit(None).cast("string")).when(F.coalesce(n, F.lit(0)) < 1, "facts_required")
        .when(~F.coalesce(ordered == wanted, F.lit(False)), "missing_or_duplicate_fact_index")
    )
    good = F.size(F.filter(facts, lambda f: f["covered"] & ~f["contradicted"]))
    judged = error.isNull() & ~refusal
    by_index = F.array_sort(F.transform(facts, lambda f: F.struct(f["index"].alias("index"), f["covered"].alias("covered"), f["contradicted"].alias("contradicted"), f["reason"].alias("reason"))))
    wrong = F.transform(F.filter(by_index, lambda f: ~f["covered"] | f["contradicted"]), lambda f: f["reason"])
    return {
        "score": F.when(refusal, (should == did).cast("double")).when(judged, (good == n).cast("double")),
        "fact_coverage": F.when(judged, good / n),
        "reason": F.when(refusal, F.lit(REFUSAL_REASON)).when(judged, F.array_join(wrong, REASON_SEPARATOR)),
        "error": error,
    }


def combine_verdicts(rows: DataFrame, faithfulness: DataFrame, correctness: DataFrame) -> DataFrame:
    """Attach two independent verdicts; the first failure is the row error, the other verdict stays.

    Verdicts: eval_id, strategy, score, error (correctness also fact_coverage).
    A refused answer is not judged for faithfulness; an absent verdict is an error.
    """
    key = ["eval_id", "strategy"]
    faith = faithfulness.select(*key, F.col("score").alias("__f"), F.col("error").alias("__fe"), F.lit(True).alias("__has_f"))
    right = correctness.select(*key, F.col("score").alias("__c"), "fact_coverage", F.col("error").alias("__ce"), F.lit(True).alias("__has_c"))
    joined = rows.join(faith, key, "left").join(right, key, "left")
    absent = F.lit("missing_verdict")
    f_error = F.when(~F.col("refused"), F.when(F.col("__has_f").isNull(), absent).otherwise(F.col("__fe")))
    c_error = F.when(F.col("__has_c").isNull(), absent).otherwise(F.col("__ce"))
    return joined.withColumns({"faithfulness_error": f_error, "correctness_error": c_error}).withColumns({
        "faithfulness": F.when(~F.col("refused") & F.col("faithfulness_error").isNull(), F.col("__f")),
        "correctness": F.when(F.col("correctness_error").isNull(), F.col("__c")),
        "fact_coverage": F.when(F.col("correctness_error").isNull(), F.col("fact_coverage")),
        "error": F.coalesce("faithfulness_error", "correctness_error"),
        "error_stage": F.when(F.col("faithfulness_error").isNotNull(), JUDGE_STAGES[0]).when(F.col("correctness_error").isNotNull(), JUDGE_STAGES[1]),
        "faithfulness_error_present": F.lit(True), "correctness_error_present": F.lit(True),
    }).drop("__f", "__fe", "__has_f", "__c", "__ce", "__has_c")


# --- replay files ----------------------------------------------------------


def validate_replay(lines: DataFrame, raw: str = "value", row_id: str = "row_number") -> DataFrame:
    """Problem of each replay row (NULL if fine): JSON, fields, types, repeated pair."""
    text = F.col(raw)
    keys = F.json_object_keys(text)
    has_all = F.size(F.array_except(F.array(*map(F.lit, REPLAY_FIELDS)), F.coalesce(keys, F.array().cast("array<string>")))) == 0

    def problem(v: Column) -> Column:
        def kind(field: str, pattern: str) -> Column:
            return F.coalesce(js.kind(v, f"$.{field}").rlike(pattern), F.lit(False))

        typed = (
            kind("answer", "^STRING$") & kind("citations", "^ARRAY") & kind("required_facts", "^ARRAY") & kind("metrics", "^OBJECT")
            & kind("refused", "^BOOLEAN$") & kind("should_refuse", "^BOOLEAN$")
        )
        return F.when(v.isNull(), "invalid_json").when(~(js.is_object(v) & has_all), "missing_fields").when(~typed, "invalid_types")

    rows = lines.filter(~tx.is_blank(text)).withColumns({
        "problem": js.read_object(text, problem),
        "eval_id": F.get_json_object(text, "$.eval_id"), "strategy": F.get_json_object(text, "$.strategy"),
    })
    counts = rows.groupBy("eval_id", "strategy").agg(F.count("*").alias("__n"))
    # Rows without a pair never meet the join, so broken lines do not gather in one task.
    keyed = rows.filter(F.col("eval_id").isNotNull() & F.col("strategy").isNotNull()).join(counts, ["eval_id", "strategy"], "left")
    judged = keyed.withColumn("problem", F.coalesce("problem", F.when(F.col("__n") > 1, "duplicate_pair"))).drop("__n")
    rest = rows.filter(F.col("eval_id").isNull() | F.col("strategy").isNull())
    return judged.unionByName(rest).select(row_id, "eval_id", "strategy", "problem")


def select_rejudge(rows: DataFrame) -> DataFrame:
    """Mark rows to be judged again; rows with other errors pass through unchanged."""
    foreign = has_error(F.col("error")) & ~F.coalesce(F.col("error_stage").isin(*REJUDGE_STAGES), F.lit(False))
    return rows.withColumns({
        "previous_error": F.col("error"), "previous_error_stage": F.col("error_stage"), "rejudge": ~foreign,
    }).withColumn("error", F.when(~F.col("rejudge"), F.col("error")))


def latency_report(
    rows: DataFrame, stages: tuple[str, ...], keys: tuple[str, ...] = ("strategy",), rank_error: float = 0.001
) -> DataFrame:
    """Mean seconds per stage and quantiles of the total, each within ``rank_error`` of its rank (as a share of the rows)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.avg("latency_seconds").alias("latency_seconds"),
        *[F.avg(s).alias(s) for s in stages],
        F.percentile_approx("latency_seconds", F.array(F.lit(0.5), F.lit(0.95)), F.lit(round(1 / rank_error))).alias("quantiles"),
        F.lit(rank_error).alias("rank_error"),
    )


def exact_quantiles(rows: DataFrame, value: str, quantiles: tuple[str, ...], keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """``keys, quantiles``: the values at ranks ceil(n * q) of each group of any size; a NULL value counts as the greatest.

    Quantiles are decimal texts, so that ranks are exact. Distinct values with their counts are cut into ranges, no task gets a
    whole group; only the ranges that hold a wanted rank are ranked.
    """
    counted = rows.groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    laid = counted.repartitionByRange(*keys, F.col("__value").asc_nulls_last()).withColumn("__range", F.spark_partition_id())
    laid = materialize(laid, "quantile-ranges")
    ranges = laid.groupBy(*keys, "__range").agg(F.sum("__n").alias("__sum"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*[F.ceil(F.sum("__sum").over(group) * F.lit(Decimal(q))).cast("bigint") for q in quantiles])
    # One row per range of a group, so a group is at most as many rows as there are ranges.
    held = ranges.withColumns({"__ranks": ranks, "__before": F.sum("__sum").over(upto) - F.col("__sum")})
    inside = lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__sum"))
    wanted = held.where(F.exists("__ranks", inside)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "__ranks", "__before")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    order = Window.partitionBy(*keys, "__range").orderBy(F.col("__value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.join(wanted, same).withColumn("__upto", F.col("__before") + F.sum("__n").over(order))
    at = lambda i: F.when((F.col("__ranks")[i] <= F.col("__upto")) & (F.col("__ranks")[i] > F.col("__upto") - F.col("__n")), F.col("__value"))
    return placed.groupBy(*keys).agg(F.array(*[F.max(at(i)) for i in range(len(quantiles))]).alias("quantiles"))


#: Size parameter of latency sketches, and the share of rows by which a rank read from one may be off (at 99 % confidence; the
#: library's figure for this size is 0.0071, merged sketches included).
SKETCH_K = 400
SKETCH_RANK_ERROR = 0.01


def latency_sketches(rows: DataFrame, keys: tuple[str, ...], value: str = "latency_seconds", k: int = SKETCH_K) -> DataFrame:
    """``keys, n, sketch``: a quantile sketch per group, of a size that does not grow with the rows. NULL and NaN values are left out.

    Sketches of a day are stored and never read again row by row: ``merge_sketches`` adds them up.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return good.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...], quantiles: tuple[float, ...], k: int = SKETCH_K) -> DataFrame:
    """``keys, n, quantiles, rank_error`` of stored sketches put together, each quantile within ``rank_error`` of its rank."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", at).alias("quantiles"), F.lit(SKETCH_RANK_ERROR).alias("rank_error"))


# --- datasets --------------------------------------------------------------


def validate_dataset(cases: DataFrame, sources: DataFrame, minimum: int = 300) -> DataFrame:
    """(rule, eval_id) violations of a labelled case table; empty if it is valid.

    Cases are read twice: once for the rules of a row and the keys it names, which are written and looked up in the source table by one
    join, and once for the rules of groups, which are one aggregate over (kind of group, key), combined before the shuffle.
    """
    family = F.coalesce(F.col("family_id"), F.lit("")) != ""
    truth = F.coalesce(F.col("relevant_source_keys"), F.array().cast("array<string>"))
    distractors = F.coalesce(F.col("distractor_source_keys"), F.array().cast("array<string>"))
    facts = F.coalesce(F.col("required_facts"), F.array().cast("array<string>"))
    refuse = F.col("should_refuse")
    bad_enum = ~(F.col("bucket").isin(*BUCKETS) & F.col("difficulty").isin(*DIFFICULTIES) & F.col("split").isin(*SPLITS))
    row_rules = {
        "invalid_enum": F.coalesce(bad_enum, F.lit(True)),
        "invalid_length": (F.length("eval_id") > MAX_EVAL_ID) | (F.length("query") > MAX_QUERY) | tx.is_blank("query"),
        "invalid_ground_truth": (F.size(truth) > 0) == refuse,
        "facts_required": ~refuse & ((F.size(facts) == 0) | F.exists(facts, lambda f: tx.is_blank(f))),
        "gold_and_distractor_overlap": family & (F.size(F.array_intersect(truth, distractors)) > 0),
        "missing_challenge_tags": family & (F.coalesce(F.size("challenge_tags"), F.lit(0)) == 0),
        "refusal_rationale_required": family & refuse & tx.is_blank(F.coalesce("refusal_rationale", F.lit(""))),
        "family_required": ~family & F.col("eval_id").startswith("V2"),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in row_rules.items()]))
    def mark(rule, key, wanted, scope) -> Column:
        return F.struct(rule.alias("rule"), key.alias("key"), wanted.alias("wanted"), scope.alias("scope"))

    none = F.lit(None).cast("string")
    scoped = family & (F.coalesce(F.col("category"), F.lit("")) != "")
    marks = F.concat(
        F.transform(named, lambda r: mark(r, none, none, none)),
        F.transform(truth, lambda k: mark(none, k, F.lit("gold"), F.when(scoped, F.col("category")))),
        F.when(family, F.transform(distractors, lambda k: mark(none, k, F.lit("distractor"), none))).otherwise(
            F.transform(F.slice(distractors, 1, 0), lambda k: mark(none, k, F.lit("distractor"), none))
        ),
    )
    marked = materialize(cases.select("eval_id", F.explode(marks).alias("m")).select("eval_id", "m.*"), "dataset-marks")
    found = [marked.where("rule is not null").select("rule", "eval_id")]
    known = sources.select(F.col("source_key").alias("key"), F.col("category").alias("key_category"), F.lit(True).alias("__known"))
    asked = marked.where("rule is null")
    # A NULL key is in no source; it asks for nothing and stays out of the join.
    looked = asked.where("key is not null").join(known, "key", "left").select("eval_id", "wanted", "scope", "__known", "key_category")
    looked = looked.unionByName(asked.where("key is null").select("eval_id", "wanted", "scope", F.lit(None).cast("boolean").alias("__known"), none.alias("key_category")))
    wrong = F.when(F.col("__known").isNull(), F.concat(F.lit("missing_"), F.col("wanted"), F.lit("_source"))).when(
        F.col("key_category") != F.col("scope"), F.lit("gold_outside_category")
    )
    found.append(looked.select(wrong.alias("rule"), "eval_id").where("rule is not null").distinct())

    strict = minimum >= 300
    group = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    groups = [group("total", none), group("duplicate_eval_id", F.col("eval_id")), group("duplicate_query", tx.strip("query")), group("family_leak", F.when(family, F.col("family_id")))]
    if strict:
        groups += [group("topic_leak", F.col("topic_id")), group("bucket", F.col("bucket")), group("cell", F.concat_ws("/", "bucket", "difficulty"))]
    counted = cases.select("eval_id", "split", F.explode(F.array(*groups)).alias("g")).groupBy("g").agg(
        F.count("*").alias("n"), F.min("eval_id").alias("eval_id"), F.min("split").alias("first_split"), F.max("split").alias("last_split")
    ).select("g.kind", "g.key", "n", "eval_id", "first_split", "last_split")
    counted = materialize(counted, "dataset-groups")
    found.append(counted.where("kind like 'duplicate%' and n > 1").select(F.col("kind").alias("rule"), "eval_id"))
    found.append(counted.where("(kind = 'topic_leak' or kind = 'family_leak' and key is not null) and first_split <> last_split").select(F.col("kind").alias("rule"), F.col("key").alias("eval_id")))
    # Buckets and their cells are a fixed list, so one row holds what they count.
    of = lambda kind, key=None: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.lit(True) if key is None else F.col("key") == key), F.col("n"))), F.lit(0))
    cells = [f"{b}/{d}" for b in BUCKETS for d in DIFFICULTIES] if strict else []
    buckets = list(BUCKETS) if strict else []
    fixed = counted.where("kind in ('total', 'bucket', 'cell')").agg(of("total").alias("total"), *[of("bucket", b).alias(b) for b in buckets], *[of("cell", c).alias(c) for c in cells])
    problem = lambda rule, name: F.struct(F.lit(rule).alias("rule"), name.alias("eval_id"))
    short = [F.when(F.col("total") < minimum, problem("dataset_below_minimum", none))]
    short += [F.when(F.col(b) < MIN_BUCKET_CASES, problem("bucket_below_minimum", F.lit(b))) for b in buckets]
    short += [F.when(F.col(f"`{c}`") == 0, problem("missing_difficulty", F.lit(c))) for c in cells]
    found.append(fixed.select(F.explode(F.array_compact(F.array(*short))).alias("p")).select("p.rule", "p.eval_id"))
    return reduce(DataFrame.unionByName, found)


def split_leakage(cases: DataFrame, group: str) -> DataFrame:
    """Groups that occur in more than one split."""
    spread = cases.groupBy(group).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
    return spread.filter(F.col("first_split") != F.col("last_split"))


def corpus_digest(chunks: DataFrame, key: str = "source_key", answer: str = "answer") -> DataFrame:
    """One digest of a whole corpus that does not depend on row order.

    Every row's whole hash is cut into numbers of at most 60 bits that are summed up, so the
    digest is combined in parallel and no task ever concatenates the corpus. A NULL differs from any text.
    """
    field = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    row = F.sha2(F.concat(field(key), F.lit("\x00"), field(answer)), 256)
    hashed = chunks.select(row.alias("h"))
    sums = [
        F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}")
        for i in range(5)
    ]
    total = hashed.agg(F.count("*").alias("n_chunks"), *sums)
    joined = F.concat_ws("-", F.col("n_chunks").cast("string"), *[F.col(f"s{i}") for i in range(5)])
    return total.select("n_chunks", F.sha2(joined, 256).alias("digest"))


#: Bits of an order value that one block of a digest tree spans, and levels above which any 64-bit order is one block.
TREE_BITS = 12


def corpus_leaves(chunks: DataFrame, order: str = "draft_order", key: str = "source_key", answer: str = "answer", bits: int = TREE_BITS) -> DataFrame:
    """``block, n_chunks, digest`` of the corpus in the order of a unique integer: the leaf level of a digest tree, to be stored.

    A block is 2**bits consecutive order values. Its digest is that of its rows' digests in their order, so two rows that swap places change it.
    A block's list is at most 2**bits hashes; a NULL differs from any text.
    """
    field = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    row = F.sha2(F.concat(field(key), F.lit("\x00"), field(answer)), 256)
    rows = chunks.select(F.shiftright(F.col(order).cast("bigint"), bits).alias("block"), F.col(order).alias("at"), row.alias("h"))
    return _combine_level(rows, F.count("*")).withColumnRenamed("n", "n_chunks")


def _combine_level(rows: DataFrame, size: Column) -> DataFrame:
    listed = rows.groupBy("block").agg(size.alias("n"), F.array_sort(F.collect_list(F.struct("at", "h"))).alias("rows"))
    return listed.select("block", "n", F.sha2(F.concat_ws("", F.col("rows.h")), 256).alias("digest"))


def corpus_root(leaves: DataFrame, bits: int = TREE_BITS) -> DataFrame:
    """``n_chunks, digest`` of a whole corpus from its leaves; levels are combined until one block can be left for any 64-bit order. An empty corpus gives no rows."""
    level = leaves.select("block", F.col("n_chunks").alias("n"), "digest")
    for _ in range(-(-64 // bits)):
        level = _combine_level(
            level.select(F.shiftright("block", bits).alias("block"), F.col("block").alias("at"), F.col("digest").alias("h"), "n"), F.sum("n")
        )
    # Orders below and above zero end in a block each.
    return level.groupBy().agg(F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("ends")).where("n_chunks is not null").select(
        "n_chunks", F.sha2(F.concat_ws("", F.col("ends.digest")), 256).alias("digest")
    )


def changed_blocks(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``block, status`` of the leaves in which a corpus differs from its stored ones: ``changed``, ``added`` or ``removed``."""
    old, new = stored.select("block", F.col("digest").alias("was")), now.select("block", F.col("digest").alias("is"))
    both = old.join(new, "block", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("block", status.alias("status")).where("status is not null")


def check_manifest(digest: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each entry of a stored manifest (name, n_chunks, digest) next to the corpus as it is now.

    ``status`` is ``same``, ``count_differs`` or ``digest_differs``; NULL entries count as different.
    """
    now = digest.first()  # one row
    both = manifest.withColumn("now_chunks", F.lit(now["n_chunks"])).withColumn("now_digest", F.lit(now["digest"]))
    status = (
        F.when(~F.col("n_chunks").eqNullSafe(F.col("now_chunks")), "count_differs")
        .when(~F.col("digest").eqNullSafe(F.col("now_digest")), "digest_differs").otherwise("same")
    )
    return both.withColumn("status", status)


# --- routing, expansion and workflow reports -------------------------------


def intent_accuracy(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    right = ~has_error(F.col("error")) & (F.col("actual") == F.col("expected"))
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(right, F.lit(False))).alias("correct"),
        F.count_if(has_error(F.col("error"))).alias("errors"),
        F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy"),
    )


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy("expected").pivot("actual", labels).agg(F.count(F.lit(1))).na.fill(0)


def reference_report(rows: DataFrame) -> DataFrame:
    def share(condition: Column) -> Column:
        return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))

    return rows.agg(
        F.count("*").alias("case_count"), F.count_if(F.col("intent_json_valid")).alias("intent_json_valid"),
        share(F.col("intent").eqNullSafe(F.col("expected_intent"))).alias("intent_accuracy"),
        F.count_if(F.col("reference_json_valid")).alias("reference_json_valid"),
        share(F.col("resolved_query").eqNullSafe(F.col("expected_query"))).alias("reference_query_exact"),
        share(F.col("reference_resolved").eqNullSafe(F.col("expected_resolved"))).alias("reference_status_accuracy"),
    )


def expansion_report(rows: DataFrame) -> DataFrame:
    """Rows: json_valid, queries array (fallback included), question."""
    distinct = F.size(F.array_distinct(F.transform("queries", F.lower))) == F.size("queries")
    return rows.agg(
        F.count("*").alias("case_count"), F.count_if("json_valid").alias("query_json_valid"),
        F.coalesce(F.avg(F.col("json_valid").cast("double")), F.lit(0.0)).alias("query_json_valid_rate"),
        F.coalesce(F.avg(distinct.cast("double")), F.lit(0.0)).alias("distinct_query_rate"),
        F.count_if(F.array_contains("queries", F.col("question"))).alias("fallback_included"),
        F.coalesce(F.avg(F.size("queries")), F.lit(0.0)).alias("mean_queries"),
    )


def assertion_checks(output: Column | str, required: Column | str, required_any: Column | str, forbidden: Column | str, actual_tokens: Column | str) -> dict[str, Column]:
    """Text checks of an output: length, required, alternatives, forbidden, usage known."""
    text = tx.strip(output)
    present = F.forall(tx._c(required), lambda r: text.contains(r)) & F.forall(
        tx._c(required_any), lambda options: F.exists(options, lambda o: text.contains(o))
    )
    checks = {
        "length_at_most_250": F.length(text) <= MAX_OUTPUT_CHARS,
        "required_present": present,
        "forbidden_absent": ~F.exists(tx._c(forbidden), lambda f: text.contains(f)),
        "actual_input_tokens_available": tx._c(actual_tokens).isNotNull(),
    }
    passed = reduce(lambda a, b: a & b, checks.values())
    return {**checks, "passed": passed}


def token_accounting(estimate: Column, actual: Column, cjk: Column, ratio: float = 1.0) -> dict[str, Column]:
    """Difference and ratio of estimate to actual tokens, and the CJK ratio they imply."""
    rest = estimate - cjk * F.lit(float(ratio))
    return {
        "estimate_minus_actual": estimate - actual,
        "estimate_to_actual_ratio": F.when(actual != 0, F.round(estimate / actual, 4)),
        "suggested_cjk_ratio": F.when((actual != 0) & (cjk != 0), F.round(F.greatest(F.lit(0.0), actual - rest) / cjk, 4)),
    }


def token_calibration(rows: DataFrame) -> DataFrame:
    known = F.col("actual_tokens").isNotNull()
    return rows.agg(
        F.count_if(known).alias("samples"), F.round(F.avg("estimate_to_actual_ratio"), 4).alias("mean_estimate_to_actual_ratio"),
        F.round(F.avg(F.when(known, F.col("estimate_minus_actual"))), 2).alias("mean_estimate_minus_actual"),
        F.round(F.avg("suggested_cjk_ratio"), 4).alias("mean_implied_cjk_ratio"),
    )


def check_matrix(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """Passed count and denominator per check name; an absent check is not a failed one."""
    return rows.select(F.explode(checks).alias("check", "ok")).groupBy("check").agg(
        F.count_if(F.col("ok")).alias("passed"), F.count("*").alias("denominator")
    )


# Name of each check next to the expected field that asks for it.
STEP_CHECKS = {
    "tool_calls": "tool_calls",
    "preview": "preview",
    "preview_any": "preview_content",
    "answer_any": "answer_content",
    "forbidden_any": "forbidden_content_absent",
    "forbidden_tools": "forbidden_tools_absent",
    "invalid_arguments": "invalid_arguments_audited",
    "forbidden_tool": "forbidden_tool_denied",
    "ticket_count_delta": "ticket_count_delta",
    "audit_status": "audit_status",
}


def step_checks(expected: str = "expected", actual: str = "actual") -> Column:
    """Named checks of a step (map of name to outcome), from structs of what is expected and what happened.

    A NULL expected field asks for nothing, so its check is absent rather than false; an empty list of texts or forbidden
    tools asks for nothing either, an empty list of tool calls is met. Expected: the fields of STEP_CHECKS (lists of strings
    for ``tool_calls``, ``*_any`` and ``forbidden_tools``). Actual: tool_names, answer, previews (ticket_type,
    description), invalid_arguments, forbidden_tool, ticket_count_delta, audit_statuses, has_error_event.
    """
    want, got = (lambda f: F.col(expected)[f]), (lambda f: F.col(actual)[f])
    tools, answer = F.coalesce(got("tool_names"), F.array().cast("array<string>")), F.coalesce(got("answer"), F.lit(""))
    shown = F.array_join(
        F.flatten(F.transform(got("previews"), lambda p: F.array(F.coalesce(p["ticket_type"], F.lit("")), F.coalesce(p["description"], F.lit(""))))), " "
    )
    asked = lambda f: F.coalesce(F.size(want(f)), F.lit(0)) > 0
    flag = lambda f: F.coalesce(got(f), F.lit(False))
    outcome = {
        "tool_calls": F.forall(want("tool_calls"), lambda t: F.array_contains(tools, t)),
        "preview": (F.coalesce(F.size(got("previews")), F.lit(0)) > 0) == want("preview"),
        "preview_any": F.when(asked("preview_any"), F.exists(want("preview_any"), lambda t: F.coalesce(F.contains(shown, t), F.lit(False)))),
        "answer_any": F.when(asked("answer_any"), F.exists(want("answer_any"), lambda t: F.contains(answer, t))),
        "forbidden_any": F.when(asked("forbidden_any"), ~F.exists(want("forbidden_any"), lambda t: F.contains(answer, t))),
        "forbidden_tools": F.when(asked("forbidden_tools"), ~F.arrays_overlap(want("forbidden_tools"), tools)),
        "invalid_arguments": F.when(want("invalid_arguments").isNotNull(), flag("invalid_arguments")),
        "forbidden_tool": F.when(want("forbidden_tool").isNotNull(), flag("forbidden_tool")),
        "ticket_count_delta": F.when(
            want("ticket_count_delta").isNotNull(), got("ticket_count_delta").eqNullSafe(want("ticket_count_delta"))
        ),
        "audit_status": F.when(
            want("audit_status").isNotNull(), F.coalesce(F.array_contains(got("audit_statuses"), want("audit_status")), F.lit(False))
        ),
    }
    entries = [F.struct(F.lit(STEP_CHECKS[f]).alias("check"), ok.alias("ok")) for f, ok in outcome.items()]
    entries.append(F.struct(F.lit("no_sse_error").alias("check"), F.when(flag("has_error_event"), F.lit(False)).alias("ok")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["ok"].isNotNull()))


def expected_checks(expected: str = "expected") -> Column:
    """Names of the checks that a step's expectations ask for; those of a failed step count as false."""
    names = [F.when(F.col(expected)[f].isNotNull(), F.lit(name)) for f, name in STEP_CHECKS.items()]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def case_outcomes(expected: DataFrame, actual: DataFrame, steps: DataFrame) -> DataFrame:
    """Outcome per case: a failed step keeps its expected checks as false.

    Expected: case_id, step, check. Actual: case_id, step, check, ok. Steps:
    case_id, step, error, ticket_delta. Expected checks of a failed step count
    as false; on a good step only the checks that ran count.
    """
    key = ["case_id", "step", "check"]
    failed = steps.filter(F.col("error").isNotNull()).select("case_id", "step")
    lost = expected.join(failed, ["case_id", "step"], "left_semi").select(*key, F.lit(False).alias("ok"))
    ran = actual.join(failed, ["case_id", "step"], "left_anti").select(*key, "ok")
    checks = lost.unionByName(ran).groupBy("case_id").agg(
        F.count("*").alias("n_checks"), F.count_if(F.col("ok")).alias("n_passed")
    )
    per_case = steps.groupBy("case_id").agg(
        F.count("error").alias("n_errors"), F.coalesce(F.sum("ticket_delta"), F.lit(0)).alias("ticket_delta")
    )
    done = F.col("n_errors") == 0
    # Completion itself is one more check of every case.
    return per_case.join(checks, "case_id", "left").select(
        "case_id", F.when(done, "completed").otherwise("error").alias("status"), "ticket_delta",
        (F.coalesce("n_checks", F.lit(0)) + 1).alias("n_checks"),
        (F.coalesce("n_passed", F.lit(0)) + done.cast("bigint")).alias("n_passed"),
        (done & (F.coalesce("n_checks", F.lit(0)) == F.coalesce("n_passed", F.lit(0)))).alias("passed"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("case_count"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if("passed").alias("passed"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
        F.count_if(F.col("ticket_delta") > 0).alias("cases_with_ticket_created"),
        F.coalesce(F.sum(F.greatest(F.col("ticket_delta"), F.lit(0))), F.lit(0)).alias("tickets_created_total"),
    )


def field_accuracy(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Exact records and floor(100 * matching fields / all fields)."""
    same = [F.col(f"actual_{f}").eqNullSafe(F.col(f"expected_{f}")).cast("bigint") for f in fields]
    matches = reduce(lambda a, b: a + b, same)
    return rows.agg(
        F.count_if(matches == len(fields)).alias("passed"), F.count("*").alias("total"),
        F.coalesce(F.sum(matches), F.lit(0)).alias("field_matches"),
    ).select(
        "passed", "total", "field_matches",
        F.when(F.col("total") > 0, F.expr(f"(field_matches * 100) div (total * {len(fields)})")).alias("field_accuracy"),
    )
