"""Registered queries: retrieval, answer, dataset and workflow evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import evaluation as ev
from supportlake.operators import retrieval as rt
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.plans.retrieval_queries import DENSE, corpus_vectors, query_vectors
from supportlake.plans.text_queries import TOKENS_SQL
from supportlake.session import materialize
from supportlake.sources.tables import read_input

METRICS = tuple(f"recall_at_{k}" for k in (1, 5, 10)) + tuple(f"all_evidence_at_{k}" for k in (1, 5, 10)) + ("mrr",)


# --- retrieval metrics -----------------------------------------------------


def labelled_metrics(spark: SparkSession, sf: str, k: int, ks: tuple[int, ...]) -> DataFrame:
    """Metrics of dense retrieval where a hit is relevant if its label is the query's.

    Relevance is a flag on the hits plus a count per label; the label groups
    are never paired up.
    """
    queries, corpus = query_vectors(spark, sf), corpus_vectors(spark, sf)
    hits = rt.dense_topk(queries, corpus, k)
    q = queries.select("query_id", F.col("label").alias("ql"))
    c = corpus.select("chunk_id", F.col("label").alias("cl"))
    flagged = hits.join(c, "chunk_id").join(q, "query_id").select(
        "query_id", F.col("chunk_id").alias("item"), "rank", (F.col("ql") == F.col("cl")).alias("relevant")
    )
    sizes = corpus.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n_relevant"))
    totals = q.join(sizes, "ql", "left").select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
    return ev.metrics_from_flags(flagged, totals, ks)


_METRICS = f"""WITH {DENSE}, n AS (SELECT q.query_id, count(c.chunk_id) AS n_relevant FROM q LEFT JOIN c ON c.label = q.label GROUP BY 1),
m AS (SELECT n.query_id, n.n_relevant, count(d.rank) FILTER (WHERE relevant AND rank <= 1) AS h1, count(d.rank) FILTER (WHERE relevant AND rank <= 5) AS h5,
  count(d.rank) FILTER (WHERE relevant AND rank <= 10) AS h10, count(d.rank) FILTER (WHERE relevant AND rank <= 50) AS h50,
  min(CASE WHEN relevant AND rank <= 10 THEN rank END) AS first FROM n LEFT JOIN dense d USING (query_id) GROUP BY 1, 2),
metrics AS (SELECT query_id, n_relevant, round(h1 / n_relevant, 6) AS recall_at_1, round(h5 / n_relevant, 6) AS recall_at_5, round(h10 / n_relevant, 6) AS recall_at_10,
  CAST(h1 = n_relevant AS DOUBLE) AS all_evidence_at_1, CAST(h5 = n_relevant AS DOUBLE) AS all_evidence_at_5, CAST(h10 = n_relevant AS DOUBLE) AS all_evidence_at_10,
  round(coalesce(1.0 / first, 0), 6) AS mrr, round(h50 / n_relevant, 6) AS candidate_recall_at_50 FROM m)
"""


@query("evl_retrieval_metrics", _METRICS + "SELECT * EXCLUDE (candidate_recall_at_50) FROM metrics")
def evl_retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = labelled_metrics(spark, sf, 10, (1, 5, 10))
    return out.select("query_id", "n_relevant", *[F.round(m, 6).alias(m) for m in METRICS])


@query(
    "evl_retrieval_metrics_pairs",
    """WITH r AS (SELECT item_id AS query_id, unnest([item_id * 7 % 30, item_id % 30, item_id * 7 % 30, item_id * 3 % 30]) AS item, unnest([1, 2, 3, 4]) AS rank FROM benchmark),
       rel AS (SELECT DISTINCT item_id AS query_id, unnest([item_id % 30, (item_id + 5) % 30]) AS item FROM benchmark WHERE item_id % 3 > 0),
       n AS (SELECT b.item_id AS query_id, count(rel.item) AS n_relevant FROM benchmark b LEFT JOIN rel ON rel.query_id = b.item_id GROUP BY 1),
       h AS (SELECT r.query_id, r.item, min(rank) AS rank FROM r JOIN rel ON rel.query_id = r.query_id AND rel.item = r.item GROUP BY 1, 2)
       SELECT n.query_id, n_relevant, CASE WHEN n_relevant > 0 THEN round(count(h.rank) FILTER (WHERE h.rank <= 2) / n_relevant, 6) END AS recall_at_2,
         CASE WHEN n_relevant > 0 THEN CAST(count(h.rank) FILTER (WHERE h.rank <= 2) = n_relevant AS DOUBLE) END AS all_evidence_at_2,
         CASE WHEN n_relevant > 0 THEN round(coalesce(1.0 / min(h.rank), 0), 6) END AS mrr FROM n LEFT JOIN h USING (query_id) GROUP BY 1, 2""",
)
def evl_retrieval_metrics_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    items = read_input(spark, sf, "benchmark")
    ranked = items.select(n.alias("query_id"), F.posexplode(F.array(n * 7 % 30, n % 30, n * 7 % 30, n * 3 % 30)).alias("p", "item"))
    relevant = items.filter(n % 3 > 0).select(n.alias("query_id"), F.explode(F.array(n % 30, (n + 5) % 30)).alias("item"))
    out = ev.retrieval_metrics(items.select(n.alias("query_id")), ranked.withColumn("rank", F.col("p") + 1), relevant, (2,))
    return out.select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in ("recall_at_2", "all_evidence_at_2", "mrr")])


@query("evl_candidate_recall", _METRICS + "SELECT query_id, candidate_recall_at_50 FROM metrics")
def evl_candidate_recall(spark: SparkSession, sf: str) -> DataFrame:
    out = labelled_metrics(spark, sf, 50, (50,))
    return out.select("query_id", F.round("recall_at_50", 6).alias("candidate_recall_at_50"))


@query(
    "ret_flagship_report",
    _METRICS + "SELECT count(*) AS cases, count(mrr) AS retrieval_cases, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM metrics",
)
def ret_flagship_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each query vector, which same-label vectors are in its top 10: recall@k and MRR."""
    out = labelled_metrics(spark, sf, 10, (1, 5, 10)).select(*[F.round(m, 6).alias(m) for m in METRICS])
    return out.agg(F.count("*").alias("cases"), F.count("mrr").alias("retrieval_cases"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


# --- evaluation rows from labelled documents -------------------------------


def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Four strategy rows per labelled document with errors, claims and metrics."""
    docs, labels = ad.documents(spark, sf), read_input(spark, sf, "labels")
    n, i = F.col("doc_id"), F.col("s")
    rows = labels.join(docs, "doc_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s"))
    strategy = F.get(F.array(*map(F.lit, rt.STRATEGIES)), i)
    refuse = F.col("quality") == 0
    error = F.when((n + i) % 11 == 0, "Timeout").when((n + i) % 11 == 1, "ValueError")
    score = F.round(((n * 7 + i * 13) % 100) / F.lit(100.0), 6)
    return rows.select(
        F.concat(F.lit("E"), n.cast("string")).alias("eval_id"), strategy.alias("strategy"), F.col("lang").alias("bucket"),
        F.get(F.array(*map(F.lit, ev.DIFFICULTIES)), (n % 3).cast("int")).alias("difficulty"),
        F.when(n % 5 == 0, "calibration").otherwise("test").alias("split"), refuse.alias("should_refuse"),
        ((n + i) % 4 == 0).alias("refused"), F.when(n % 6 == 0, " ").otherwise("text").alias("answer"),
        F.array_compact(F.array(F.when(n % 2 == 0, F.lit("even")), F.when(n % 3 == 0, F.lit("third")))).alias("challenge_tags"),
        F.when((n + i) % 4 != 0, score).alias("faithfulness"), F.when((n + i) % 3 == 0, 1.0).otherwise(0.0).alias("correctness"),
        F.round(score / 2, 6).alias("fact_coverage"),
        F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda c: F.struct((c <= i).alias("supported"))).alias("claims"),
        F.when((n + i) % 11 == 0, "Timeout").alias("faithfulness_error"), F.when((n + i) % 11 == 1, "ValueError").alias("correctness_error"),
        (n % 7 != 0).alias("faithfulness_error_present"), F.lit(True).alias("correctness_error_present"), error.alias("error"),
        F.when((n + i) % 11 == 0, "faithfulness_judge").when((n + i) % 11 == 1, "correctness_judge").alias("error_stage"),
        F.when(~refuse, score).alias("recall_at_5"), F.when(~refuse, F.round(1.0 / (n % 4 + i + 1), 6)).alias("mrr"),
        F.round(F.col("n_chars") / F.lit(1000.0), 6).alias("latency_seconds"), F.when((n + i) % 9 != 0, score).alias("top_score"),
    )


_ROWS = """WITH r AS (SELECT 'E' || l.doc_id AS eval_id, ['dense', 'bm25', 'hybrid', 'hybrid_rerank'][s + 1] AS strategy, s, lang AS bucket, ['easy', 'medium', 'hard'][l.doc_id % 3 + 1] AS difficulty,
  CASE WHEN l.doc_id % 5 = 0 THEN 'calibration' ELSE 'test' END AS split, quality = 0 AS should_refuse, (l.doc_id + s) % 4 = 0 AS refused, l.doc_id % 6 = 0 AS empty,
  l.doc_id AS n, (l.doc_id + s) % 11 AS e, round((l.doc_id * 7 + s * 13) % 100 / 100.0, 6) AS score, round(n_chars / 1000.0, 6) AS latency_seconds
  FROM labels l JOIN documents d USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS s)),
rows AS (SELECT *, e = 0 OR e = 1 AS has_error,
  CASE WHEN (n + s) % 4 <> 0 THEN score END AS f, CASE WHEN (n + s) % 3 = 0 THEN 1.0 ELSE 0.0 END AS c, round(score / 2, 6) AS fc, n % 3 + 1 AS claims, least(n % 3 + 1, s) AS supported,
  CASE WHEN NOT should_refuse THEN score END AS recall_at_5, CASE WHEN NOT should_refuse THEN round(1.0 / (n % 4 + s + 1), 6) END AS mrr,
  (n + s) % 4 <> 0 AND (e > 1 OR (e = 1 AND n % 7 <> 0)) AS fa, e > 1 OR e = 0 AS ca FROM r)
"""
_SUMMARY = """count(*) AS cases, count(*) FILTER (WHERE has_error) AS error_count, count(*) FILTER (WHERE e = 0) AS faithfulness_error_count, count(*) FILTER (WHERE e = 1) AS correctness_error_count,
  round(avg(c) FILTER (WHERE ca), 6) AS answer_accuracy, count(*) FILTER (WHERE ca) AS answer_accuracy_cases, round(avg(fc) FILTER (WHERE ca), 6) AS fact_coverage, count(mrr) AS retrieval_cases,
  count(*) FILTER (WHERE NOT should_refuse) AS known_cases, count(*) FILTER (WHERE should_refuse) AS unknown_cases, round(avg(CAST(empty AS DOUBLE)), 6) AS empty_answer_rate,
  CAST(coalesce(sum(claims) FILTER (WHERE fa), 0) AS BIGINT) AS faithfulness_claims, round(CAST(sum(supported) FILTER (WHERE fa) AS DOUBLE) / nullif(sum(claims) FILTER (WHERE fa), 0), 6) AS faithfulness_micro,
  round(avg(f) FILTER (WHERE fa), 6) AS faithfulness, count(*) FILTER (WHERE fa) AS faithfulness_cases, round(avg(CAST(refused AS DOUBLE)) FILTER (WHERE NOT should_refuse), 6) AS known_false_refusal_rate,
  round(avg(CAST(refused AS DOUBLE)) FILTER (WHERE should_refuse), 6) AS unknown_refusal_rate, round(avg(latency_seconds), 6) AS latency_seconds, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("evl_metric_available", _ROWS + "SELECT eval_id, strategy, fa AS faithfulness_available, ca AS correctness_available FROM rows")
def evl_metric_available(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation_rows(spark, sf).select(
        "eval_id", "strategy", ev.metric_available("faithfulness").alias("faithfulness_available"), ev.metric_available("correctness").alias("correctness_available")
    )


@query("evl_summarize", _ROWS + f"SELECT strategy, {_SUMMARY} FROM rows GROUP BY strategy")
def evl_summarize(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.summarize(evaluation_rows(spark, sf), ["strategy"], ("recall_at_5", "mrr")))


@query(
    "evl_grouped_report",
    _ROWS + f"""SELECT strategy, 'all' AS kind, 'all' AS value, {_SUMMARY} FROM rows GROUP BY strategy
      UNION ALL SELECT strategy, 'bucket', bucket, {_SUMMARY} FROM rows GROUP BY strategy, bucket UNION ALL SELECT strategy, 'difficulty', difficulty, {_SUMMARY} FROM rows GROUP BY strategy, difficulty
      UNION ALL SELECT strategy, 'split', split, {_SUMMARY} FROM rows GROUP BY strategy, split
      UNION ALL SELECT strategy, 'challenge_tags', tag, {_SUMMARY} FROM (SELECT *, unnest(list_filter([CASE WHEN n % 2 = 0 THEN 'even' END, CASE WHEN n % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS tag FROM rows) GROUP BY strategy, tag""",
)
def evl_grouped_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.grouped_report(evaluation_rows(spark, sf), ("recall_at_5", "mrr")))


@query(
    "evl_paired_comparisons",
    _ROWS + """, p AS (SELECT a.strategy AS left_strategy, b.strategy AS right_strategy, a.split AS sp, unnest(['recall_at_5', 'mrr', 'correctness']) AS metric,
        unnest([b.recall_at_5 - a.recall_at_5, b.mrr - a.mrr, CASE WHEN a.ca AND b.ca THEN b.c - a.c END]) AS d FROM rows a JOIN rows b ON a.eval_id = b.eval_id AND a.s < b.s),
      x AS (SELECT *, unnest(['all', sp]) AS split FROM p)
      SELECT split, left_strategy, right_strategy, metric, count(d) AS pairs, count(*) FILTER (WHERE d < -1e-9) AS left_wins, count(*) FILTER (WHERE abs(d) <= 1e-9) AS ties,
        count(*) FILTER (WHERE d > 1e-9) AS right_wins, round(avg(d), 6) + 0.0 AS mean_delta FROM x GROUP BY 1, 2, 3, 4""",
)
def evl_paired_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    out = _rounded(ev.paired_comparisons(evaluation_rows(spark, sf), ("recall_at_5", "mrr")))
    return out.withColumn("mean_delta", F.col("mean_delta") + F.lit(0.0))


_CURVE = _ROWS + """, g AS (SELECT unnest(range(0, 101, 5)) / 100.0 AS threshold),
cal AS (SELECT *, CASE WHEN (n + s) % 9 <> 0 THEN score ELSE 0.0 END AS top FROM rows WHERE split = 'calibration' AND strategy = 'hybrid_rerank' AND NOT has_error),
curve AS (SELECT CAST(threshold AS DOUBLE) AS threshold, (avg(CASE WHEN top >= threshold THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT should_refuse) + avg(CASE WHEN top < threshold THEN 1.0 ELSE 0.0 END) FILTER (WHERE should_refuse)) / 2 AS balanced,
  count(*) AS cases FROM g, cal GROUP BY 1)
"""


@query("evl_calibration_curve", _CURVE + "SELECT threshold, round(balanced, 6) AS balanced_accuracy FROM curve")
def evl_calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return ev.calibration_curve(evaluation_rows(spark, sf)).select("threshold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("evl_calibrate_threshold", _CURVE + "SELECT threshold, round(balanced, 6) AS balanced_accuracy, cases AS calibration_cases FROM curve ORDER BY round(balanced, 9) DESC, threshold LIMIT 1")
def evl_calibrate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.calibrate_threshold(evaluation_rows(spark, sf)))


@query(
    "evl_sweep_faq_thresholds",
    f"""WITH {DENSE}, cs AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'miss' ELSE 'hit' END AS expected FROM q),
        j AS (SELECT cs.query_id, max(CASE WHEN expected = 'miss' OR dense.relevant THEN score END) AS best FROM cs LEFT JOIN dense ON dense.query_id = cs.query_id AND rank <= 5 GROUP BY 1),
        g AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6]) AS threshold),
        s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE expected = 'hit' AND best >= threshold) AS answer_source_correct, count(*) FILTER (WHERE expected = 'hit') AS positive_cases,
          count(*) FILTER (WHERE expected = 'miss' AND best >= threshold) AS negative_false_positives, count(*) FILTER (WHERE expected = 'miss') AS negative_cases FROM cs JOIN j USING (query_id), g GROUP BY 1)
        SELECT *, round(answer_source_correct / positive_cases, 6) AS positive_recall, round(negative_false_positives / negative_cases, 6) AS negative_false_positive_rate,
          (SELECT max(threshold) FROM s WHERE answer_source_correct = positive_cases AND negative_false_positives = 0) AS selected_threshold FROM s""",
)
def evl_sweep_faq_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = query_vectors(spark, sf), corpus_vectors(spark, sf)
    hits = rt.dense_topk(queries, corpus, 5).withColumnRenamed("query_id", "case_id")
    label = F.col("label").cast("string")
    cases = queries.select(
        F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 3 == 0, "miss").otherwise("hit").alias("expected"),
        F.concat(F.lit("kb/label"), label, F.lit(".md")).alias("source"), F.concat(F.lit("<"), label, F.lit(">")).alias("answer_contains"),
    )
    chunks = corpus.select(
        F.col("chunk_id").alias("id"), F.concat(F.lit("doc:label"), label, F.lit(".md:0")).alias("source_key"), F.concat(F.lit("a <"), label, F.lit(">")).alias("answer")
    )
    return _rounded(ev.sweep_faq_thresholds(cases, hits, chunks, [0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6]))


# --- judges and replay -----------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    count = (n % 4).cast("int")
    numbers = F.slice(F.sequence(F.lit(1), F.lit(4)), F.lit(1), count)
    claims = F.transform(numbers, lambda i: F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("claim"), ((n + i) % 3 > 0).alias("supported"), F.concat(F.lit("r"), n.cast("string")).alias("reason")))
    facts = F.transform(numbers, lambda i: F.struct(
        F.when((n % 6 == 5) & (i == 2), F.lit(0)).otherwise(i - 1).alias("index"), ((n + i) % 3 > 0).alias("covered"), ((n + i) % 7 == 0).alias("contradicted"), F.concat(F.lit("f"), i.cast("string")).alias("reason")))
    return ad.messages(spark, sf).select(
        "id", claims.alias("claims"), facts.alias("facts"), count.alias("n_required"), (n % 5 == 0).alias("should_refuse"), (n % 10 < 2).alias("refused")
    )


@query(
    "evl_faithfulness_score",
    ad.with_cte("messages") + """, c AS (SELECT id, unnest(range(1, id % 4 + 1)) AS i FROM messages)
      SELECT m.id, CASE WHEN m.id % 4 > 0 THEN round(count(*) FILTER (WHERE (m.id + i) % 3 > 0) / (m.id % 4), 6) END AS score,
        CASE WHEN m.id % 4 = 0 THEN '没有可核查事实声明' ELSE coalesce(string_agg('c' || i || '：r' || m.id, '；' ORDER BY i) FILTER (WHERE (m.id + i) % 3 = 0), '') END AS reason
      FROM messages m LEFT JOIN c USING (id) GROUP BY m.id""",
)
def evl_faithfulness_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_judged(spark, sf).select("id", *[c.alias(k) for k, c in ev.faithfulness_score("claims").items()]))


@query(
    "evl_correctness_score",
    ad.with_cte("messages") + """, m AS (SELECT id, id % 4 AS n, id % 5 = 0 AS should, id % 10 < 2 AS did, CASE WHEN id % 5 = 0 OR id % 10 < 2 THEN NULL WHEN id % 4 = 0 THEN 'facts_required'
          WHEN id % 6 = 5 AND id % 4 >= 2 THEN 'missing_or_duplicate_fact_index' END AS error FROM messages),
        g AS (SELECT id, count(*) FILTER (WHERE (id + i) % 3 > 0 AND (id + i) % 7 <> 0) AS good, coalesce(string_agg('f' || i, '；' ORDER BY i) FILTER (WHERE NOT ((id + i) % 3 > 0 AND (id + i) % 7 <> 0)), '') AS wrong
          FROM (SELECT id, unnest(range(1, id % 4 + 1)) AS i FROM messages) GROUP BY 1)
      SELECT m.id, CASE WHEN should OR did THEN CAST(should = did AS DOUBLE) WHEN error IS NULL THEN CAST(good = n AS DOUBLE) END AS score,
        CASE WHEN NOT (should OR did) AND error IS NULL THEN round(good / n, 6) END AS fact_coverage,
        CASE WHEN should OR did THEN '按应否拒答标注核对' WHEN error IS NULL THEN wrong END AS reason, error FROM m LEFT JOIN g USING (id)""",
)
def evl_correctness_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.correctness_score("facts", "n_required", "should_refuse", "refused")
    return _rounded(_judged(spark, sf).select("id", *[c.alias(k) for k, c in scored.items()]))


@query(
    "evl_combine_verdicts",
    _ROWS + """, v AS (SELECT eval_id, strategy, refused, CASE WHEN NOT refused THEN CASE WHEN n % 8 = 0 THEN 'missing_verdict' WHEN n % 8 = 1 THEN 'Timeout' END END AS fe,
        CASE WHEN n % 9 = 0 THEN 'missing_verdict' WHEN n % 9 = 1 THEN 'ValueError' END AS ce, score FROM rows)
      SELECT eval_id, strategy, CASE WHEN NOT refused AND fe IS NULL THEN score END AS faithfulness, CASE WHEN ce IS NULL THEN score END AS correctness, coalesce(fe, ce) AS error,
        CASE WHEN fe IS NOT NULL THEN 'faithfulness_judge' WHEN ce IS NOT NULL THEN 'correctness_judge' END AS error_stage FROM v""",
)
def evl_combine_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation_rows(spark, sf)
    n = F.substring("eval_id", 2, 20).cast("bigint")
    position = F.array_position(F.array(*map(F.lit, rt.STRATEGIES)), F.col("strategy")) - 1
    score = F.round(((n * 7 + position * 13) % 100) / F.lit(100.0), 6)
    base = rows.select("eval_id", "strategy", n.alias("n"), score.alias("score"))
    faith = base.filter("n % 8 <> 0").select("eval_id", "strategy", "score", F.when(F.col("n") % 8 == 1, "Timeout").alias("error"))
    right = base.filter("n % 9 <> 0").select("eval_id", "strategy", "score", F.col("score").alias("fact_coverage"), F.when(F.col("n") % 9 == 1, "ValueError").alias("error"))
    out = ev.combine_verdicts(rows.select("eval_id", "strategy", "refused"), faith, right)
    return out.select("eval_id", "strategy", "faithfulness", "correctness", "error", "error_stage")


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.lit("t")
    listed = F.array(F.lit("x"))
    base = {
        "eval_id": F.when(n % 23 == 22, F.lit("E-twice")).otherwise(F.concat(F.lit("E"), n.cast("string"))), "query": text, "strategy": F.lit("dense"), "split": F.lit("test"), "bucket": F.col("lang"),
        "difficulty": F.lit("easy"), "should_refuse": F.lit(False), "required_facts": listed, "answer": text, "citations": listed, "refused": F.lit(False), "metrics": F.struct(F.lit(1.0).alias("mrr")),
    }
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in base.items()]))
    typed = F.to_json(F.struct(*[(F.lit("no") if k == "refused" else c).alias(k) for k, c in base.items()]))
    short = F.to_json(F.struct(*[c.alias(k) for k, c in base.items() if k != "metrics"]))
    line = F.when(n % 10 == 1, F.lit("{oops")).when(n % 10 == 2, typed).when(n % 10 == 3, short).when(n % 10 == 4, F.lit(" ")).otherwise(whole)
    return ad.documents(spark, sf).select(n.alias("row_number"), line.alias("value"))


@query(
    "evl_validate_replay",
    """WITH r AS (SELECT doc_id AS row_number, CASE doc_id % 10 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_types' WHEN 3 THEN 'missing_fields' END AS p, CASE WHEN doc_id % 23 = 22 THEN 'E-twice' ELSE 'E' || doc_id END AS e FROM documents WHERE doc_id % 10 <> 4)
       SELECT row_number, coalesce(p, CASE WHEN e = 'E-twice' AND (SELECT count(*) FROM r x WHERE x.e = 'E-twice' AND coalesce(x.p, '') <> 'invalid_json') > 1 THEN 'duplicate_pair' END) AS problem FROM r""",
)
def evl_validate_replay(spark: SparkSession, sf: str) -> DataFrame:
    return ev.validate_replay(_replay(spark, sf)).select("row_number", "problem")


@query(
    "evl_select_rejudge",
    _ROWS + """, x AS (SELECT eval_id, strategy, CASE WHEN e = 0 THEN 'Timeout' WHEN e = 1 THEN 'ValueError' END AS error, CASE WHEN e = 0 THEN 'generation' WHEN e = 1 THEN 'correctness_judge' END AS stage FROM rows)
      SELECT eval_id, strategy, error AS previous_error, stage AS previous_error_stage, coalesce(stage <> 'generation', true) AS rejudge, CASE WHEN stage = 'generation' THEN error END AS error FROM x""",
)
def evl_select_rejudge(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation_rows(spark, sf).withColumn("error_stage", F.when(F.col("error") == "Timeout", "generation").otherwise(F.col("error_stage")))
    return ev.select_rejudge(rows).select("eval_id", "strategy", "previous_error", "previous_error_stage", "rejudge", "error")


@query(
    "evl_latency_report",
    "SELECT event_type AS strategy, count(*) AS cases, round(avg(value), 6) AS latency_seconds, round(avg(value / 2), 6) AS recall_seconds FROM events GROUP BY 1",
)
def evl_latency_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_input(spark, sf, "events").select(F.col("event_type").alias("strategy"), F.col("value").alias("latency_seconds"), (F.col("value") / 2).alias("recall_seconds"))
    return _rounded(ev.latency_report(rows, ("recall_seconds",)).drop("quantiles", "rank_error"))


@query(
    "evl_latency_quantiles",
    """WITH r AS (SELECT event_type AS strategy, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT strategy, max(value) FILTER (WHERE i = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE i = ceil(n * 0.95)) AS p95 FROM r GROUP BY 1""",
)
def evl_latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_input(spark, sf, "events").select(F.col("event_type").alias("strategy"), F.col("value").alias("latency_seconds"))
    report = ev.exact_quantiles(rows, "latency_seconds", ("0.5", "0.95"))
    return report.select("strategy", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p95"))


@query(
    "evl_latency_sketches",
    """WITH r AS (SELECT event_type AS strategy, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT strategy, n, true AS p50_near, true AS p95_near, true AS p99_near FROM r""",
)
def evl_latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of each day, stored, merged by strategy, and held against exact ranks: the rows below a quantile and up to it enclose its rank within the stated error."""
    rows = read_input(spark, sf, "events").select(F.col("event_type").alias("strategy"), F.to_date("ts").alias("day"), F.col("value").alias("latency_seconds"))
    stored = materialize(ev.latency_sketches(rows, ("strategy", "day")), "latency-sketches")
    wanted = (0.5, 0.95, 0.99)
    merged = materialize(ev.merge_sketches(stored, ("strategy",), wanted), "latency-merged")
    placed = rows.where("latency_seconds is not null").join(F.broadcast(merged), "strategy")  # a row per strategy
    counts = placed.groupBy("strategy", "n", "rank_error").agg(
        *[F.count_if(F.col("latency_seconds") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(3)],
        *[F.count_if(F.col("latency_seconds") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)],
    )
    near = lambda i: (F.col(f"below{i}") <= F.col("n") * (wanted[i] + F.col("rank_error"))) & (F.col(f"upto{i}") >= F.col("n") * (wanted[i] - F.col("rank_error")))
    return counts.select("strategy", "n", near(0).alias("p50_near"), near(1).alias("p95_near"), near(2).alias("p99_near"))


# --- datasets --------------------------------------------------------------


def _dataset(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as labelled cases with every kind of fault."""
    n = F.col("doc_id")
    docs = ad.documents(spark, sf)
    key = F.concat(F.lit("doc:k"), n.cast("string"))
    none = F.array().cast("array<string>")
    refuse = n % 5 == 3
    cases = docs.select(
        F.when(n % 101 == 7, F.lit("E7")).otherwise(F.concat(F.lit("E"), n.cast("string"))).alias("eval_id"),
        F.when(n % 5 == 3, "D_unknown").otherwise(F.get(F.array(*[F.lit(b) for b in ev.BUCKETS]), (n % 5).cast("int"))).alias("bucket"),
        F.when(n % 53 == 4, "extreme").otherwise(F.get(F.array(*map(F.lit, ev.DIFFICULTIES)), (n % 3).cast("int"))).alias("difficulty"),
        F.when(n % 4 == 0, "calibration").otherwise("test").alias("split"), F.concat(F.lit("query "), n.cast("string")).alias("query"),
        F.when(n % 6 == 0, F.col("lang")).alias("category"), F.when(refuse, none).when(n % 31 == 0, F.array(F.lit("doc:nowhere"))).otherwise(F.array(key)).alias("relevant_source_keys"),
        F.when(refuse | (n % 37 == 1), none).otherwise(F.array(F.lit("fact"))).alias("required_facts"), refuse.alias("should_refuse"),
        F.concat(F.lit("t"), F.floor(n / 7).cast("string")).alias("topic_id"), F.when(n % 9 != 0, F.concat(F.lit("f"), (n % 40 + F.when(n == 5, 1).otherwise(0)).cast("string"))).alias("family_id"),
        F.when(n % 41 == 2, none).otherwise(F.array(F.lit("tag"))).alias("challenge_tags"), F.when(n % 43 == 6, F.array(key)).when(n % 43 == 8, F.array(F.lit("doc:gone"))).otherwise(none).alias("distractor_source_keys"),
        F.when(n % 10 == 3, "why").alias("refusal_rationale"),
    )
    sources = docs.select(key.alias("source_key"), F.when(n % 12 == 0, F.lit("other")).otherwise(F.col("lang")).alias("category"))
    return cases, sources


@query(
    "evl_validate_dataset",
    """WITH c AS (SELECT *, doc_id AS n, CASE WHEN doc_id % 101 = 7 THEN 'E7' ELSE 'E' || doc_id END AS eval_id, doc_id % 5 = 3 AS refuse, doc_id % 9 <> 0 AS fam, CASE WHEN doc_id % 4 = 0 THEN 'calibration' ELSE 'test' END AS split,
         ['A_policy', 'B_model', 'C_colloquial', 'D_unknown', 'E_multi'][doc_id % 5 + 1] AS bucket FROM documents)
       SELECT 'invalid_enum' AS rule, eval_id FROM c WHERE n % 53 = 4
       UNION ALL SELECT 'facts_required', eval_id FROM c WHERE NOT refuse AND n % 37 = 1
       UNION ALL SELECT 'gold_and_distractor_overlap', eval_id FROM c WHERE fam AND n % 43 = 6 AND NOT refuse AND n % 31 <> 0
       UNION ALL SELECT 'missing_challenge_tags', eval_id FROM c WHERE fam AND n % 41 = 2
       UNION ALL SELECT 'refusal_rationale_required', eval_id FROM c WHERE fam AND refuse AND n % 10 <> 3
       UNION ALL SELECT DISTINCT 'missing_gold_source', eval_id FROM c WHERE NOT refuse AND n % 31 = 0
       UNION ALL SELECT DISTINCT 'missing_distractor_source', eval_id FROM c WHERE fam AND n % 43 = 8
       UNION ALL SELECT DISTINCT 'gold_outside_category', eval_id FROM c WHERE fam AND n % 12 = 0 AND NOT refuse AND n % 31 <> 0
       UNION ALL SELECT 'duplicate_eval_id', eval_id FROM c GROUP BY eval_id HAVING count(*) > 1
       UNION ALL SELECT 'family_leak', f FROM (SELECT 'f' || (n % 40 + CASE WHEN n = 5 THEN 1 ELSE 0 END) AS f, split FROM c WHERE fam) GROUP BY f HAVING count(DISTINCT split) > 1
       UNION ALL SELECT 'topic_leak', 't' || (n // 7) FROM c GROUP BY 2 HAVING count(DISTINCT split) > 1""",
)
def evl_validate_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return ev.validate_dataset(*_dataset(spark, sf), minimum=300)


@query(
    "evl_split_leakage",
    "SELECT source, min(lang) AS first_split, max(lang) AS last_split FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1",
)
def evl_split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return ev.split_leakage(ad.documents(spark, sf).withColumnRenamed("lang", "split"), "source")


@query(
    "evl_corpus_digest",
    """WITH h AS (SELECT sha256('vk' || doc_id || chr(0) || coalesce('v' || text, 'n')) AS h FROM documents),
       s AS (SELECT count(*) AS n, """
    + ", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(5))
    + """ FROM h) SELECT n AS n_chunks, sha256(concat_ws('-', CAST(n AS VARCHAR), s0, s1, s2, s3, s4)) AS digest FROM s""",
)
def evl_corpus_digest(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents(spark, sf).select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_key"), F.col("text").alias("answer"))
    return ev.corpus_digest(docs)


_TREE_LEVELS = """WITH h AS (SELECT doc_id, sha256('vk' || doc_id || chr(0) || coalesce('v' || text, 'n')) AS h FROM documents),
       l0 AS (SELECT doc_id >> 6 AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id)) AS d FROM h GROUP BY 1)""" + "".join(
    f", l{i + 1} AS (SELECT block >> 6 AS block, sum(n) AS n, sha256(string_agg(d, '' ORDER BY block)) AS d FROM l{i} GROUP BY 1)" for i in range(11)
)


@query(
    "evl_corpus_tree",
    _TREE_LEVELS + """, whole AS (SELECT 'kept' AS name, CAST(n AS BIGINT) AS n_chunks, sha256(d) AS digest, CAST([] AS BIGINT[]) AS blocks FROM l11)
    SELECT name, n_chunks, digest, '' AS blocks FROM whole UNION ALL SELECT 'swapped', n_chunks, NULL, '0,1' FROM whole UNION ALL
    SELECT 'edited', n_chunks, NULL, '2' FROM whole UNION ALL SELECT 'shorter', n_chunks - 1, NULL, '0' FROM whole""",
)
def evl_corpus_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus in the order of its documents, and what its stored leaves say of a swap of two rows, an edit and a loss: which blocks differ.

    The digest is shown where the corpus is the stored one; elsewhere it must differ (null).
    """
    docs = ad.documents(spark, sf).select(
        "doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_key"), F.col("text").alias("answer"), F.col("doc_id").alias("draft_order")
    )
    n = F.col("doc_id")
    swapped = docs.withColumn("draft_order", F.when(n == 5, 70).when(n == 70, 5).otherwise(n).cast("bigint"))
    edited = docs.withColumn("answer", F.when(n == 130, F.concat(F.coalesce("answer", F.lit("")), F.lit("."))).otherwise(F.col("answer")))
    shorter = docs.where(n != 63)
    stored = materialize(ev.corpus_leaves(docs, bits=6), "corpus-leaves")
    before = ev.corpus_root(stored, 6).select(F.col("digest").alias("was"))

    def told(name: str, df: DataFrame) -> DataFrame:
        now = materialize(ev.corpus_leaves(df, bits=6), "corpus-leaves")
        blocks = ev.changed_blocks(stored, now).agg(F.array_join(F.array_sort(F.collect_list("block")).cast("array<string>"), ",").alias("blocks"))
        same = F.col("digest") == before.scalar()
        wrong = same if name != "kept" else ~same
        return ev.corpus_root(now, 6).select(F.lit(name).alias("name"), "n_chunks", F.when(wrong, "wrong").when(same, F.col("digest")).alias("digest"), blocks.scalar().alias("blocks"))

    return told("kept", docs).unionByName(told("swapped", swapped)).unionByName(told("edited", edited)).unionByName(told("shorter", shorter))


@query(
    "evl_check_manifest",
    """WITH n AS (SELECT count(*) AS n FROM documents)
       SELECT 'kept' AS name, n AS n_chunks, n AS now_chunks, 'same' AS status FROM n UNION ALL
       SELECT 'shorter', n - 1, n, 'count_differs' FROM n UNION ALL SELECT 'edited', n, n, 'digest_differs' FROM n UNION ALL
       SELECT 'hidden', n, n, 'digest_differs' FROM n""",
)
def evl_check_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus against manifests of itself, of one row less, of one edited text and of one text made NULL."""
    docs = ad.documents(spark, sf).select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_key"), F.col("text").alias("answer"))
    one = F.col("source_key") == "k7"
    edited = docs.withColumn("answer", F.when(one, F.concat("answer", F.lit("."))).otherwise(F.col("answer")))
    hidden = docs.withColumn("answer", F.when(~one, F.col("answer")))
    entry = lambda name, df, less=0: ev.corpus_digest(df).select(F.lit(name).alias("name"), (F.col("n_chunks") - less).alias("n_chunks"), "digest")
    manifest = entry("kept", docs).unionByName(entry("shorter", docs, 1)).unionByName(entry("edited", edited)).unionByName(entry("hidden", hidden))
    return ev.check_manifest(ev.corpus_digest(docs), manifest).select("name", "n_chunks", "now_chunks", "status")


@query(
    "evl_step_checks",
    """WITH s AS (SELECT conv_id * 1000000000 + turn AS id, (conv_id + turn) % 6 AS k, coalesce(text, '') AS answer, length(coalesce(text, '')) AS n FROM conversations),
    c AS (
      SELECT id, 'tool_calls' AS name, n % 2 = 0 AS ok FROM s WHERE k = 0 UNION ALL
      SELECT id, 'preview', (n % 3 = 0) = (n % 2 = 0) FROM s WHERE k = 1 UNION ALL
      SELECT id, 'preview_content', n % 3 = 0 AND contains(answer, 'the') FROM s WHERE k = 1 UNION ALL
      SELECT id, 'answer_content', contains(answer, 'the') OR contains(answer, 'er') FROM s WHERE k = 2 UNION ALL
      SELECT id, 'forbidden_content_absent', NOT contains(answer, 'an') FROM s WHERE k = 2 UNION ALL
      SELECT id, 'forbidden_tools_absent', n % 2 <> 0 FROM s WHERE k = 3 UNION ALL
      SELECT id, 'invalid_arguments_audited', n % 5 = 0 FROM s WHERE k = 3 UNION ALL
      SELECT id, 'forbidden_tool_denied', n % 7 = 0 FROM s WHERE k = 4 UNION ALL
      SELECT id, 'ticket_count_delta', n % 4 = 1 FROM s WHERE k = 4 UNION ALL
      SELECT id, 'audit_status', n % 3 = 1 FROM s WHERE k = 5 UNION ALL
      SELECT id, 'no_sse_error', false FROM s WHERE n % 11 = 0)
    SELECT id, name AS "check", ok FROM c""",
)
def evl_step_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as steps: what is expected goes by position, what happened by the text."""
    raw = read_input(spark, sf, "conversations")
    text = F.coalesce("text", F.lit(""))
    k, n = (F.col("conv_id") + F.col("turn")) % 6, F.length(text)
    words = lambda *w: F.array(*map(F.lit, w))
    expected = F.struct(
        F.when(k == 0, words("lookup")).alias("tool_calls"), F.when(k == 1, n % 2 == 0).alias("preview"), F.when(k == 1, words("the")).alias("preview_any"),
        F.when(k == 2, words("the", "er")).alias("answer_any"), F.when(k == 2, words("an")).alias("forbidden_any"),
        F.when(k == 3, words("lookup", "other")).alias("forbidden_tools"), F.when(k == 3, F.lit(True)).alias("invalid_arguments"),
        F.when(k == 4, F.lit(True)).alias("forbidden_tool"), F.when(k == 4, F.lit(1)).alias("ticket_count_delta"),
        F.when(k == 5, F.lit("denied")).alias("audit_status"),
    )
    preview = F.struct(F.lit("t").alias("ticket_type"), text.alias("description"))
    actual = F.struct(
        F.when(n % 2 == 0, words("lookup")).otherwise(words("none")).alias("tool_names"), text.alias("answer"), F.when(n % 3 == 0, F.array(preview)).alias("previews"),
        (n % 5 == 0).alias("invalid_arguments"), (n % 7 == 0).alias("forbidden_tool"), (n % 4).alias("ticket_count_delta"),
        F.when(n % 3 == 1, words("ok", "denied")).alias("audit_statuses"), (n % 11 == 0).alias("has_error_event"),
    )
    steps = raw.select((F.col("conv_id") * ad.TURNS + F.col("turn")).alias("id"), expected.alias("expected"), actual.alias("actual"))
    return steps.select("id", F.explode(ev.step_checks()).alias("check", "ok"))


# --- routing and workflow reports ------------------------------------------


def _intent_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    names = F.array(F.lit("物流"), F.lit("订单"), F.lit("其他"))
    return read_input(spark, sf, "labels").select(
        n, F.get(names, (n % 3).cast("int")).alias("expected"), F.when(n % 7 == 0, F.lit(None)).otherwise(F.get(names, ((n + F.col("toxic")) % 3).cast("int"))).alias("actual"),
        F.when(n % 7 == 0, "ValueError").alias("error"),
    )


@query(
    "evl_intent_accuracy",
    """SELECT ['物流', '订单', '其他'][doc_id % 3 + 1] AS expected, count(*) AS total, count(*) FILTER (WHERE doc_id % 7 <> 0 AND toxic = 0) AS correct, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors,
         round(avg(CASE WHEN doc_id % 7 <> 0 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY 1""",
)
def evl_intent_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.intent_accuracy(_intent_rows(spark, sf), ["expected"]))


@query(
    "evl_confusion",
    """WITH r AS (SELECT ['物流', '订单', '其他'][doc_id % 3 + 1] AS expected, CASE WHEN doc_id % 7 > 0 THEN ['物流', '订单', '其他'][(doc_id + toxic) % 3 + 1] END AS actual FROM labels)
       SELECT expected, count(*) FILTER (WHERE actual = '物流') AS "物流", count(*) FILTER (WHERE actual = '订单') AS "订单", count(*) FILTER (WHERE actual = '其他') AS "其他" FROM r GROUP BY 1""",
)
def evl_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(_intent_rows(spark, sf), ["物流", "订单", "其他"])


@query(
    "evl_reference_report",
    ad.with_cte("messages") + """SELECT count(*) AS case_count, count(*) FILTER (WHERE id % 10 > 0) AS intent_json_valid, round(avg(CASE WHEN id % 4 > 0 THEN 1.0 ELSE 0.0 END), 6) AS intent_accuracy,
      count(*) FILTER (WHERE id % 9 > 0) AS reference_json_valid, round(avg(CASE WHEN id % 5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS reference_query_exact, round(avg(CASE WHEN id % 6 > 0 THEN 1.0 ELSE 0.0 END), 6) AS reference_status_accuracy
      FROM messages WHERE role = 'user'""",
)
def evl_reference_report(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    rows = ad.messages(spark, sf).filter("role = 'user'").select(
        (n % 10 > 0).alias("intent_json_valid"), (n % 9 > 0).alias("reference_json_valid"), F.when(n % 4 > 0, "订单").alias("intent"), F.lit("订单").alias("expected_intent"),
        F.when(n % 5 > 0, F.col("content")).otherwise(F.concat("content", F.lit("?"))).alias("resolved_query"), F.col("content").alias("expected_query"),
        (n % 6 > 0).alias("reference_resolved"), F.lit(True).alias("expected_resolved"),
    )
    return _rounded(ev.reference_report(rows))


@query(
    "evl_expansion_report",
    ad.with_cte("messages") + """, u AS (SELECT id FROM messages WHERE role = 'user')
      SELECT count(*) AS case_count, count(*) FILTER (WHERE id % 7 IN (0, 3)) AS query_json_valid, round(avg(CASE WHEN id % 7 IN (0, 3) THEN 1.0 ELSE 0.0 END), 6) AS query_json_valid_rate, 1.0 AS distinct_query_rate,
        count(*) AS fallback_included, round(avg(CASE WHEN id % 7 IN (0, 3) THEN 3 ELSE 1 END), 6) AS mean_queries FROM u""",
)
def evl_expansion_report(spark: SparkSession, sf: str) -> DataFrame:
    users = ad.messages(spark, sf).filter("role = 'user'").select("id", tx.strip("content").alias("question"))
    valid = (F.col("id") % 7).isin(0, 3)
    raw = F.when(valid, F.lit('{"queries":["return window","opened goods"]}')).otherwise(F.lit('{"queries":"x"}'))
    rows = users.withColumns({"queries": rt.parse_expansions(raw, F.col("question")), "json_valid": valid})
    return _rounded(ev.expansion_report(rows))


@query(
    "evl_assertion_checks",
    ad.with_cte("messages") + r""", t AS (SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS o FROM messages),
      k AS (SELECT id, length(o) <= 250 AS l, contains(o, 'e') AND (contains(o, 'th') OR contains(o, 'la')) AS r, NOT contains(o, 'zz') AND NOT contains(o, 'ou') AS f, id % 4 > 0 AS a FROM t)
      SELECT id, l AS length_at_most_250, r AS required_present, f AS forbidden_absent, a AS actual_input_tokens_available, l AND r AND f AND a AS passed FROM k""",
)
def evl_assertion_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.messages(spark, sf).withColumn("actual", F.when(F.col("id") % 4 > 0, F.length("content")))
    checks = ev.assertion_checks(
        "content", F.array(F.lit("e")), F.array(F.array(F.lit("th"), F.lit("la"))), F.array(F.lit("zz"), F.lit("ou")), "actual"
    )
    return rows.select("id", *[c.alias(k) for k, c in checks.items()])


@query(
    "evl_token_calibration",
    f"""WITH d AS (SELECT {TOKENS_SQL.format("text", "1.0")} AS est, CASE WHEN doc_id % 3 > 0 THEN n_chars // 3 + 1 END AS act, 10 + doc_id % 5 AS cjk FROM documents),
        r AS (SELECT *, round(est / act, 4) AS ratio, est - act AS diff, CASE WHEN act IS NOT NULL THEN round(greatest(0.0, act - (est - cjk)) / cjk, 4) END AS sug FROM d)
        SELECT count(act) AS samples, round(avg(ratio), 4) AS mean_estimate_to_actual_ratio, round(avg(diff), 2) AS mean_estimate_minus_actual, round(avg(sug), 4) AS mean_implied_cjk_ratio FROM r""",
)
def evl_token_calibration(spark: SparkSession, sf: str) -> DataFrame:
    actual = F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("n_chars") / 3) + 1)
    rows = ad.documents(spark, sf).select(actual.alias("actual_tokens"), tx.estimate_tokens("text").alias("est"), (10 + F.col("doc_id") % 5).alias("cjk"))
    accounted = rows.withColumns(ev.token_accounting(F.col("est"), F.col("actual_tokens"), F.col("cjk")))
    return ev.token_calibration(accounted)


@query(
    "evl_check_matrix",
    """WITH c AS (SELECT event_type AS "check", value > 30 AS ok FROM events UNION ALL SELECT 'case_completed', event_type <> 'error' FROM events WHERE event_id % 2 = 0)
       SELECT "check", count(*) FILTER (WHERE ok) AS passed, count(*) AS denominator FROM c GROUP BY 1""",
)
def evl_check_matrix(spark: SparkSession, sf: str) -> DataFrame:
    own = F.create_map("event_type", F.col("value") > 30)
    both = F.map_concat(own, F.create_map(F.lit("case_completed"), F.col("event_type") != "error"))
    rows = read_input(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, both).otherwise(own).alias("checks"))
    return ev.check_matrix(rows)


def _workflow(spark: SparkSession, sf: str) -> DataFrame:
    """Events as workflow steps: case = user and block of events, one expected check per step."""
    n = F.col("event_id")
    events = read_input(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(n / 500).cast("string")).alias("case_id"), n.alias("step"),
        F.col("event_type").alias("check"), (F.col("value") > 5).alias("ok"), F.when((F.col("event_type") == "error") & (F.col("value") > 100), "sse").alias("error"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("ticket_delta"),
    )
    return ev.case_outcomes(events.select("case_id", "step", "check"), events.select("case_id", "step", "check", "ok"), events.select("case_id", "step", "error", "ticket_delta"))


_WORKFLOW = """WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || (event_id // 500) AS case_id, event_type, value > 5 AS ok, event_type = 'error' AND value > 100 AS failed FROM events),
o AS (SELECT case_id, CASE WHEN bool_or(failed) THEN 'error' ELSE 'completed' END AS status, count(*) FILTER (WHERE event_type = 'purchase') AS ticket_delta, count(*) + 1 AS n_checks,
  count(*) FILTER (WHERE ok AND NOT failed) + CASE WHEN bool_or(failed) THEN 0 ELSE 1 END AS n_passed, bool_and(ok AND NOT failed) AS passed FROM e GROUP BY 1)
"""


@query("evl_case_outcomes", _WORKFLOW + "SELECT * FROM o")
def evl_case_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _workflow(spark, sf)


@query(
    "evl_outcome_summary",
    _WORKFLOW + """SELECT count(*) AS case_count, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE passed) AS passed,
      round(avg(CAST(passed AS DOUBLE)), 6) AS pass_rate, count(*) FILTER (WHERE ticket_delta > 0) AS cases_with_ticket_created, CAST(sum(ticket_delta) AS BIGINT) AS tickets_created_total FROM o""",
)
def evl_outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.outcome_summary(_workflow(spark, sf)))


@query(
    "evl_field_accuracy",
    """WITH f AS (SELECT CAST(o_orderkey % 3 > 0 AS INTEGER) + CAST(o_orderkey % 5 > 0 AS INTEGER) + 1 AS m FROM orders)
       SELECT count(*) FILTER (WHERE m = 3) AS passed, count(*) AS total, CAST(sum(m) AS BIGINT) AS field_matches, CAST(sum(m) * 100 // (count(*) * 3) AS BIGINT) AS field_accuracy FROM f""",
)
def evl_field_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    key = n.cast("string")
    rows = read_input(spark, sf, "orders").select(
        F.when(n % 3 > 0, key).alias("actual_order_id"), key.alias("expected_order_id"), F.when(n % 5 > 0, "退款").otherwise("换货").alias("actual_request_type"),
        F.lit("退款").alias("expected_request_type"), F.lit(None).cast("string").alias("actual_expected_solution"), F.lit(None).cast("string").alias("expected_expected_solution"),
    )
    return ev.field_accuracy(rows, ("order_id", "request_type", "expected_solution"))
