"""Registered queries: chat extraction and context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import context as cx
from supportlake.operators import conversations as cv
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.session import materialize
from supportlake.plans.text_queries import FINGERPRINT_SQL, MESSAGE_TOKENS_SQL, TOKENS_SQL

_TURNS = ad.with_cte("messages", "cursors", "user_turns")
_PENDING = _TURNS + """, pending AS (
  SELECT u.conversation_id, coalesce(max(c.last_message_id), 0) AS cursor, max(u.user_message_id) AS latest_user_id
  FROM user_turns u LEFT JOIN cursors c USING (conversation_id) GROUP BY u.conversation_id
  HAVING max(u.user_message_id) > coalesce(max(c.last_message_id), 0))"""
_ADVANCE = _TURNS + """, moved AS (
  SELECT u.conversation_id, max(coalesce(assistant_message_id, next_user_id - 1)) AS reach, count(assistant_message_id) AS n_turns
  FROM user_turns u LEFT JOIN cursors c USING (conversation_id)
  WHERE user_message_id > coalesce(c.last_message_id, 0) GROUP BY u.conversation_id),
advanced AS (
  SELECT m.conversation_id, coalesce(max(c.last_message_id), 0) AS cursor,
    CASE WHEN max(v.n_turns) IS NULL THEN max(m.id) ELSE greatest(max(v.reach), coalesce(max(c.last_message_id), 0)) END AS next_cursor,
    coalesce(max(v.n_turns), 0) AS n_turns
  FROM messages m LEFT JOIN cursors c USING (conversation_id) LEFT JOIN moved v USING (conversation_id)
  WHERE m.id > coalesce(c.last_message_id, 0) GROUP BY m.conversation_id)"""


@query("cnv_pending_conversations", _PENDING + " SELECT * FROM pending")
def cnv_pending_conversations(spark: SparkSession, sf: str) -> DataFrame:
    out = cv.pending_conversations(ad.messages(spark, sf), ad.cursors(spark, sf))
    return out.select("conversation_id", "cursor", "latest_user_id")


_PAIRS = _TURNS + """, pairs AS (
  SELECT t.conversation_id, user_message_id, assistant_message_id, u.content AS user_text, a.content AS assistant_text
  FROM user_turns t JOIN messages u ON u.id = user_message_id JOIN messages a ON a.id = assistant_message_id)"""


@query("cnv_pair_turns", _PAIRS + " SELECT * FROM pairs")
def cnv_pair_turns(spark: SparkSession, sf: str) -> DataFrame:
    return cv.pair_turns(ad.messages(spark, sf))


@query("cnv_advance_cursor", _ADVANCE + " SELECT * FROM advanced")
def cnv_advance_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return cv.advance_cursor(ad.messages(spark, sf), ad.cursors(spark, sf))


@query(
    "cnv_budget_batches",
    _PENDING + """, turns AS (
      SELECT p.conversation_id, p.latest_user_id, count(u.assistant_message_id) AS n_turns FROM pending p
      JOIN user_turns u ON u.conversation_id = p.conversation_id AND u.user_message_id > p.cursor GROUP BY 1, 2),
    b AS (SELECT *, CAST(coalesce(sum(n_turns) OVER (ORDER BY latest_user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turns_before FROM turns)
    SELECT conversation_id, n_turns, turns_before, least(n_turns, greatest(60 - turns_before, 0)) AS allowed_turns FROM b""",
)
def cnv_budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    messages, cursors = ad.messages(spark, sf), ad.cursors(spark, sf)
    pending = cv.pending_conversations(messages, cursors)
    turns = cv.advance_cursor(messages, cursors).select("conversation_id", "n_turns")
    out = cv.budget_batches(pending.join(turns, "conversation_id"), "n_turns", 60)
    return out.select("conversation_id", "n_turns", "turns_before", "allowed_turns")


@query(
    "cnv_batch_stats",
    _ADVANCE + """ SELECT m.conversation_id, count(*) AS messages_read,
      count(*) FILTER (WHERE m.role = 'tool' OR m.tool_calls IS NOT NULL) AS skipped_tool_messages
      FROM messages m JOIN advanced a USING (conversation_id) WHERE m.id > a.cursor AND m.id <= a.next_cursor GROUP BY 1""",
)
def cnv_batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    messages = ad.messages(spark, sf)
    return cv.batch_stats(messages, cv.advance_cursor(messages, ad.cursors(spark, sf)))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per paired turn, some broken on purpose."""
    pairs = cv.pair_turns(ad.messages(spark, sf))
    n = F.col("user_message_id") % 13
    index = (F.col("user_message_id") % ad.TURNS).cast("bigint")
    return pairs.select(
        F.col("conversation_id").alias("batch_id"),
        F.when(n == 4, F.lit(999_999_999).cast("bigint")).otherwise(index).alias("source_turn_index"),
        F.when(n == 6, F.lit(" ")).otherwise(F.concat(F.lit("topic "), F.col("conversation_id"))).alias("category"),
        F.when(n == 8, F.array(F.col("user_text"), F.lit(" "))).otherwise(F.array("user_text")).alias("questions"),
        F.col("assistant_text").alias("answer"),
    )


@query(
    "cnv_validate_candidates",
    _PAIRS + f""", c AS (
      SELECT conversation_id AS batch_id, user_message_id, CASE WHEN user_message_id % 13 = 4 THEN 999999999 ELSE user_message_id % {ad.TURNS} END AS source_turn_index,
        CASE user_message_id % 13 WHEN 4 THEN 'turn_outside_batch' WHEN 6 THEN 'category_length' WHEN 8 THEN 'question_blank' END AS violation FROM pairs)
    SELECT batch_id, source_turn_index, violation, bool_and(violation IS NULL) OVER (PARTITION BY batch_id) AS batch_ok FROM c""",
)
def cnv_validate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    turns = cv.pair_turns(ad.messages(spark, sf)).select(
        F.col("conversation_id").alias("batch_id"), (F.col("user_message_id") % ad.TURNS).alias("turn_index"),
        "user_message_id", "assistant_message_id",
    )
    checked = cv.validate_candidates(_candidates(spark, sf), turns)
    return checked.select("batch_id", "source_turn_index", "violation", "batch_ok")


def _doc_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as candidates: exact copies meet on the same source message."""
    docs = ad.documents_spread(spark, sf)
    return docs.select(
        F.col("doc_id").alias("candidate_id"), F.lit("copies").alias("category"), F.array(F.lit("q")).alias("questions"),
        F.col("text").alias("answer"), (F.col("doc_id") % 2).alias("source_user_message_id"),
    )


_DOC_FP = FINGERPRINT_SQL.format("'copies' || chr(10) || 'q' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')")


@query(
    "cnv_stage_candidates",
    f"""WITH f AS (SELECT doc_id, doc_id % 2 AS src, {_DOC_FP} AS fp FROM documents),
    staged AS (SELECT DISTINCT fp, src FROM f WHERE doc_id % 10 = 0)
    SELECT min(doc_id) AS candidate_id, src AS source_user_message_id, fp AS fingerprint FROM f
    WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.fp = f.fp AND s.src = f.src) GROUP BY fp, src""",
)
def cnv_stage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _doc_candidates(spark, sf)
    staged = rows.filter(F.col("candidate_id") % 10 == 0).select(
        tx.fingerprint("category", "questions", "answer").alias("fingerprint"), "source_user_message_id"
    )
    out = cv.stage_candidates(rows, staged)
    return out.select("candidate_id", "source_user_message_id", "fingerprint")


def _staging(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = ad.stored(spark, sf, "staging", lambda: _doc_candidates(spark, sf).withColumn(
        "fingerprint", tx.fingerprint("category", "questions", "answer")
    ))
    promoted = F.when(F.col("candidate_id") % 7 == 3, F.lit("2024-01-01"))
    staging = rows.select(F.col("candidate_id").alias("id"), "category", "questions", "answer", "fingerprint", promoted.alias("promoted_at"))
    chunks = rows.filter(F.col("candidate_id") % 9 == 0).select(
        F.col("fingerprint").alias("content_hash"), (F.col("candidate_id") % 2 == 0).alias("is_active")
    )
    return staging, chunks


_STAGED = f"""WITH f AS (SELECT doc_id, {_DOC_FP} AS fp FROM documents),
    active AS (SELECT DISTINCT fp FROM f WHERE doc_id % 9 = 0 AND doc_id % 2 = 0),
    waiting AS (SELECT * FROM f WHERE doc_id % 7 <> 3),
    fresh AS (SELECT fp, min(doc_id) AS id FROM waiting WHERE fp NOT IN (SELECT fp FROM active) GROUP BY fp)"""


@query("cnv_promote_staged", _STAGED + " SELECT 'conversation:' || fp AS source_key, id AS draft_order FROM fresh")
def cnv_promote_staged(spark: SparkSession, sf: str) -> DataFrame:
    return cv.promote_staged(*_staging(spark, sf)).select("source_key", "draft_order")


@query("cnv_promotion_counts", _STAGED + " SELECT (SELECT count(*) FROM waiting) - (SELECT count(*) FROM fresh) AS deduped, (SELECT count(*) FROM fresh) AS inserted")
def cnv_promotion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cv.promotion_counts(*_staging(spark, sf))


@query(
    "cnv_exact_dedup",
    f"""SELECT min(doc_id) AS doc_id, fp AS fingerprint FROM
        (SELECT doc_id, {FINGERPRINT_SQL.format("text")} AS fp FROM documents) GROUP BY fp""",
)
def cnv_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return cv.exact_dedup(ad.documents_spread(spark, sf), "text", "doc_id").select("doc_id", "fingerprint")


@query(
    "cnv_conversation_list",
    ad.with_cte("messages", "convs") + """, f AS (SELECT conversation_id, min(id) AS first_id FROM messages WHERE role = 'user' GROUP BY 1)
    SELECT c.user_id, c.conversation_id, c.created_at, substring(coalesce(m.content, ''), 1, 80) AS preview,
      c.summary_upto_msg_id IS NOT NULL AS has_summary, coalesce(f.first_id, 0) AS first_message_id
    FROM convs c LEFT JOIN f USING (conversation_id) LEFT JOIN messages m ON m.id = f.first_id""",
)
def cnv_conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    return cv.conversation_list(ad.conversations(spark, sf), ad.messages(spark, sf)).orderBy(
        "user_id", F.desc("created_at"), F.desc("first_message_id")
    )


@query(
    "cnv_conversation_thread",
    ad.with_cte("messages") + f""", shown AS (SELECT *, CASE WHEN role = 'assistant' AND id % 2 = 1 THEN 'req-' || id END AS rid
      FROM messages WHERE role IN ('user', 'assistant') AND tool_calls IS NULL)
    SELECT id, conversation_id, role, content, rid AS form_request_id, CASE WHEN rid IS NOT NULL AND id % 3 > 0 THEN rid END AS application_id,
      CASE WHEN rid IS NOT NULL AND id % 3 > 0 THEN 'recorded' END AS form_status FROM shown""",
)
def cnv_conversation_thread(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.concat(F.lit("req-"), F.col("id").cast("string"))
    offered = (F.col("role") == "assistant") & (F.col("id") % 2 == 1)
    form = F.to_json(F.struct(F.struct(rid.alias("request_id")).alias("refund_form")))
    messages = ad.messages(spark, sf).withColumn("actions", F.when(offered, form))
    refunds = messages.filter(F.col("actions").isNotNull()).select(
        rid.alias("request_id"), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-F.col("id")).alias("message_id"),
        "conversation_id", F.lit("recorded").alias("status"), F.lit("其他").alias("reason"),
    )
    out = cv.conversation_thread(messages, refunds)
    return out.select("id", "conversation_id", "role", "content", "form_request_id", "application_id", "form_status")


# --- context windows -------------------------------------------------------

BUDGET = 700
LAYER2_BUDGET = 60
SUMMARY_INPUT = 160

_GROUPS = ad.with_cte("messages", "convs") + """, turns AS (SELECT * FROM (
    SELECT *, max(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conversation_id ORDER BY id) AS turn_start FROM messages) WHERE turn_start IS NOT NULL)"""
_LAYER1 = _GROUPS + f""", cost AS (SELECT conversation_id, turn_start, CAST(sum({MESSAGE_TOKENS_SQL}) AS BIGINT) AS tokens FROM turns GROUP BY 1, 2),
suffix AS (SELECT c.conversation_id, c.turn_start, CAST(sum(c.tokens) OVER (PARTITION BY c.conversation_id ORDER BY c.turn_start DESC) AS BIGINT) AS s
  FROM cost c JOIN convs v USING (conversation_id)
  WHERE c.turn_start > coalesce(v.summary_upto_msg_id, 0) AND c.turn_start >= coalesce(v.layer1_from_msg_id, 0)),
fit AS (SELECT conversation_id, min(turn_start) AS start, max(s) AS tokens FROM suffix WHERE s <= {BUDGET} GROUP BY 1),
layer1 AS (SELECT v.conversation_id, v.summary_upto_msg_id, greatest(v.layer1_from_msg_id, coalesce(f.start, v.current_id)) AS layer1_from_msg_id,
  coalesce(f.tokens, 0) AS layer1_tokens FROM convs v LEFT JOIN fit f USING (conversation_id))"""
_LAYER2 = _LAYER1 + """, old AS (SELECT t.* FROM turns t JOIN layer1 l USING (conversation_id)
  WHERE t.turn_start > coalesce(l.summary_upto_msg_id, 0) AND t.turn_start < l.layer1_from_msg_id),
shortened AS (
  SELECT conversation_id, turn_start, id, role, CASE WHEN role = 'user' THEN content ELSE substring(content, 1, 60) END AS content,
    CASE WHEN role = 'user' THEN id ELSE id + 1 END AS position FROM old WHERE role = 'user' OR (role = 'assistant' AND tool_calls IS NULL AND content <> '')
  UNION ALL
  SELECT conversation_id, turn_start, NULL, 'assistant', '[工具结果：' || string_agg(tool_call_id, ', ' ORDER BY id) || '；详细观察保留于完整历史]',
    turn_start + 1 FROM old WHERE role = 'tool' GROUP BY 1, 2)"""


@query("ctx_turn_groups", _GROUPS + " SELECT id, conversation_id, role, turn_start FROM turns")
def ctx_turn_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cx.turn_groups(ad.messages(spark, sf)).select("id", "conversation_id", "role", "turn_start")


def _layer1(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # Grouped once and read by every later layer.
    turns = materialize(cx.turn_groups(ad.messages(spark, sf)), "turns")
    return turns, cx.layer1(turns, ad.conversations(spark, sf), BUDGET)


@query("ctx_layer1", _LAYER1 + " SELECT conversation_id, layer1_from_msg_id, layer1_tokens FROM layer1")
def ctx_layer1(spark: SparkSession, sf: str) -> DataFrame:
    return _layer1(spark, sf)[1].select("conversation_id", "layer1_from_msg_id", "layer1_tokens")


@query("ctx_layer2_shorten", _LAYER2 + " SELECT * FROM shortened")
def ctx_layer2_shorten(spark: SparkSession, sf: str) -> DataFrame:
    return cx.layer2_shorten(*_layer1(spark, sf))


_L2_TOKENS = f"""{TOKENS_SQL.format("content", "1.0")} + 6"""


@query(
    "ctx_layer2_overflow",
    _LAYER2 + f" SELECT conversation_id, CAST(sum({_L2_TOKENS}) AS BIGINT) AS layer2_tokens FROM shortened GROUP BY 1 HAVING sum({_L2_TOKENS}) > {LAYER2_BUDGET}",
)
def ctx_layer2_overflow(spark: SparkSession, sf: str) -> DataFrame:
    return cx.layer2_overflow(cx.layer2_shorten(*_layer1(spark, sf)), LAYER2_BUDGET)


@query(
    "ctx_summary_batch",
    _LAYER2 + f""", rendered AS (SELECT conversation_id, turn_start, chr(10) || CASE role WHEN 'user' THEN 'human' ELSE 'ai' END || ': ' || content AS line FROM shortened),
    per AS (SELECT conversation_id, turn_start, sum(len(regexp_extract_all(line, '[㐀-鿿]'))) AS cjk, sum(length(line)) AS chars FROM rendered GROUP BY 1, 2),
    pre AS (SELECT conversation_id, turn_start, CAST(ceil(sum(cjk) OVER w + (sum(chars) OVER w - sum(cjk) OVER w) / 4.0) AS BIGINT) AS tokens FROM per
      WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_start)),
    ends AS (SELECT turn_start, max(id) AS turn_end FROM old GROUP BY 1)
    SELECT conversation_id, min(turn_start) FILTER (WHERE tokens <= {SUMMARY_INPUT}) AS from_msg_id, max(turn_end) FILTER (WHERE tokens <= {SUMMARY_INPUT}) AS upto_msg_id,
      count(*) FILTER (WHERE tokens <= {SUMMARY_INPUT}) AS n_turns, max(tokens) FILTER (WHERE tokens <= {SUMMARY_INPUT}) AS input_tokens,
      CASE WHEN count(*) FILTER (WHERE tokens <= {SUMMARY_INPUT}) = 0 THEN 'turn_exceeds_summary_input' END AS error
    FROM pre JOIN ends USING (turn_start) GROUP BY 1""",
)
def ctx_summary_batch(spark: SparkSession, sf: str) -> DataFrame:
    turns, bounds = _layer1(spark, sf)
    return cx.summary_batch(cx.layer2_shorten(turns, bounds), turns, SUMMARY_INPUT)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant messages as stored summary segments."""
    return ad.messages(spark, sf).filter("role = 'assistant'").select(
        "conversation_id", (F.col("id") % ad.TURNS + 1).alias("segment"), "content"
    )


_SEGMENTS = ad.with_cte("messages", "convs") + f""", segs AS (SELECT conversation_id, id % {ad.TURNS} + 1 AS segment, content FROM messages WHERE role = 'assistant')"""


@query(
    "ctx_pick_summaries",
    _SEGMENTS + f""", s AS (SELECT *, sum({_L2_TOKENS}) OVER (PARTITION BY conversation_id ORDER BY segment DESC) AS suffix FROM segs)
    SELECT conversation_id, coalesce(string_agg(content, chr(10) ORDER BY segment) FILTER (WHERE suffix <= 300), '') AS summary,
      count(*) FILTER (WHERE suffix > 300) AS omitted FROM s GROUP BY 1""",
)
def ctx_pick_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return cx.summary_texts(cx.pick_summaries(_summaries(spark, sf), 300))


@query(
    "ctx_append_summary",
    _SEGMENTS + """, b AS (SELECT conversation_id, CASE WHEN CAST(conversation_id AS BIGINT) % 2 = 0 THEN summary_upto_msg_id END AS prev, summary_upto_msg_id AS cur FROM convs)
    SELECT b.conversation_id, coalesce((SELECT max(segment) FROM segs s WHERE s.conversation_id = b.conversation_id), 0) + 1 AS segment,
      coalesce(cur, 0) + 1 AS from_msg_id, coalesce(cur, 0) + 9 AS upto_msg_id FROM b WHERE prev IS NOT DISTINCT FROM cur""",
)
def ctx_append_summary(spark: SparkSession, sf: str) -> DataFrame:
    convs = ad.conversations(spark, sf)
    upto = F.coalesce("summary_upto_msg_id", F.lit(0))
    batches = convs.select(
        "conversation_id",
        F.when(F.col("conversation_id").cast("bigint") % 2 == 0, F.col("summary_upto_msg_id")).alias("previous_upto"),
        (upto + 1).alias("from_msg_id"), (upto + 9).alias("upto_msg_id"), F.lit("text").alias("content"),
    )
    return cx.append_summary(batches, convs, _summaries(spark, sf)).select("conversation_id", "segment", "from_msg_id", "upto_msg_id")


@query(
    "ctx_advance_anchor",
    ad.with_cte("convs") + f"""SELECT conversation_id, greatest(layer1_from_msg_id, (CAST(conversation_id AS BIGINT) * {ad.TURNS}) + CAST(conversation_id AS BIGINT) % 5) AS layer1_from_msg_id FROM convs""",
)
def ctx_advance_anchor(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("conversation_id").cast("bigint")
    new = number * ad.TURNS + number % 5
    return ad.conversations(spark, sf).select("conversation_id", cx.advance_anchor(F.col("layer1_from_msg_id"), new).alias("layer1_from_msg_id"))


@query(
    "ctx_cap_observation",
    """WITH d AS (SELECT doc_id, text, greatest(CAST(floor(400 / (doc_id % 3 + 1)) AS BIGINT), 1) AS allowance FROM documents)
       SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) > allowance
         THEN substring(text, 1, CAST(floor((allowance - (len(regexp_extract_all(n, '[㐀-鿿]')) + (length(n) - len(regexp_extract_all(n, '[㐀-鿿]'))) / 4.0)) * 4) AS BIGINT)) || n
         ELSE text END AS content FROM d, (SELECT '[工具观察超长，已按输入预算截短；完整结果保留在checkpoint]' AS n)""",
)
def ctx_cap_observation(spark: SparkSession, sf: str) -> DataFrame:
    calls = (F.col("doc_id") % 3 + 1)
    return ad.documents(spark, sf).select("doc_id", cx.cap_observation("text", 400, calls).alias("content"))


@query(
    "ctx_context_view",
    _LAYER2 + """ SELECT conversation_id, turn_start, role, content, position, CAST(2 AS INTEGER) AS layer FROM shortened UNION ALL
      SELECT t.conversation_id, t.turn_start, t.role, t.content, t.id, CAST(1 AS INTEGER) FROM turns t JOIN layer1 l USING (conversation_id) WHERE t.turn_start >= l.layer1_from_msg_id""",
)
def ctx_context_view(spark: SparkSession, sf: str) -> DataFrame:
    turns, bounds = _layer1(spark, sf)
    return cx.context_view(turns, bounds, cx.layer2_shorten(turns, bounds)).drop("id")


@query(
    "ctx_conversation_context",
    _LAYER2 + f""", view AS (SELECT conversation_id, 2 AS layer FROM shortened UNION ALL
      SELECT t.conversation_id, 1 FROM turns t JOIN layer1 l USING (conversation_id) WHERE t.turn_start >= l.layer1_from_msg_id),
    sizes AS (SELECT conversation_id, count(*) FILTER (WHERE layer = 2) AS n_layer2, count(*) FILTER (WHERE layer = 1) AS n_layer1 FROM view GROUP BY 1),
    segs AS (SELECT conversation_id, id % {ad.TURNS} + 1 AS segment, content FROM messages WHERE role = 'assistant'),
    s AS (SELECT *, sum({_L2_TOKENS}) OVER (PARTITION BY conversation_id ORDER BY segment DESC) AS suffix FROM segs),
    texts AS (SELECT conversation_id, coalesce(string_agg(content, chr(10) ORDER BY segment) FILTER (WHERE suffix <= 300), '') AS summary,
      count(*) FILTER (WHERE suffix > 300) AS omitted FROM s GROUP BY 1)
    SELECT conversation_id, coalesce(n_layer2, 0) AS n_layer2, coalesce(n_layer1, 0) AS n_layer1, coalesce(summary, '') AS summary, coalesce(omitted, 0) AS omitted
    FROM (SELECT conversation_id FROM layer1) LEFT JOIN sizes USING (conversation_id) LEFT JOIN texts USING (conversation_id)""",
)
def ctx_conversation_context(spark: SparkSession, sf: str) -> DataFrame:
    turns, bounds = _layer1(spark, sf)
    bounds = materialize(bounds, "bounds")
    view = cx.context_view(turns, bounds, cx.layer2_shorten(turns, bounds))
    return cx.conversation_context(bounds, view, cx.pick_summaries(_summaries(spark, sf), 300))


@query(
    "ctx_admission_check",
    ad.with_cte("messages") + f""", t AS (SELECT conversation_id, CAST(sum({MESSAGE_TOKENS_SQL}) AS BIGINT) AS input_tokens, count(*) * 50 AS used FROM messages GROUP BY 1)
    SELECT conversation_id, input_tokens, input_tokens + 200 + 50 <= 900 AS admitted,
      CASE WHEN 1200 - used - input_tokens >= 1 THEN least(512, 1200 - used - input_tokens) END AS output_allowance FROM t""",
)
def ctx_admission_check(spark: SparkSession, sf: str) -> DataFrame:
    totals = ad.messages(spark, sf).groupBy("conversation_id").agg(
        F.sum(tx.message_tokens("content", "tool_calls")).alias("input_tokens"), (F.count("*") * 50).alias("used")
    )
    out = cx.admission_check(totals, "input_tokens", 900, 200, 50, 1200, "used", 512)
    return out.select("conversation_id", "input_tokens", "admitted", "output_allowance")
