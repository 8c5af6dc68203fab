"""Registered queries: answer guarding, ledgers, routing, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.operators import guard as gd
from supportlake.operators import logs as lg
from supportlake.operators import routing as ro
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.sources.tables import read_input

# --- generated answers -----------------------------------------------------


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Raw model outputs built from assistant messages, in every valid and broken form."""
    rows = ad.messages(spark, sf).filter("role = 'assistant'").select("id", F.col("content").alias("t"))
    n = F.col("id") % 12
    text = F.regexp_replace("t", r"[\[\]]", "")

    def out(sufficient, reason, answer, cited) -> Column:
        return F.to_json(F.struct(
            F.lit(sufficient).alias("sufficient"), F.lit(reason).alias("reason"), answer.alias("answer"), cited.alias("cited_numbers"),
        ))

    raw = (
        F.when(n == 0, out(True, "ok", F.concat(text, F.lit(" [1][2]")), F.array(F.lit(1), F.lit(2))))
        .when(n == 1, out(True, "ok", F.concat(text, F.lit(" [1]")), F.array(F.lit(1), F.lit(2))))
        .when(n == 2, out(True, "ok", F.concat(text, F.lit(" [9]")), F.array(F.lit(9))))
        .when(n == 3, out(True, "ok", text, F.array(F.lit(1))))
        .when(n == 4, out(False, "missing facts", F.lit(""), F.array().cast("array<int>")))
        .when(n == 5, out(False, "", F.lit(""), F.array().cast("array<int>")))
        .when(n == 6, F.lit("{broken"))
        .when(n == 7, F.lit('{"sufficient":true,"reason":"r","answer":"a [1]"}'))
        .when(n == 8, F.lit('{"sufficient":"yes","reason":"r","answer":"a [2] [2]","cited_numbers":["2"]}'))
        .when(n == 9, F.lit('{"sufficient":true,"reason":3,"answer":"a","cited_numbers":[1]}'))
        .when(n == 10, out(True, "ok", F.lit(" "), F.array(F.lit(1))))
    )
    evidence = F.when(F.col("id") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")))
    return rows.select(
        "id", "t", raw.alias("raw"), evidence.alias("evidence_numbers"), (F.col("id") % 10 / F.lit(10.0)).alias("top_score"),
        F.when(F.col("id") % 2 == 0, "hybrid_rerank").otherwise("dense").alias("strategy"),
    )


_GEN = ad.with_cte("messages") + """, g AS (SELECT id, id % 12 AS n, regexp_replace(content, '[\\[\\]]', '', 'g') AS t FROM messages WHERE role = 'assistant'),
p AS (SELECT *, CASE n WHEN 6 THEN 'structured_output_parse_error' WHEN 7 THEN 'generation_result_schema_invalid' WHEN 9 THEN 'generation_result_schema_invalid' WHEN 11 THEN 'structured_output_missing' END AS failure,
  CASE WHEN n IN (0, 1, 2, 3, 8, 10) THEN true WHEN n IN (4, 5) THEN false END AS sufficient,
  CASE n WHEN 0 THEN t || ' [1][2]' WHEN 1 THEN t || ' [1]' WHEN 2 THEN t || ' [9]' WHEN 3 THEN t WHEN 4 THEN '' WHEN 5 THEN '' WHEN 8 THEN 'a [2] [2]' WHEN 10 THEN ' ' END AS answer,
  CASE n WHEN 0 THEN '1,2' WHEN 1 THEN '1,2' WHEN 2 THEN '9' WHEN 3 THEN '1' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 8 THEN '2' WHEN 10 THEN '1' END AS cited,
  CASE n WHEN 1 THEN 'declared_citations_mismatch' WHEN 2 THEN 'inline_citation_not_allowed' WHEN 3 THEN 'inline_citations_missing,declared_citations_mismatch'
    WHEN 10 THEN 'answer_empty,inline_citations_missing,declared_citations_mismatch' ELSE '' END AS failed FROM g)
"""


@query("grd_parse_generation", _GEN + "SELECT id, failure, sufficient, answer, cited FROM p")
def grd_parse_generation(spark: SparkSession, sf: str) -> DataFrame:
    out = generations(spark, sf).select("id", *[c.alias(n) for n, c in gd.parse_generation("raw").items()])
    return out.select("id", "failure", "sufficient", "answer", F.array_join(F.col("cited_numbers").cast("array<string>"), ",").alias("cited"))


@query("grd_check_citations", _GEN + "SELECT id, failed FROM p WHERE sufficient")
def grd_check_citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = generations(spark, sf).select("id", *[c.alias(n) for n, c in gd.parse_generation("raw").items()]).filter("sufficient")
    allowed = F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))
    return rows.select("id", F.array_join(gd.check_citations("answer", "cited_numbers", allowed), ",").alias("failed"))


_GUARD = _GEN + """, w AS (SELECT *, id % 7 = 0 OR (id % 2 = 0 AND id % 10 / 10.0 < 0.3) AS weak FROM p),
guarded AS (SELECT id, weak OR failure IS NOT NULL OR NOT sufficient OR failed <> '' AS refused,
  CASE WHEN weak THEN '检索证据为空或低于校准阈值' WHEN failure IS NOT NULL THEN '生成输出无法解析或不符合结构约束' WHEN NOT sufficient THEN CASE n WHEN 4 THEN 'missing facts' ELSE '生成自评证据不足' END
    WHEN failed <> '' THEN '答案引用缺失、越界或与声明不一致' ELSE '' END AS refusal_reason,
  CASE WHEN weak THEN 'retrieval_low_conf' WHEN failure IS NOT NULL OR NOT sufficient OR failed <> '' THEN 'self_check' ELSE '' END AS refusal_source,
  CASE WHEN weak THEN '' WHEN failure IS NOT NULL THEN failure WHEN sufficient THEN failed ELSE '' END AS failed,
  CASE WHEN weak OR failure IS NOT NULL OR NOT sufficient OR failed <> '' THEN '抱歉，现有知识库没有足够证据回答这个问题，我无法确认。建议联系人工客服核实。' ELSE answer END AS answer FROM w)
"""


@query("grd_guard_answers", _GUARD + "SELECT * FROM guarded")
def grd_guard_answers(spark: SparkSession, sf: str) -> DataFrame:
    out = gd.guard_answers(generations(spark, sf), 0.3)
    return out.select("id", "answer", "refused", "refusal_reason", "refusal_source", F.array_join("failed_predicates", ",").alias("failed"))


@query("grd_protocol_failures", _GUARD + "SELECT id, failed FROM guarded WHERE failed <> ''")
def grd_protocol_failures(spark: SparkSession, sf: str) -> DataFrame:
    out = gd.protocol_failures(gd.guard_answers(generations(spark, sf), 0.3))
    return out.select("id", F.array_join("failed_predicates", ",").alias("failed"))


@query(
    "grd_append_low_confidence",
    ad.with_cte("messages") + """, e AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'nowhere' ELSE conversation_id END AS conversation_id,
        CASE id % 5 WHEN 0 THEN 'self_check' WHEN 1 THEN 'other' ELSE 'user_feedback' END AS source FROM messages WHERE role = 'user')
      SELECT id, CASE WHEN source = 'other' THEN 'invalid_low_confidence_entry' WHEN conversation_id = 'nowhere' THEN 'unknown_conversation' END AS error FROM e""",
)
def grd_append_low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    entries = ad.messages(spark, sf).filter("role = 'user'").select(
        "id", F.when(n % 4 == 0, "nowhere").otherwise(F.col("conversation_id")).alias("conversation_id"), F.col("content").alias("raw_question"),
        F.when(n % 5 == 0, "self_check").when(n % 5 == 1, "other").otherwise("user_feedback").alias("source"), F.lit("r").alias("reason"),
    )
    good, bad = gd.append_low_confidence(entries, ad.conversations(spark, sf))
    return good.select("id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("id", "error"))


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = ad.documents(spark, sf)
    field = lambda name, value: value.alias(name)
    fields = [
        field("bucket", F.col("lang")), field("query", F.col("source")), field("strategy", F.lit("hybrid_rerank")),
        field("answer", F.col("text")), field("reason", F.lit("r")), field("citations", F.lit("[]")), field("judge_model", F.lit("m")),
    ]
    n = F.col("doc_id")
    ledger = docs.filter(n % 3 == 0).select(
        F.concat(F.lit("E"), (n % 400).cast("string")).alias("eval_id"), *fields,
        F.when(n % 2 == 0, "已解决").otherwise("未解决").alias("status"), (n % 5 + 1).alias("seen_count"), F.lit("t0").alias("first_seen_at"),
        F.concat(F.lit("t"), (n % 9).cast("string")).alias("last_seen_at"), F.when(n % 2 == 0, "fixed").alias("resolution"), F.lit(None).cast("string").alias("resolved_at"), n.alias("doc_id"),
    )
    from supportlake.operators.scan import first_per_key

    ledger = first_per_key(ledger, ["eval_id"], "doc_id").drop("doc_id")
    found = docs.filter(n % 2 == 1).select(F.concat(F.lit("E"), (n % 700).cast("string")).alias("eval_id"), n.alias("seq"), *fields)
    return ledger, found


_LEDGER = """WITH l AS (SELECT 'E' || (doc_id % 400) AS eval_id, min(doc_id) AS d FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
ledger AS (SELECT eval_id, lang AS bucket, CASE WHEN d % 2 = 0 THEN '已解决' ELSE '未解决' END AS status, d % 5 + 1 AS seen_count, 't' || (d % 9) AS last_seen_at,
  CASE WHEN d % 2 = 0 THEN 'fixed' END AS resolution FROM l JOIN documents ON doc_id = d),
f AS (SELECT 'E' || (doc_id % 700) AS eval_id, count(*) AS n, max(doc_id) AS d FROM documents WHERE doc_id % 2 = 1 GROUP BY 1),
found AS (SELECT f.*, lang AS bucket FROM f JOIN documents ON doc_id = d)
"""


@query(
    "grd_upsert_faith_cases",
    _LEDGER + """SELECT coalesce(l.eval_id, f.eval_id) AS eval_id, coalesce(f.bucket, l.bucket) AS bucket, coalesce(l.seen_count, 0) + coalesce(f.n, 0) AS seen_count,
      CASE WHEN f.n IS NOT NULL THEN '未解决' ELSE l.status END AS status, CASE WHEN f.n IS NULL THEN l.resolution END AS resolution,
      CASE WHEN f.n IS NOT NULL THEN 't99' ELSE l.last_seen_at END AS last_seen_at FROM ledger l FULL JOIN found f ON f.eval_id = l.eval_id""",
)
def grd_upsert_faith_cases(spark: SparkSession, sf: str) -> DataFrame:
    out = gd.upsert_faith_cases(*_cases(spark, sf), F.lit("t99"))
    return out.select("eval_id", "bucket", "seen_count", "status", "resolution", "last_seen_at")


@query(
    "grd_resolve_cases",
    _LEDGER + """, d AS (SELECT eval_id, CAST(substring(eval_id, 2) AS BIGINT) AS n FROM ledger WHERE CAST(substring(eval_id, 2) AS BIGINT) % 2 = 0)
      SELECT l.eval_id, CASE d.n % 8 WHEN 0 THEN '已解决' WHEN 4 THEN '未解决' ELSE l.status END AS status,
        CASE WHEN d.n % 8 = 0 THEN 'explained' WHEN d.n % 8 = 4 THEN NULL ELSE l.resolution END AS resolution,
        CASE d.n % 8 WHEN 2 THEN 'resolution_required' WHEN 6 THEN 'invalid_disposition' END AS error FROM ledger l LEFT JOIN d USING (eval_id)""",
)
def grd_resolve_cases(spark: SparkSession, sf: str) -> DataFrame:
    ledger, _ = _cases(spark, sf)
    n = F.substring("eval_id", 2, 20).cast("bigint")
    decisions = ledger.filter(n % 2 == 0).select(
        "eval_id", F.when(n % 8 == 0, "已解决").when(n % 8 == 4, "未解决").when(n % 8 == 2, "无需解决").otherwise("done").alias("status"),
        F.when(n % 8 == 2, " ").otherwise(" explained ").alias("resolution"),
    )
    out, errors = gd.resolve_cases(ledger, decisions, F.lit("t9"))
    return out.select("eval_id", "status", "resolution").join(errors, "eval_id", "left")


@query("grd_list_cases", _LEDGER + "SELECT eval_id, status, last_seen_at FROM ledger WHERE status = '未解决'")
def grd_list_cases(spark: SparkSession, sf: str) -> DataFrame:
    return gd.list_cases(_cases(spark, sf)[0], "未解决").select("eval_id", "status", "last_seen_at")


@query(
    "grd_detect_fabrication",
    """SELECT doc_id FROM labels WHERE doc_id % 2 = 0 AND quality = 0 AND CASE WHEN doc_id % 3 = 1 THEN doc_id % 5 = 0 ELSE true END""",
)
def grd_detect_fabrication(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    rows = read_input(spark, sf, "labels").select(
        "doc_id", F.when(n % 2 == 0, "hybrid_rerank").otherwise("dense").alias("strategy"), F.col("quality").cast("double").alias("faithfulness"),
        F.when(n % 3 == 1, "ValueError").alias("error"), F.when(n % 5 == 0, "correctness_judge").otherwise("generation").alias("error_stage"),
    )
    return gd.detect_fabrication(rows).select("doc_id")


# --- routing ---------------------------------------------------------------


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id") % 9
    name = F.element_at(F.array(*map(F.lit, ro.ROUTES)), (F.col("event_id") % 8 + 1).cast("int"))
    confidence = F.floor(F.col("value") * 10) / F.lit(4000.0)
    good = F.to_json(F.struct(name.alias("intent"), confidence.alias("confidence")))
    raw = (
        F.when(n == 3, F.lit('{"intent":"物流","intent":"订单","confidence":0.9}')).when(n == 4, F.lit('{"intent":"物流","confidence":true}'))
        .when(n == 5, F.lit('{"intent":"weather","confidence":0.9}')).when(n == 6, F.lit("oops")).otherwise(good)
    )
    return read_input(spark, sf, "events").select("event_id", raw.alias("raw"))


_INTENTS = """WITH e AS (SELECT event_id, event_id % 9 AS n, ['物流', '订单', '售后', '商品咨询', '退款退货', '投诉', '闲聊', '其他'][event_id % 8 + 1] AS name, floor(value * 10) / 4000.0 AS conf FROM events),
i AS (SELECT event_id, CASE WHEN n IN (3, 4, 5, 6) OR conf > 1 THEN NULL ELSE name END AS intent, CASE WHEN n IN (3, 4, 5, 6) OR conf > 1 THEN NULL ELSE conf END AS confidence,
  CASE n WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'confidence_not_a_number' WHEN 5 THEN 'unknown_intent' WHEN 6 THEN 'invalid_json' ELSE CASE WHEN conf > 1 THEN 'confidence_out_of_range' END END AS intent_error FROM e)
"""


@query("rte_parse_intents", _INTENTS + "SELECT event_id, intent, confidence, intent_error FROM i")
def rte_parse_intents(spark: SparkSession, sf: str) -> DataFrame:
    return _intents(spark, sf).select("event_id", *[c.alias(n) for n, c in ro.parse_intents("raw").items()])


@query(
    "rte_route_turns",
    _INTENTS + """, r AS (SELECT *, CASE WHEN confidence < 0.55 THEN '其他' ELSE intent END AS eff FROM i)
      SELECT event_id, eff AS effective_intent, CASE eff WHEN '物流' THEN 'business' WHEN '订单' THEN 'business' WHEN '售后' THEN 'high_risk' WHEN '商品咨询' THEN 'knowledge'
        WHEN '退款退货' THEN 'high_risk' WHEN '投诉' THEN 'complaint' WHEN '闲聊' THEN 'chitchat' WHEN '其他' THEN 'other' END AS route,
      CASE WHEN intent IS NULL THEN 'invalid_intent' WHEN confidence < 0.55 THEN 'low_intent_confidence' WHEN intent = '其他' THEN 'other_intent' END AS stop_reason FROM r""",
)
def rte_route_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = _intents(spark, sf).select("event_id", *[c.alias(n) for n, c in ro.parse_intents("raw").items()])
    return ro.route_turns(rows).select("event_id", "effective_intent", "route", "stop_reason")


def _asked(spark: SparkSession, sf: str, texts: tuple[str, ...], around: bool = True) -> DataFrame:
    """User messages; all but every (n+1)th begin with one of the given questions, with their own text on the next line.

    With ``around=False`` the question replaces the text, for rules that only a whole message can meet.
    """
    step = len(texts) + 1
    pick = F.get(F.array(*map(F.lit, texts)), (F.col("id") % step).cast("int"))
    return ad.messages(spark, sf).filter("role = 'user'").select(
        "id", "conversation_id", "role",
        F.coalesce(F.concat(pick, F.lit("\n"), F.coalesce("content", F.lit(""))) if around else pick, F.col("content")).alias("content"),
        (F.col("id") % step).alias("pick"), F.col("content").alias("own"),
    )


_STATUS_TEXTS = ("请问订单DEMO-1001的还在保吗？", "退款进度怎么样", "我能退款吗，退款进度怎么样", "保修期 还有多久？", "商品在保修期内呢")


_BARE_SQL = "regexp_replace(regexp_replace(coalesce(content, ''), '\\s+', '', 'g'), '^[？?。！!]+|[？?。！!]+$', '', 'g')"


@query(
    "rte_route_overrides",
    ad.with_cte("messages") + f"""SELECT id, CASE WHEN id % 6 IN (0, 1, 3, 4) OR id % 11 = 0 THEN 'business' ELSE 'knowledge' END AS route,
      CASE WHEN id % 11 = 0 OR regexp_full_match({_BARE_SQL}, '{"|".join(f"(?:{x})" for x in ro.STATUS_QUESTIONS)}') THEN 'business' ELSE 'knowledge' END AS own_route
      FROM messages WHERE role = 'user'""",
)
def rte_route_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """The route of a planted question, and that of the row's own whole text."""
    rows = _asked(spark, sf, _STATUS_TEXTS, around=False)
    intent = F.col("id") % 11 == 0
    own = ro.route_overrides(F.coalesce("own", F.lit("")), F.lit("knowledge"), intent)
    return rows.select("id", ro.route_overrides("content", F.lit("knowledge"), intent).alias("route"), own.alias("own_route"))


def _order_turns(spark: SparkSession, sf: str) -> DataFrame:
    users = ad.messages(spark, sf).filter("role = 'user'")
    n = F.col("id") % 7
    number = (F.col("conversation_id").cast("bigint") % 3 + 1001).cast("string")
    question = (
        F.when(n == 0, F.concat(F.lit("demo-"), number, F.lit(" 到了吗"))).when(n == 2, F.lit("DEMO-1001 和 DEMO-1002"))
        .when(n == 4, F.concat(F.lit("DEMO-"), number)).otherwise(F.lit("它呢"))
    )
    resolved = F.when(n == 4, F.lit("DEMO-1001 退款")).when(n == 3, F.lit("DEMO-1002 呢")).otherwise(question)
    return users.select(
        "id", "conversation_id", F.concat_ws("\n", question, "content").alias("question"), F.concat_ws("\n", "content", resolved).alias("resolved_question"), (F.col("id") % 5 != 0).alias("reference_resolved"),
        F.when(F.col("conversation_id").cast("bigint") % 10 == 0, F.lit("DEMO-1001")).alias("previous_order"),
    )


@query(
    "rte_resolve_order_id",
    ad.with_cte("messages") + """, u AS (SELECT id, conversation_id, id % 7 AS n, 'DEMO-' || (CAST(conversation_id AS BIGINT) % 3 + 1001) AS num, id % 5 <> 0 AS flag,
        CASE WHEN CAST(conversation_id AS BIGINT) % 10 = 0 THEN 'DEMO-1001' END AS prev FROM messages WHERE role = 'user'),
      c AS (SELECT *, CASE n WHEN 0 THEN [num] WHEN 4 THEN [num] WHEN 2 THEN ['DEMO-1001', 'DEMO-1002'] ELSE [] END AS cur,
        CASE n WHEN 0 THEN [num] WHEN 4 THEN ['DEMO-1001'] WHEN 3 THEN ['DEMO-1002'] WHEN 2 THEN ['DEMO-1001', 'DEMO-1002'] ELSE [] END AS res FROM u),
      h AS (SELECT a.id, list_distinct(list_concat(coalesce(flatten(list(b.cur)), []), CASE WHEN any_value(a.prev) IS NULL THEN [] ELSE [any_value(a.prev)] END)) AS hist
        FROM c a LEFT JOIN c b ON b.conversation_id = a.conversation_id AND b.id <= a.id GROUP BY a.id)
      SELECT c.id, len(cur) = 1 AND len(res) > 0 AND res <> cur AS resolver_conflict,
        CASE WHEN len(cur) = 1 THEN cur[1] WHEN len(cur) = 0 AND flag AND len(hist) = 1 AND (len(res) = 0 OR res = hist) THEN hist[1] END AS order_id FROM c JOIN h ON h.id = c.id""",
)
def rte_resolve_order_id(spark: SparkSession, sf: str) -> DataFrame:
    return ro.resolve_order_id(_order_turns(spark, sf)).select("id", "resolver_conflict", "order_id")


@query(
    "rte_parse_reference",
    ad.with_cte("messages") + """SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unresolved_changes_question' WHEN 2 THEN 'flag_not_boolean' WHEN 3 THEN 'wrong_keys' END AS reference_error,
      id % 5 = 0 AS reference_resolved FROM messages WHERE role = 'user'""",
)
def rte_parse_reference(spark: SparkSession, sf: str) -> DataFrame:
    users = ad.messages(spark, sf).filter("role = 'user'")
    n = F.col("id") % 5
    longer = F.concat("content", F.lit(" now"))
    raw = (
        F.when(n == 0, F.to_json(F.struct(longer.alias("question"), F.lit(True).alias("reference_resolved"))))
        .when(n == 1, F.to_json(F.struct(longer.alias("question"), F.lit(False).alias("reference_resolved"))))
        .when(n == 2, F.to_json(F.struct(longer.alias("question"), F.lit("yes").alias("reference_resolved"))))
        .when(n == 3, F.to_json(F.struct(longer.alias("question"))))
        .otherwise(F.to_json(F.struct(F.col("content").alias("question"), F.lit(False).alias("reference_resolved"))))
    )
    rows = users.select("id", "content", raw.alias("raw"))
    return rows.select("id", *[c.alias(k) for k, c in ro.parse_reference("raw", "content").items() if k != "resolved_question"])


@query(
    "rte_is_greeting",
    ad.with_cte("messages") + f"""SELECT id, id % 4 IN (0, 1) AS greeting, regexp_replace(coalesce(content, ''), '\\s|[，,。.!！?？～~]', '', 'g') IN ({", ".join(f"'{g}'" for g in ro.GREETINGS)}) AS own_greeting
      FROM messages WHERE role = 'user'""",
)
def rte_is_greeting(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a planted message is a greeting, and whether the row's own whole text is."""
    rows = _asked(spark, sf, ("您好！", " 谢 谢~", "你好，查订单"), around=False)
    return rows.select("id", ro.is_greeting("content").alias("greeting"), ro.is_greeting(F.coalesce("own", F.lit(""))).alias("own_greeting"))


_TICKET_TEXTS = ("请帮我创建一个工单", "不要建工单了", "能不能帮我建工单？", "他说“帮我创建工单”", "不想取消工单", "工单先取消吧")


@query(
    "rte_ticket_request_class",
    ad.with_cte("messages") + "SELECT id, CASE id % 7 WHEN 0 THEN 'explicit' WHEN 1 THEN 'cancel' WHEN 5 THEN 'cancel' ELSE 'none' END AS kind FROM messages WHERE role = 'user'",
)
def rte_ticket_request_class(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf, _TICKET_TEXTS).select("id", ro.ticket_request_class("content").alias("kind"))


@query(
    "rte_ticket_intent_state",
    ad.with_cte("messages") + """, k AS (SELECT conversation_id, max(CASE WHEN id % 7 = 0 THEN id END) AS request_id, max(CASE WHEN id % 7 IN (1, 5) THEN id END) AS cancel_id
        FROM messages WHERE role = 'user' GROUP BY 1)
      SELECT conversation_id, request_id, CASE WHEN cancel_id > request_id THEN 'cancelled' ELSE 'requested' END AS status FROM k WHERE request_id IS NOT NULL""",
)
def rte_ticket_intent_state(spark: SparkSession, sf: str) -> DataFrame:
    return ro.ticket_intent_state(_asked(spark, sf, _TICKET_TEXTS)).select("conversation_id", "request_id", "status")


@query("rte_refund_type", ad.with_cte("messages") + "SELECT id, CASE WHEN id % 3 < 2 THEN '退货' ELSE '退款' END AS request_type FROM messages WHERE role = 'user'")
def rte_refund_type(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf, ("我要退货", "已经退回了")).select("id", ro.refund_type("content").alias("request_type"))


@query(
    "rte_validate_after_sale",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 AND o_orderkey % 5 <> 2 THEN 'O' || o_orderkey END AS order_id,
         CASE o_orderkey % 5 WHEN 0 THEN '退款' END AS request_type, CASE o_orderkey % 5 WHEN 2 THEN 'unknown_request_type' WHEN 3 THEN 'field_not_text' WHEN 4 THEN 'invalid_json' END AS error FROM orders""",
)
def rte_validate_after_sale(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") % 5
    key = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    raw = (
        F.when(n == 0, F.to_json(F.struct(key.alias("order_id"), F.lit("退款").alias("request_type"), F.lit("x").alias("expected_solution"))))
        .when(n == 1, F.to_json(F.struct(key.alias("order_id"))))
        .when(n == 2, F.to_json(F.struct(key.alias("order_id"), F.lit("赔付").alias("request_type"))))
        .when(n == 3, F.to_json(F.struct(F.col("o_orderkey").alias("order_id")))).otherwise(F.lit("[1]"))
    )
    rows = read_input(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    fields = ro.validate_after_sale("raw")
    return rows.select("id", *[fields[k].alias(k) for k in ("order_id", "request_type", "error")])


@query(
    "rte_accept_refunds",
    """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 7 THEN 'unknown_order' WHEN o_orderkey % 10 = 3 THEN 'conversation_owner_mismatch' WHEN o_orderkey % 10 = 5 THEN 'refund_form_not_offered'
         WHEN o_orderkey % 10 = 9 THEN 'invalid_request' WHEN o_orderkey % 20 = 2 THEN 'request_id_conflict' ELSE 'recorded' END AS outcome FROM orders
       UNION ALL SELECT o_orderkey + 1000000000, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 20 = 2 THEN 'recorded' ELSE 'request_id_conflict' END FROM orders WHERE o_orderkey % 10 IN (0, 2)""",
)
def rte_accept_refunds(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_input(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n, user = F.col("o_orderkey"), F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    key = n.cast("string")
    requests = raw.select(
        n.alias("seq"), F.concat(F.lit("r"), key).alias("request_id"), F.concat(F.lit("c"), key).alias("conversation_id"), n.alias("message_id"),
        user.alias("user_id"), F.when(n % 10 == 7, "none").otherwise(key).alias("order_id"), F.lit("退款").alias("request_type"),
        F.when(n % 10 == 9, "because").otherwise("其他").alias("reason"),
    )
    again = requests.filter("seq % 10 IN (0, 2)").withColumns({
        "reason": F.when(F.col("seq") % 4 == 0, F.col("reason")).otherwise(F.lit("错发/漏发")), "seq": F.col("seq") + 1_000_000_000,
    })
    orders = raw.select(key.alias("order_id"), user.alias("user_id"))
    owners = raw.select(F.concat(F.lit("c"), key).alias("conversation_id"), F.when(n % 10 == 3, "someone").otherwise(user).alias("user_id"))
    form = F.struct(
        F.array(F.lit("refund_form")).alias("items"),
        F.struct(key.alias("order_id"), F.concat(F.lit("r"), key).alias("request_id"), F.when(n % 10 == 5, "退货").otherwise("退款").alias("request_type")).alias("refund_form"),
    )
    offers = raw.select(n.alias("id"), F.concat(F.lit("c"), key).alias("conversation_id"), F.lit("assistant").alias("role"), F.to_json(form).alias("actions"))
    # Stored before: some with the same content, some with another reason, which only the repeated request has.
    saved = requests.filter("seq % 20 = 10").unionByName(requests.filter("seq % 20 = 2").withColumn("reason", F.lit("错发/漏发")))
    return ro.accept_refunds(requests.unionByName(again), orders, owners, offers, saved).select("seq", "outcome")


# --- run logs --------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_input(spark, sf, "events")


@query(
    "log_latest_run",
    "SELECT CAST(user_id AS VARCHAR) AS conversation_id, event_id, event_type AS route, value FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)",
)
def log_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = _events(spark, sf).select(F.col("user_id").cast("string").alias("conversation_id"), "event_id", F.col("event_type").alias("route"), "value")
    return lg.latest_run_per_conversation(runs, "event_id")


@query(
    "log_usage_rollup",
    """WITH u AS (SELECT event_type, unnest(['refer', 'classify']) AS stage, unnest([CAST(floor(value) AS BIGINT), event_id % 50 + 10]) AS total, event_id FROM events),
       t AS (SELECT event_type, stage, CASE WHEN total > 0 AND event_id % 4 > 0 THEN total ELSE 35 END AS tokens, NOT (total > 0 AND event_id % 4 > 0) AS est FROM u)
       SELECT event_type, stage, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN est THEN tokens ELSE 0 END) AS BIGINT) AS estimated_tokens, count(*) AS calls,
         CAST(GROUPING(event_type, stage) AS BIGINT) AS level FROM t GROUP BY ROLLUP (event_type, stage)""",
)
def log_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    def stage(name, total):
        reported = F.when(F.col("event_id") % 4 > 0, lg.first_positive(F.when(F.col("event_id") % 4 == 1, total), F.when(F.col("event_id") % 4 > 1, total)))
        usage = lg.measured_usage(reported, F.lit(20), F.lit(15))
        return F.struct(F.lit(name).alias("stage"), usage["tokens"].alias("tokens"), usage["estimated"].alias("estimated"))

    runs = _events(spark, sf).select(
        "event_type", F.array(stage("refer", F.floor("value")), stage("classify", F.col("event_id") % 50 + 10)).alias("usage")
    )
    return lg.usage_rollup(runs, ["event_type"])


@query(
    "log_context_report",
    """SELECT CAST(user_id AS VARCHAR) AS conversation_id, count(*) FILTER (WHERE event_type = 'error') AS downgrades, count(*) FILTER (WHERE event_type = 'signup') AS summaries,
         CAST(max(CASE WHEN event_type = 'view' THEN floor(value) END) AS BIGINT) AS max_input_tokens FROM events GROUP BY 1""",
)
def log_context_report(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    event = (
        F.when(kind == "error", F.concat(F.lit("层1 降级 1→"), F.col("event_id").cast("string"))).when(kind == "signup", "summary done")
        .when(kind == "view", "model_ctx").otherwise(kind)
    )
    log = _events(spark, sf).select(F.col("user_id").cast("string").alias("conversation_id"), event.alias("event"), F.floor("value").alias("tokens"))
    return lg.context_log_report(log, ["conversation_id"])


@query(
    "log_audit_report",
    """SELECT event_type AS tool_name, CASE WHEN user_id % 2 = 0 THEN 'builtin' ELSE 'mcp:x' END AS source, CASE WHEN value > 100 THEN 'timeout' ELSE 'success' END AS status,
         count(*) AS calls, CAST(sum(event_id % 3) AS BIGINT) AS retries, count(*) FILTER (WHERE event_id % 3 > 0) AS retried_calls, round(avg(value), 6) AS avg_ms, max(value) AS max_ms
       FROM events GROUP BY 1, 2, 3""",
)
def log_audit_report(spark: SparkSession, sf: str) -> DataFrame:
    audit = _events(spark, sf).select(
        F.col("event_type").alias("tool_name"), F.when(F.col("user_id") % 2 == 0, "builtin").otherwise("mcp:x").alias("source"),
        F.when(F.col("value") > 100, "timeout").otherwise("success").alias("status"), (F.col("event_id") % 3).alias("retry_count"), F.col("value").alias("duration_ms"),
    )
    return lg.audit_status_report(audit).withColumn("avg_ms", F.round("avg_ms", 6))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    events = _events(spark, sf)
    calls = events.select(
        "event_id", F.when(F.col("event_type") == "purchase", "create_ticket").otherwise(F.col("event_type")).alias("tool_name"),
        F.when(n % 3 == 0, "builtin").when(n % 3 == 1, "mcp:logistics").otherwise("mcp:other").alias("source"),
        (n % 17 != 0).alias("registered"), (n % 13 != 0).alias("arguments_valid"), (n % 2 == 0).alias("ticket_requested"),
        (n % 5 != 0).alias("confirmed"), (n % 7 == 0).alias("already_submitted"),
        F.when(n % 11 == 1, "timeout").when(n % 11 == 2, "empty").when(n % 11 == 3, "error").otherwise("ok").alias("outcome"),
    )
    kinds = events.select("event_type").distinct()
    policy = kinds.select(
        F.lit("logistics").alias("server"), F.col("event_type").alias("tool_name"), F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write").alias("permission")
    )
    return lg.permission_join(calls, policy, "event_id")


_CALLS = """WITH c AS (SELECT event_id, event_id AS n, CASE event_type WHEN 'purchase' THEN 'create_ticket' ELSE event_type END AS tool_name,
  CASE event_id % 3 WHEN 0 THEN 'builtin' WHEN 1 THEN 'mcp:logistics' ELSE 'mcp:other' END AS source FROM events),
p AS (SELECT *, CASE WHEN source = 'builtin' THEN CASE tool_name WHEN 'create_ticket' THEN 'write' ELSE 'read' END WHEN source = 'mcp:logistics' AND tool_name IN ('view', 'click') THEN 'read' ELSE 'deny' END AS permission FROM c)
"""


@query("log_permission_join", _CALLS + "SELECT event_id, tool_name, source, permission FROM p")
def log_permission_join(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("event_id", "tool_name", "source", "permission")


@query(
    "log_classify_calls",
    _CALLS + """, d AS (SELECT *, permission = 'deny' OR (permission = 'write' AND (NOT (n % 2 = 0 AND n % 5 <> 0) OR n % 7 = 0)) AS denied FROM p)
      SELECT event_id, CASE WHEN n % 17 = 0 THEN 'permission_denied' WHEN n % 13 = 0 THEN 'validation_blocked' WHEN denied THEN 'permission_denied' WHEN n % 11 = 1 THEN 'timeout' WHEN n % 11 IN (2, 3) THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN n % 17 = 0 THEN 'permission_denied' WHEN n % 13 = 0 THEN 'invalid_arguments' WHEN denied THEN 'permission_denied' WHEN n % 11 = 2 THEN 'not_found' WHEN n % 11 IN (1, 3) THEN 'execution_error' END AS error_class FROM d""",
)
def log_classify_calls(spark: SparkSession, sf: str) -> DataFrame:
    return lg.classify_calls(_calls(spark, sf)).select("event_id", "status", "error_class")


@query(
    "log_audit_loop_limits",
    """WITH c AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) || '-' || (event_id // 2000) AS run_id, event_type || '-' || (event_id % 4) AS sig, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events),
       b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) - 1 AS before, coalesce(sum(tokens) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         row_number() OVER (PARTITION BY run_id, sig ORDER BY id) AS again FROM c),
       r AS (SELECT *, CASE WHEN again > 1 THEN 'repeated_tool' WHEN before >= 6 THEN 'tool_limit' WHEN used >= 4000 THEN 'token_budget' END AS reason FROM b),
       s AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN id END) OVER (PARTITION BY run_id) AS stop FROM r)
       SELECT id, run_id, CASE WHEN id > stop THEN 'stopped' WHEN id = stop THEN reason ELSE 'executed' END AS verdict FROM s""",
)
def log_audit_loop_limits(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    calls = _events(spark, sf).select(
        n.alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(n / 2000).cast("string")).alias("run_id"),
        F.concat("event_type", F.lit("-"), (n % 4).cast("string")).alias("signature"), F.floor(F.col("value") * 10).alias("tokens"),
    )
    return lg.audit_loop_limits(calls, 6, 4000).select("id", "run_id", "verdict")


@query(
    "log_dedup_writes",
    "SELECT min(event_id) AS event_id, CAST(user_id AS VARCHAR) AS conversation_id, props AS tool_call_id FROM events GROUP BY 2, 3",
)
def log_dedup_writes(spark: SparkSession, sf: str) -> DataFrame:
    calls = _events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("conversation_id"), F.col("props").alias("tool_call_id"))
    return lg.dedup_writes(calls, "event_id").select("event_id", "conversation_id", "tool_call_id")


@query(
    "log_fold_run_events",
    """WITH e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) || '-' || (event_id // 1000) AS run_id, event_type AS t, CAST(event_id % 100 AS VARCHAR) AS v FROM events)
       SELECT run_id, coalesce(string_agg(v, '' ORDER BY id) FILTER (WHERE t = 'click'), '') AS answer, coalesce(string_agg(v, ',' ORDER BY id) FILTER (WHERE t = 'view'), '') AS tools,
         count(*) FILTER (WHERE t = 'purchase') AS n_previews, bool_or(t = 'error') AS has_error_event, coalesce(string_agg(v, ',' ORDER BY id) FILTER (WHERE t = 'signup'), '') AS nodes FROM e GROUP BY 1""",
)
def log_fold_run_events(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    names = F.create_map(*[F.lit(x) for x in ("click", "token", "view", "tool_status", "purchase", "ticket_preview", "error", "error", "signup", "workflow_status")])
    value = (n % 100).cast("string")
    events = _events(spark, sf).select(
        n.alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(n / 1000).cast("string")).alias("run_id"),
        names[F.col("event_type")].alias("event"), value.alias("content"), value.alias("tool_name"), value.alias("node"), value.alias("preview"), value.alias("message"),
    )
    folded = lg.fold_run_events(events)
    return folded.select(
        "run_id", "answer", F.array_join("tool_names", ",").alias("tools"), F.size("previews").cast("bigint").alias("n_previews"),
        "has_error_event", F.array_join("workflow_nodes", ",").alias("nodes"),
    )
