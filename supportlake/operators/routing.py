"""Classifying turns: intents, routes, order references, tickets, refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import jsonval as js
from supportlake.functions import text as tx
from supportlake.operators.scan import first_per_key, join_per_key, running
from supportlake.session import materialize

# Intents and routes, greeting words, status-question and ticket
# patterns, request types and reasons.
ROUTES = {
    "物流": "business",
    "订单": "business",
    "售后": "high_risk",
    "商品咨询": "knowledge",
    "退款退货": "high_risk",
    "投诉": "complaint",
    "闲聊": "chitchat",
    "其他": "other",
}
CONFIDENCE_THRESHOLD = 0.55
GREETINGS = ("你好", "您好", "嗨", "哈喽", "hello", "hi", "谢谢", "谢谢你", "感谢", "再见", "拜拜")
GREETING_NOISE = rf"(?U){tx.WS}|[，,。.!！?？～~]"
ORDER_ID = r"(?iu)DEMO-\d{4}"
_ORDER_PREFIX = r"(?:(?:请问|麻烦)?(?:帮我)?(?:查(?:询)?|看(?:一下)?)?(?:(?:订单|单号)DEMO-\d{4}(?:的)?)?)?"
_STATUS_SUFFIX = r"(?:吗|呢|呀)?"
STATUS_QUESTIONS = (
    rf"{_ORDER_PREFIX}(?:(?:现在|当前)?(?:是否|是不是)?(?:仍然?|还)?在保){_STATUS_SUFFIX}",
    rf"{_ORDER_PREFIX}(?:商品)?(?:是否|是不是)?(?:仍然?|还)?(?:在保修期内|处于保修期内){_STATUS_SUFFIX}",
    rf"{_ORDER_PREFIX}(?:保修|保修期|保修期限)(?:状态)?"
    rf"(?:是什么|如何|怎么样|到期时间|什么时候到期|何时到期|还有多久|多久|截止日期)?{_STATUS_SUFFIX}",
    rf"{_ORDER_PREFIX}(?:退货|退款|售后)(?:申请|处理)?(?:进度|状态|到哪(?:一步)?了?)(?:如何|怎么样|是什么)?{_STATUS_SUFFIX}",
)
QUOTED = r'[“”"「」『』]|(?:他说|她说|客户说|客服说|用户说)'
KEEPS_TICKET = r"(?:不要|不需要|不用|不想|别).{0,6}(?:取消|撤销).{0,8}(?:工单|建单)"
ASKS_WHETHER = r"(?:能否|能不能|是否|吗[？?]?$)"
CANCELS_TICKET = (
    r"(?:不需要|不再需要|不用|不想|不要|别|不(?:再)?(?:建|创建|提交|开)|取消|撤销|停止).{0,12}(?:工单|建单)"
    r"|(?:工单|建单).{0,6}(?:取消|撤销|停止)"
)
NEVER_GRANTS = (
    r'[“”"「」『』]|(不要|不想|别|不需要|不用|不建|取消|能否|能不能|可以吗|吗[？?]?$|怎么|如何|是否|教程|例如|比如'
    r"|他说|她说|客户说|客服说|用户说)"
)
REQUESTS_TICKET = r"(帮我|给我|请|我要|我想|麻烦|需要).{0,12}(建|创建|提交|开).{0,4}工单"
RETURN_WORDS = "退货|退回"
AFTER_SALE_TYPES = ("退款", "退货", "换货", "维修", "物流", "其他")
REFUND_TYPES = ("退款", "退货")
REFUND_REASONS = ("商品质量问题", "错发/漏发", "不想要/不合适", "其他")


def parse_intents(raw: Column | str) -> dict[str, Column]:
    """``intent`` and ``confidence`` of a strict two-key object, else ``error``."""
    raw = tx._c(raw)

    def build(v: Column) -> Column:
        intent, confidence = js.value(v, "$.intent", "string"), js.value(v, "$.confidence", "double")
        error = (
            F.when(~js.is_object(v), "invalid_json")
            .when(~js.keys_are(raw, "confidence", "intent"), "wrong_keys")
            .when(~(js.is_string(v, "$.intent") & F.coalesce(intent.isin(*ROUTES), F.lit(False))), "unknown_intent")
            .when(~js.is_number(v, "$.confidence"), "confidence_not_a_number")
            .when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence_out_of_range")
        )
        return F.struct(intent.alias("intent"), confidence.alias("confidence"), error.alias("error"))

    out = js.read_object(raw, build)
    good = out["error"].isNull()
    return {"intent": F.when(good, out["intent"]), "confidence": F.when(good, out["confidence"]), "intent_error": out["error"]}


def route_turns(turns: DataFrame) -> DataFrame:
    """Add effective_intent, route and stop_reason to rows with intent and confidence.

    The route map is eight fixed entries, so it is an expression, not a join.
    """
    low = F.col("confidence") < CONFIDENCE_THRESHOLD
    effective = F.when(F.col("intent").isNotNull() & low, F.lit("其他")).otherwise(F.col("intent"))
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    stop = (
        F.when(F.col("intent").isNull(), "invalid_intent").when(low, "low_intent_confidence").when(F.col("intent") == "其他", "other_intent")
    )
    return turns.withColumns({
        "effective_intent": effective, "route": F.try_element_at(routes, effective), "stop_reason": stop,
    })


def route_overrides(question: Column | str, route: Column | str, has_ticket_intent: Column | str) -> Column:
    """Business route for ticket requests and for questions that only ask a status."""
    bare = F.regexp_replace(F.regexp_replace(tx._c(question), rf"(?U){tx.WS}+", ""), "^[？?。！!]+|[？?。！!]+$", "")
    pure = F.lit(False)
    for pattern in STATUS_QUESTIONS:
        pure = pure | bare.rlike(rf"(?U)\A(?:{pattern})\z")
    return F.when(tx._c(has_ticket_intent) | pure, F.lit("business")).otherwise(tx._c(route))


def order_ids(col: Column | str) -> Column:
    """Distinct upper-cased order ids in a text."""
    found = F.regexp_extract_all(tx._c(col), F.lit(rf"({ORDER_ID})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def resolve_order_id(turns: DataFrame) -> DataFrame:
    """Order id of each user turn, and whether the resolver contradicts it.

    Turns: conversation_id, id, question, resolved_question, reference_resolved,
    previous_order. "Exactly one id so far" is a running minimum that equals the
    running maximum, so no history list is ever built.
    """
    current, resolved = order_ids("question"), order_ids("resolved_question")
    rows = turns.withColumns({"__current": current, "__resolved": resolved})
    seen = running(
        rows, ["conversation_id"], "id",
        {"__first": ("min", F.array_min("__current")), "__last": ("max", F.array_max("__current"))},
    )
    low = F.least(F.col("__first"), F.col("previous_order"))
    high = F.greatest(F.col("__last"), F.col("previous_order"))
    agrees = (F.size("__resolved") == 0) | (F.col("__resolved") == F.array(low))
    historic = F.when(
        (F.size("__current") == 0) & F.col("reference_resolved") & (low == high) & agrees, low
    )
    own = F.when(F.size("__current") == 1, F.get("__current", F.lit(0)))
    conflict = F.coalesce((F.size("__current") == 1) & (F.size("__resolved") > 0) & (F.col("__resolved") != F.col("__current")), F.lit(False))
    return seen.withColumns({
        "order_id": F.coalesce(own, historic),
        "resolver_conflict": conflict,
    }).withColumns({
        "resolved_question": F.when(F.col("resolver_conflict"), F.col("question")).otherwise(F.col("resolved_question")),
        "reference_resolved": F.col("reference_resolved") & ~F.col("resolver_conflict"),
    }).drop("__current", "__resolved", "__first", "__last")


def parse_reference(raw: Column | str, original: Column | str) -> dict[str, Column]:
    raw, original = tx._c(raw), tx._c(original)

    def build(v: Column) -> Column:
        question, resolved = js.value(v, "$.question", "string"), js.value(v, "$.reference_resolved", "boolean")
        error = (
            F.when(~js.is_object(v), "invalid_json")
            .when(~js.keys_are(raw, "question", "reference_resolved"), "wrong_keys")
            .when(~js.is_string(v, "$.question") | tx.is_blank(F.coalesce(question, F.lit(""))), "question_blank")
            .when(~js.is_bool(v, "$.reference_resolved"), "flag_not_boolean")
            .when(~resolved & (question != original), "unresolved_changes_question")
        )
        return F.struct(question.alias("question"), resolved.alias("resolved"), error.alias("error"))

    out = js.read_object(raw, build)
    good = out["error"].isNull()
    return {
        "resolved_question": F.when(good, out["question"]).otherwise(original),
        "reference_resolved": F.when(good, out["resolved"]).otherwise(F.lit(False)),
        "reference_error": out["error"],
    }


def is_greeting(question: Column | str) -> Column:
    return F.regexp_replace(tx._c(question), GREETING_NOISE, "").isin(*GREETINGS)


def ticket_request_class(text: Column | str) -> Column:
    """cancel, explicit or none; quotes, questions and negations never grant a ticket."""
    text = tx._c(text)

    def has(pattern: str) -> Column:
        return text.rlike(f"(?d){pattern}")  # only a line feed ends a line

    cancels = ~has(QUOTED) & ~has(KEEPS_TICKET) & ~has(ASKS_WHETHER) & has(CANCELS_TICKET)
    asks = ~has(NEVER_GRANTS) & has(REQUESTS_TICKET)
    return F.when(cancels, "cancel").when(asks, "explicit").otherwise("none")


def ticket_intent_state(messages: DataFrame) -> DataFrame:
    """Per conversation with a ticket request: requested or cancelled, and the last request."""
    events = messages.filter(F.col("role") == "user").select(
        "conversation_id", "id", ticket_request_class("content").alias("kind")
    )
    asked = F.max(F.when(F.col("kind") == "explicit", F.col("id")))
    dropped = F.max(F.when(F.col("kind") == "cancel", F.col("id")))
    last = events.filter("kind <> 'none'").groupBy("conversation_id").agg(asked.alias("request_id"), dropped.alias("cancel_id"))
    state = last.filter(F.col("request_id").isNotNull()).select(
        "conversation_id", "request_id",
        F.when(F.col("cancel_id") > F.col("request_id"), "cancelled").otherwise("requested").alias("status"),
    )
    texts = messages.select(F.col("id").alias("request_id"), F.col("content").alias("original_request"))
    return state.join(texts, "request_id")


def refund_type(text: Column | str) -> Column:
    return F.when(tx._c(text).rlike(RETURN_WORDS), "退货").otherwise("退款")


def validate_after_sale(raw: Column | str) -> dict[str, Column]:
    """Nullable order_id and expected_solution texts and a known request_type, else ``error``."""
    def build(v: Column) -> Column:
        def text_or_null(path: str) -> Column:
            return F.coalesce(js.kind(v, path).isin("STRING", "VOID"), F.lit(True))

        kind = js.value(v, "$.request_type", "string")
        error = (
            F.when(~js.is_object(v), "invalid_json")
            .when(~(text_or_null("$.order_id") & text_or_null("$.expected_solution")), "field_not_text")
            .when(~text_or_null("$.request_type") | F.coalesce(~kind.isin(*AFTER_SALE_TYPES), F.lit(False)), "unknown_request_type")
        )
        return F.struct(
            js.value(v, "$.order_id", "string").alias("order_id"), kind.alias("request_type"),
            js.value(v, "$.expected_solution", "string").alias("expected_solution"), error.alias("error"),
        )

    out = js.read_object(tx._c(raw), build)
    fields = {f: F.when(out["error"].isNull(), out[f]) for f in ("order_id", "request_type", "expected_solution")}
    return {**fields, "error": out["error"]}


_REQUEST_FIELDS = ("conversation_id", "message_id", "user_id", "order_id", "request_type", "reason")


def accept_refunds(
    requests: DataFrame, orders: DataFrame, conversations: DataFrame, messages: DataFrame, saved: DataFrame
) -> DataFrame:
    """Outcome of each refund request (unique ``seq``): recorded, or why not.

    The order must belong to the user, the conversation too, and the message
    must offer exactly this form. The first valid request of an id is stored;
    the same content again is fine, different content is a conflict.
    """
    own_orders = orders.select("order_id", "user_id", F.lit(True).alias("__order"))
    owners = conversations.select("conversation_id", F.col("user_id").alias("__owner"))
    offers = messages.filter((F.col("role") == "assistant") & F.col("actions").isNotNull()).select(
        F.col("id").alias("message_id"), F.col("conversation_id").alias("__conversation"),
        F.coalesce(F.array_contains(F.from_json(F.get_json_object("actions", "$.items"), "array<string>"), "refund_form"), F.lit(False)).alias("__listed"),
        *[F.get_json_object("actions", f"$.refund_form.{f}").alias(f"__{f}") for f in ("order_id", "request_id", "request_type")],
    )
    owned = join_per_key(requests, owners, ["conversation_id"], "seq", "left")
    joined = owned.join(own_orders, ["order_id", "user_id"], "left").join(offers, "message_id", "left")
    offered = (
        F.col("__listed") & (F.col("__conversation") == F.col("conversation_id"))
        & (F.col("__order_id") == F.col("order_id")) & (F.col("__request_id") == F.col("request_id"))
        & (F.col("__request_type") == F.col("request_type"))
    )
    known = F.col("request_type").isin(*REFUND_TYPES) & F.col("reason").isin(*REFUND_REASONS)
    checked = joined.withColumn(
        "problem",
        F.when(~F.coalesce(known, F.lit(False)), "invalid_request")
        .when(F.col("__order").isNull(), "unknown_order")
        .when(~F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False)), "conversation_owner_mismatch")
        .when(~F.coalesce(offered, F.lit(False)), "refund_form_not_offered"),
    ).select(*requests.columns, "problem")
    content = F.struct(*_REQUEST_FIELDS)
    # The joined check feeds both the choice of the first request and the comparison.
    checked = materialize(checked, "checked-requests")
    valid = checked.filter(F.col("problem").isNull())
    first = first_per_key(valid, ["request_id"], "seq").select("request_id", content.alias("__first"))
    stored = saved.select("request_id", content.alias("__saved"))
    compared = checked.join(first, "request_id", "left").join(stored, "request_id", "left")
    reference = F.coalesce("__saved", "__first")
    outcome = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(reference != content, "request_id_conflict").otherwise("recorded")
    )
    return compared.select(*requests.columns, outcome.alias("outcome"))
