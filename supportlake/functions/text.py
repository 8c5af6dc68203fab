"""Scalar text functions as Spark column expressions.

Everything is a built-in JVM expression except Unicode compatibility folding,
which Spark has no function for; that one Arrow UDF only receives the texts
that are not plain ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's strip and \s see it.
WS = r"[\s\x1c-\x1f]"
CJK = r"[㐀-鿿]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(_c(col), rf"(?U)^{WS}+|{WS}+$", "")


def strip_text(col: Column | str) -> Column:
    """As ``strip``, for a column of long texts: only those that begin or end with white space are searched."""
    text = _c(col)
    outer = F.substring(text, 1, 1).rlike(rf"(?U){WS}") | F.substring(text, -1, 1).rlike(rf"(?U){WS}")
    return F.when(outer, strip(text)).otherwise(text)


def is_blank(col: Column | str) -> Column:
    return ~_c(col).rlike(rf"(?U)[^\s\x1c-\x1f]")


def count_matches(col: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(col), F.lit(pattern)).cast("bigint")


# --- keys and hashes -------------------------------------------------------


def embedding_text(category: Column | str, questions: Column | str, answer: Column | str) -> Column:
    lines = F.concat(F.array(strip(category)), F.transform(_c(questions), strip), F.array(strip_text(answer)))
    return F.array_join(lines, "\n")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def _non_ascii(col: Column) -> Column:
    return F.when(col.rlike(r"[^\x00-\x7f]"), col)


def content_hash(category: Column | str, questions: Column | str, answer: Column | str) -> Column:
    text = embedding_text(category, questions, answer)
    return F.sha2(F.coalesce(_nfc(_non_ascii(text)), text), 256)


def folded(col: Column | str) -> Column:
    """Compatibility-normalised, case-folded text; ASCII never leaves the JVM."""
    text = _c(col)
    return F.coalesce(_nfkc_casefold(_non_ascii(text)), F.lower(text))


def fingerprint_text(col: Column | str) -> Column:
    """Letters and numbers of the folded text, hashed."""
    return F.sha2(F.regexp_replace(folded(col), r"[^\p{L}\p{N}]+", ""), 256)


def fingerprint(category: Column | str, questions: Column | str, answer: Column | str) -> Column:
    return fingerprint_text(embedding_text(category, questions, answer))


# --- personal data ---------------------------------------------------------

# Patterns applied in this order and the label each one leaves. A pattern begins with the characters that a match
# can begin with, so that most places of a text are passed by one look.
PII_PATTERNS = (
    ("phone", r"(?U)(?=[+018])(?<!\d)(?:(?:\+|00)?86[-\s]?)?1[3-9]\d{9}(?!\d)", "[PHONE]"),
    ("email", r"(?iuU)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9-])", "[EMAIL]"),
    ("id_card", r"(?U)(?=[1-9])(?<!\d)[1-9]\d{16}[0-9Xx](?!\w)", "[ID_CARD]"),
    (
        "labelled_id",
        r"(?iuU)(?=[订工ot])(?:订单(?:编号|号)|工单(?:编号|号)|order\s*(?:id|no)?|ticket\s*(?:id|no)?)"
        r"\s*(?:为|是|[:：#])?\s*[A-Z0-9][A-Z0-9_-]{2,}",
        "[REDACTED_ID]",
    ),
    (
        "prefixed_id",
        r"(?iuU)(?=[OTC])(?:ORD|ORDER|TKT|TICKET|CASE)[-_]?[A-Z0-9][A-Z0-9_-]{2,}(?![A-Z0-9_-])",
        "[REDACTED_ID]",
    ),
)


def redact_pii(col: Column | str) -> Column:
    """Replace personal data, pattern by pattern; later patterns see earlier labels."""
    text = _c(col)
    for _, pattern, label in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, label)
    return text


def pii_counts(col: Column | str) -> dict[str, Column]:
    """Matches per class, each counted on the text the class would see."""
    text = _c(col)
    counts = {}
    for name, pattern, label in PII_PATTERNS:
        counts[name] = count_matches(text, pattern)
        text = F.regexp_replace(text, pattern, label)
    return counts


# --- sizes -----------------------------------------------------------------


def cjk_chars(col: Column | str) -> Column:
    return count_matches(col, CJK)


def estimate_tokens(col: Column | str, ratio: float = 1.0) -> Column:
    text = _c(col)
    cjk = cjk_chars(text)
    return F.ceil(cjk * F.lit(float(ratio)) + (F.length(text) - cjk) / F.lit(4.0)).cast("bigint")


# Fixed value: tokens added per list element.
MESSAGE_OVERHEAD = 6


def message_tokens(content: Column | str, tool_calls: Column | str | None = None, ratio: float = 1.0) -> Column:
    """Cost of one message inside a list; ``tool_calls`` is a JSON list of calls."""
    cost = estimate_tokens(content, ratio) + F.lit(MESSAGE_OVERHEAD)
    if tool_calls is None:
        return cost
    calls = F.from_json(_c(tool_calls), T.ArrayType(T.StringType()))
    return cost + F.coalesce(list_tokens(calls, ratio), F.lit(0))


def list_tokens(values: Column | str, ratio: float = 1.0) -> Column:
    """Total for an array of texts, overhead included."""
    return F.aggregate(
        _c(values), F.lit(0).cast("bigint"),
        lambda total, item: total + estimate_tokens(item, ratio) + F.lit(MESSAGE_OVERHEAD),
    )


def estimate_bytes(col: Column | str) -> Column:
    return (F.octet_length(_c(col)) + F.lit(16)).cast("bigint")


# --- sources ---------------------------------------------------------------


def section_anchor(path: Column | str) -> Column:
    return F.concat(F.lit("section-"), F.substring(F.sha2(F.array_join(_c(path), "/"), 256), 1, 16))


def source_name(source_key: Column | str) -> Column:
    """Document name inside a ``doc:<name>:<hash>`` key."""
    rest = F.substring(_c(source_key), 5, 2**31 - 1)
    return F.regexp_replace(rest, r"(?s)^(.*):[^:]*$", "$1")


def source_url(source_key: Column | str, path: Column | str) -> Column:
    quoted = F.url_encode(source_name(source_key))
    for found, wanted in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        quoted = F.regexp_replace(quoted, found, wanted)
    url = F.concat(F.lit("/api/v1/knowledge/source?source="), quoted, F.lit("#"), section_anchor(path))
    return F.when(_c(source_key).startswith("doc:"), url)


def normalize_url(col: Column | str) -> Column:
    """Lower-cased scheme and host, no default port, no ``/v1`` tail, no query."""
    url = strip(col)
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, parts, 1))
    authority = F.regexp_replace(F.regexp_extract(url, parts, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int")
    default = ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80))
    shown = F.when(port.isNull() | (port == 0) | default, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, parts, 3), "/+$", ""), "/v1$", "")
    netloc = F.concat(host, shown)
    prefix = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    return F.concat(prefix, F.when(netloc == "", F.lit("")).otherwise(F.concat(F.lit("//"), netloc)), path)


# --- status labels ---------------------------------------------------------

# Labels shown for status codes, the fields that carry a code,
# and the fields each tool may show.
STATUS_LABELS = {
    "open": "待处理",
    "closed": "已关闭",
    "shipped": "已发货",
    "delivered": "已签收",
    "in_transit": "运输中",
    "out_for_delivery": "派送中",
    "processing": "处理中",
    "approved": "已通过",
    "rejected": "未通过",
    "in_warranty": "在保",
    "expired": "已过保",
    "pending": "待处理",
    "returned": "已退回",
    "refunded": "已退款",
}
STATUS_FIELDS = ("status", "warranty_status", "return_status")
TOOL_FIELDS = {
    "query_order": (
        "source", "order_id", "status", "total", "found", "message",
        "product_name", "amount", "paid_at", "purchased_at",
    ),
    "query_product": ("source", "product_query", "name", "price", "in_stock", "found", "message"),
    "create_ticket": ("ticket_no", "status", "message"),
}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def humanize_status(fields: Column | str, tool: Column | str | None = None) -> Column:
    """Label status codes in a string map, hide internal keys, project per tool."""
    values = _c(fields)
    if tool is not None:
        allowed = F.create_map(
            *[x for name, keys in TOOL_FIELDS.items() for x in (F.lit(name), F.array(*map(F.lit, keys)))]
        )
        keys = F.try_element_at(allowed, _c(tool))
        values = F.map_filter(values, lambda k, v: F.coalesce(F.array_contains(keys, k), F.lit(True)))
    visible = F.map_filter(values, lambda k, v: ~k.startswith("internal_"))
    labels = _literal_map(STATUS_LABELS)
    return F.transform_values(
        visible,
        lambda k, v: F.when(k.isin(*STATUS_FIELDS), F.coalesce(F.try_element_at(labels, v), v)).otherwise(v),
    )
