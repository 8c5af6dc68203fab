"""Text functions against plain Python on small fixtures."""

import hashlib
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from supportlake.functions import queries as qn
from supportlake.functions import text as tx
from supportlake.functions.lexical import tokenize


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in frame.select("i", make("v").alias("o")).orderBy("i").collect()]


TEXTS = [
    "", " 　 padded \t\n", "call 13812345678 or +86 13912345678.", "no113812345678x 138123456789",
    "Mail A.b+c@Example.co.uk, x@y.z and q@w.com1", "id 11010519491231002X! 110105194912310021a",
    "订单编号：AB-12_9 工单号 X99 order id: Q1234 Ticket no #77-A", "ORD-1234 case_99a ordinary TKT9 TICKETX-1 CASE-1",
    "ordinary order of cases", "86-13812345678 0086 13812345678", "中文 手机 13812345678，邮箱 a@b.cn。", "１３８１２３４５６７８",
]


def test_redaction_matches_sequential_python_substitution(spark):
    got = column(spark, TEXTS, tx.redact_pii)
    for text, out in zip(TEXTS, got):
        want = text
        for _, pattern, label in tx.PII_PATTERNS:
            flags = re.I if "i" in pattern[:6] else 0
            want = re.sub(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern), label, want, flags=flags)
        assert out == want, text
    assert got[2] == "call [PHONE] or [PHONE]."
    assert "[ID_CARD]!" in got[5]


def test_pii_counts_follow_redaction_order(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    counts = rows.select([c.alias(n) for n, c in tx.pii_counts("v").items()]).groupBy().sum().first()
    redacted = "".join(column(spark, TEXTS, tx.redact_pii))
    assert counts["sum(phone)"] == redacted.count("[PHONE]")
    assert counts["sum(email)"] == redacted.count("[EMAIL]")
    assert counts["sum(labelled_id)"] + counts["sum(prefixed_id)"] == redacted.count("[REDACTED_ID]")


def test_strip_removes_unicode_space(spark):
    values = ["　 a b \n", "\x1cx\x1f", "", "plain"]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]


def test_long_texts_are_stripped_and_redacted_where_needed_only(spark):
    """F8: the ends of a text say whether it is searched, and a pattern looks at one character of most places."""
    values = ["　 a b \n", "\x1cx\x1f", "", "plain", "a\u2028", "\n", "in side", None]
    assert column(spark, values, tx.strip_text) == column(spark, values, tx.strip) == [v if v is None else v.strip() for v in values]
    plain = {name: pattern for name, pattern, _ in tx.PII_PATTERNS if name != "email"}
    assert all("(?=[" in pattern for pattern in plain.values())
    mixed = [f"{t} {u}" for t in TEXTS for u in ("", "Order ID Ab12", "tIcKeT no:99x", "+8613812345678", "0086-13812345678", "工单号是Q12", "caſe-123")]
    for pattern in plain.values():
        whole = re.sub(r"\(\?=\[.*?\]\)", "", pattern, count=1)
        assert column(spark, mixed, lambda v: F.regexp_replace(v, pattern, "#")) == column(spark, mixed, lambda v: F.regexp_replace(v, whole, "#"))


def test_fingerprint_ignores_width_case_space_and_punctuation(spark):
    values = ["Ｓtraße  9!", "strasse_9", "STRASSE-９", "other", "２退款，①", "2退款1", "ﬁn²"]
    got = column(spark, values, tx.fingerprint_text)
    assert got[0] == got[1] == got[2] != got[3]
    assert got[4] == got[5]
    for value, out in zip(values, got):
        folded = unicodedata.normalize("NFKC", value).casefold()
        kept = "".join(ch for ch in folded if ch.isalnum())
        assert out == hashlib.sha256(kept.encode()).hexdigest()


def test_content_hash_is_nfc(spark):
    frame = spark.createDataFrame([("c", ["q "], "é"), ("c", ["q"], "é")], "c string, q array<string>, a string")
    hashes = {r[0] for r in frame.select(tx.content_hash("c", "q", "a")).collect()}
    assert hashes == {hashlib.sha256("c\nq\né".encode()).hexdigest()}


@pytest.mark.parametrize("ratio", [1.0, 0.6])
def test_token_estimate(spark, ratio):
    values = ["", "abcd", "abcde", "中文ab", "㐀鿿", "混 x 合 yz 12345"]

    def want(text):
        cjk = sum("㐀" <= ch <= "鿿" for ch in text)
        return math.ceil(cjk * ratio + (len(text) - cjk) / 4)

    assert column(spark, values, lambda v: tx.estimate_tokens(v, ratio)) == [want(v) for v in values]


def test_message_tokens_add_tool_calls_and_overhead(spark):
    frame = spark.createDataFrame([("abcd", '[{"a":1},{"b":22}]'), ("abcd", None), ("abcd", "[]")], "c string, t string")
    assert [r[0] for r in frame.select(tx.message_tokens("c", "t")).collect()] == [1 + 6 + (2 + 6) + (2 + 6), 7, 7]


def test_source_url_quotes_like_a_path_segment(spark):
    rows = spark.createDataFrame([("doc:a b*~ü/é:x.md:0f", ["h"]), ("faq:1", ["h"])], "k string, p array<string>")
    urls = [r[0] for r in rows.select(tx.source_url("k", "p")).collect()]
    anchor = hashlib.sha256(b"h").hexdigest()[:16]
    assert urls == [f"/api/v1/knowledge/source?source=a%20b%2A~%C3%BC%2F%C3%A9%3Ax.md#section-{anchor}", None]


def test_normalize_url(spark):
    values = ["HTTPS://User@API.Example.com:443/v1/?a=1#f", "http://h:80/v1", "http://h:8080/x/", "https://h:80", " http://[::1]:443/v1 "]
    want = ["https://api.example.com", "http://h", "http://h:8080/x", "https://h:80", "http://::1:443"]
    assert column(spark, values, tx.normalize_url) == want


def test_humanize_projects_labels_and_hides(spark):
    fields = {"status": "shipped", "internal_x": "1", "warranty_status": "expired", "total": "5", "name": "open"}
    frame = spark.createDataFrame([(fields, "query_order"), (fields, "other")], "m map<string,string>, t string")
    got = [r[0] for r in frame.select(tx.humanize_status("m", "t")).collect()]
    assert got[0] == {"status": "已发货", "total": "5"}
    assert got[1] == {"status": "已发货", "warranty_status": "已过保", "total": "5", "name": "open"}


def test_quantities(spark):
    values = [
        "买3件，¥99.5，-10％", "iPhone15 Pro 三天", "三个月和几个月", "数字五 第三和四款", "A-12x 5", "负2度 一点五折", "十台还是二十台", "若干天",
    ]
    got = column(spark, values, qn.quantity_signature)
    assert got == [
        ["3件", "¥99.5", "-10％"], ["三天"], ["三个月", "几个月"], ["四款", "数字五", "第三和四"], ["5"],
        ["负2度", "一点五折"], ["十台", "二十台"], ["若干天"],
    ]


def test_unknown_units(spark):
    values = ["买5串，要3件", "没有一起买", "第三和四款", "5G手机五串但五件", "2 颗", "数量五呢", "一点也不"]
    got = column(spark, values, qn.unknown_unit_clauses)
    assert got == [["买5串"], [], [], ["5G手机五串"], ["2 颗"], [], []]


def test_negative_clauses(spark):
    values = ["不能退，可以换但没有发票。非常好", "分别说明，能否退；是否退，否则", "无"]
    assert column(spark, values, qn.negative_clauses) == [["不能退", "没有发票"], ["否则"], ["无"]]


def test_rewrite_needs_equal_signatures(spark):
    rows = [
        ("SE2 买3件 能退吗", "SE2 的3件能退货吗"), ("SE2 买3件", "SE 买3件"), ("买3件", "买4件"), ("不能退", "能退"), ("x ", None), ("abc", "  "), ("买5串", "买5根"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, cand string")
    out = frame.select("i", *[c.alias(n) for n, c in qn.accept_rewrite("raw", "cand").items()]).orderBy("i").collect()
    assert [r["canonical"] for r in out] == ["SE2 的3件能退货吗", "SE2 买3件", "买3件", "不能退", "x", "abc", "买5串"]
    assert [r["downgrade_reason"] for r in out] == ["", *[qn.REASON_NOT_PRESERVED] * 3, qn.REASON_UNAVAILABLE, qn.REASON_NOT_PRESERVED, qn.REASON_NOT_PRESERVED]


def test_synonyms_add_both_members_once(spark):
    frame = spark.createDataFrame([("邮费多少", "运费多少"), ("plain", "plain")], "r string, c string")
    got = [r[0] for r in frame.select(qn.expand_synonyms("r", "c")).collect()]
    assert got == ["邮费多少 运费多少 邮费 运费", "plain"]


def test_tokenize_words_and_cjk_pairs(spark):
    assert column(spark, ["Foo_1, bar! 退款政策x 退"], tokenize) == [["foo_1", "bar", "退款", "款政", "政策", "x", "退"]]
