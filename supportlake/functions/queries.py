"""Question normalisation: what a rewrite must keep, and lexical expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.text import _c, bind, strip

# Patterns of identifiers, quantities, clauses and negation.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_.-]*"
CHINESE_NUMBER = r"[零〇一二三四五六七八九十百千万亿两]+(?:点[零〇一二三四五六七八九]+)?"
FUZZY_NUMBER = r"(?:若干|数(?:十|百|千)?|十几|几十|几(?:十|百|千)?)"
NUMBER = rf"(?:\d+(?:\.\d+)?|{FUZZY_NUMBER}|{CHINESE_NUMBER})"
UNITS = (
    "千瓦时|毫安时|平方公里|平方米|立方米|平方厘米|摄氏度|毫升|公斤|千克|毫克|毫米|厘米|公里|千瓦|毫安|星期|个月|小时|"
    "分钟|块钱|天|日|周|月|年|元|块|钱|件|次|个|折|秒|米|升|斤|吨|克|瓦|伏|安|度|℃|℉|倍|人|张|岁|台|款|[%％]"
)
QUANTITY = rf"(?U)([$¥￥])?\s*([+\-−＋－]|负)?\s*({NUMBER})\s*({UNITS})?"
MARKED_NUMBER = (
    r"(?U)(?:选项|金额|价格|余额|售价|总价|折扣|数量|数字|活动号|编号|第)\s*"
    rf"(?:[+\-−＋－]|负)?(?:{FUZZY_NUMBER}|{CHINESE_NUMBER})"
    rf"(?:(?:还是|或者|或|和|、)\s*(?:[+\-−＋－]|负)?(?:{FUZZY_NUMBER}|{CHINESE_NUMBER}))*"
)
LEXICAL_ONE = (
    r"一点(?![零〇一二三四五六七八九十百千万亿两])|一起|一样|同一|一般|一定|一直|一边|一些|一种|一旦|一下|一向|一共|一律"
)
CLAUSE_END = r"[,，;；。！？!?]+|但是|然而|但"
NEGATION = r"不|无|未|没|非(?!常)|(?<!分)别|(?<!是)(?<!能)否"
NUMERAL = r"[零〇一二三四五六七八九十百千万亿两数几若干]"
SYNONYMS = (
    ("邮费", "运费"),
    ("退钱", "退款"),
    ("退东西", "退货"),
    ("不开机", "无法开机"),
    ("多久到", "配送时效"),
)
REASON_NOT_PRESERVED = "改写未完整保留标识、数值或否定范围，使用原话"
REASON_UNAVAILABLE = "改写服务或输出不可用，使用原话"


def _mask_inside(text: Column, span: str, digits: str, mask: str) -> Column:
    """Overwrite ``digits`` that lie inside matches of ``span``; lengths are kept.

    The text is cut into span matches and the stretches between them.
    """
    whole = rf"(?U)\A(?:{span})\z"

    def mask_text(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"(?U)(?:{span})|[\s\S]+?(?=(?:{span})|\z)"), F.lit(0))
        masked = F.transform(pieces, lambda p: F.when(p.rlike(whole), F.regexp_replace(p, digits, mask)).otherwise(p))
        return F.when(t.rlike(digits), F.array_join(masked, "")).otherwise(t)

    return bind(text, mask_text)


def identifier_signature(col: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(col), F.lit(f"({IDENTIFIER})"), F.lit(1)))


def _outside_identifiers(text: Column) -> Column:
    return _mask_inside(text, IDENTIFIER, "[0-9]", "x")


def quantity_signature(col: Column | str) -> Column:
    """Quantities in order: those with a unit, currency or digits, then marked numbers."""
    text = _c(col)
    matches = F.regexp_extract_all(_outside_identifiers(text), F.lit(QUANTITY), F.lit(0))

    def parts(match: Column) -> Column:
        names = ("currency", "sign", "number", "unit")
        return F.struct(*[F.regexp_extract(match, QUANTITY, i).alias(n) for i, n in enumerate(names, 1)])

    kept = F.filter(
        F.transform(matches, parts),
        lambda q: (q["unit"] != "") | (q["currency"] != "") | q["number"].rlike(r"(?U)\d|点"),
    )
    plain = F.transform(kept, lambda q: F.concat(q["currency"], q["sign"], q["number"], q["unit"]))
    return F.concat(plain, F.regexp_extract_all(text, F.lit(MARKED_NUMBER), F.lit(0)))


def clauses(col: Column | str) -> Column:
    return F.split(_c(col), CLAUSE_END, -1)


def unknown_unit_clauses(col: Column | str) -> Column:
    """Clauses in which a number is followed by a unit that is not in the list."""
    text = _c(col)
    masked = _outside_identifiers(text)
    for span in (MARKED_NUMBER.removeprefix("(?U)"), LEXICAL_ONE):
        masked = _mask_inside(masked, span, NUMERAL, "某")
    both = F.arrays_zip(clauses(text).alias("shown"), clauses(masked).alias("masked"))
    # Each match also captures, without consuming it, a CJK character after it.
    tail = rf"{QUANTITY}(?:(?=\s*([一-鿿])))?"

    def locked(pair: Column) -> Column:
        units = F.regexp_extract_all(pair["masked"], F.lit(tail), F.lit(4))
        following = F.regexp_extract_all(pair["masked"], F.lit(tail), F.lit(5))
        return F.exists(F.arrays_zip(units.alias("u"), following.alias("f")), lambda m: (m["u"] == "") & (m["f"] != ""))
    numbered = F.filter(both, lambda pair: pair["masked"].rlike(f"(?U){NUMBER}"))
    return F.transform(F.filter(numbered, locked), lambda pair: pair["shown"])


def negative_clauses(col: Column | str) -> Column:
    return F.filter(clauses(col), lambda c: (c != "") & c.rlike(NEGATION))


def accept_rewrite(raw: Column | str, candidate: Column | str) -> dict[str, Column]:
    """Columns ``canonical`` and ``downgrade_reason`` for a proposed rewrite."""
    raw = _c(raw)

    def same(c: Column) -> Column:
        kept = c != ""
        for signature in (identifier_signature, quantity_signature, unknown_unit_clauses, negative_clauses):
            kept = kept & (signature(raw) == signature(c))
        # NULL: no rewrite arrived; empty: refused.
        return F.when(c.isNull(), F.lit(None).cast("string")).when(kept, c).otherwise(F.lit(""))

    accepted = bind(strip(candidate), same)
    reason = F.when(accepted.isNull(), F.lit(REASON_UNAVAILABLE)).when(accepted == "", F.lit(REASON_NOT_PRESERVED)).otherwise(F.lit(""))
    return {"canonical": F.when(F.coalesce(accepted, F.lit("")) != "", accepted).otherwise(strip(raw)), "downgrade_reason": reason}


def expand_synonyms(
    raw: Column | str, canonical: Column | str, pairs: tuple[tuple[str, ...], ...] = SYNONYMS
) -> Column:
    raw, canonical = _c(raw), _c(canonical)
    parts = [F.array(raw, canonical)]
    for words in pairs:
        hit = F.lit(False)
        for word in words:
            hit = hit | raw.contains(word) | canonical.contains(word)
        parts.append(F.when(hit, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.concat(*parts)), " ")
