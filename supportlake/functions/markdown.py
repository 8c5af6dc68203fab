"""Markdown structure as column expressions over one document's text.

A document is cut into blocks by one regular expression and all later steps
are folds over its short block array, so a whole corpus is chunked in one
narrow pass: no shuffle, no per-row Python. Folds emit into short arrays that
are put together block by block (``scan``), and parts that belong together are
cut out by boundary arrays, so the work follows the length of a document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.text import _c, bind, strip

LINE_BREAK = "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\u2028\u2029]"

# Heading and sentence patterns, topic words, default labels.
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
SENTENCE_END = r"(?U)(?<=[。！？.!?])\s*"
CRITICAL = "退款|退货|退换|支付安全|账户安全|隐私|发票|保修|质保|取消订单"
FAQ_WORDS = "faq|常见问题"
AFTER_SALES_WORDS = "售后|维修|质保|保修"
DEFAULT_CATEGORY = "电商客服"
DEFAULT_QUESTION = "电商客服知识"

# Blocks all start with the line feed put before every line.
_BLANK = r"[\s\x1c-\x1f&&[^\n]]"
_FENCE = rf"\n{_BLANK}*(```|~~~)[\s\S]*?(?:\n{_BLANK}*\1[^\n]*|\z)"
_TABLE = rf"\n{_BLANK}*\|[\s\S]*?(?=\n(?!{_BLANK}*\|)|\z)"
_TITLE = rf"#{{1,6}}{_BLANK}[^\n]"
_HEADING_LINE = rf"\n(?={_TITLE})[^\n]*"
_PROSE = rf"\n[\s\S]*?(?=\n(?:{_BLANK}*(?:```|~~~|\|)|{_TITLE})|\z)"
BLOCK = rf"(?U){_FENCE}|{_TABLE}|{_HEADING_LINE}|{_PROSE}"

_SHOWN = "array<struct<path:array<string>,kind:string,content:string,begins:boolean>>"
STRINGS = "array<string>"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def lines(col: Column | str) -> Column:
    """Lines of a text; a final line break adds no line."""
    return F.split(F.regexp_replace(_c(col), rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, -1)


def blocks(col: Column | str) -> Column:
    """Headings, fences, tables and prose runs of a document, in order."""
    text = F.concat(F.lit("\n"), F.regexp_replace(_c(col), LINE_BREAK, "\n"))
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))


def scan(items: Column, state: dict[str, Column], emitted: str, step, width: int = 256) -> Column:
    """All outputs of a running fold: ``step(state struct, item)`` gives the next state (a dict of columns) and an array to emit.

    An array that grows by one element per step would be copied at every step; here a step grows an array of at most one block of
    ``width`` items, and only blocks are put together.
    """
    def run(whole: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            following, out = step(acc, item)
            return F.struct(*[following[k].alias(k) for k in state], F.concat(acc["out"], out).alias("out"))

        def block(acc: Column, number: Column) -> Column:
            start = F.struct(*[acc[k].alias(k) for k in state], empty(emitted).alias("out"))
            inner = F.aggregate(F.slice(whole, number * width + 1, F.lit(width)), start, one)
            return bind(inner, lambda r: F.struct(*[r[k].alias(k) for k in state], F.concat(acc["out"], r["out"]).alias("out")))

        first = F.struct(*[v.alias(k) for k, v in state.items()], empty(emitted).alias("out"))
        numbers = F.sequence(F.lit(0), F.greatest((F.size(whole) - 1) / F.lit(width), F.lit(0)).cast("int"))
        return F.aggregate(numbers, first, block, lambda acc: acc["out"])

    return bind(items, run)


def block_kind(block: Column) -> Column:
    return (
        F.when(block.rlike(rf"(?U)\A\n{_BLANK}*(?:```|~~~)"), "code")
        .when(block.rlike(rf"(?U)\A\n{_BLANK}*\|"), "table")
        .when(block.rlike(rf"(?U)\A\n{_TITLE}"), "heading")
        .otherwise("prose")
    )


def _joined_lines(block: Column, separator: str) -> Column:
    stripped = F.transform(F.split(block, "\n"), strip)
    return F.array_join(F.filter(stripped, lambda line: line != ""), separator)


def block_content(block: Column, kind: Column) -> Column:
    return (
        F.when(kind == "code", strip(block))
        .when(kind == "table", _joined_lines(block, "\n"))
        .otherwise(_joined_lines(block, " "))
    )


def segments(col: Column | str) -> Column:
    """(path, kind, content) in document order; adjacent prose of one path is merged."""
    described = F.transform(
        blocks(col),
        lambda b: F.struct(
            b.alias("block"), block_kind(b).alias("kind"),
        ),
    )
    filled = F.transform(
        described,
        lambda d: F.struct(
            d["kind"].alias("kind"),
            F.length(F.regexp_extract(d["block"], r"\A\n(#*)", 1)).alias("level"),
            F.when(d["kind"] == "heading", strip(F.regexp_extract(F.substring(d["block"], 2, 2**31 - 1), HEADING, 2)))
            .otherwise(block_content(d["block"], d["kind"]))
            .alias("content"),
        ),
    )

    def step(acc: Column, item: Column) -> tuple[dict[str, Column], Column]:
        path, heading = acc["path"], item["kind"] == "heading"
        shown = ~heading & (item["content"] != "")
        # Prose goes on where the last thing shown was prose of the same path.
        begins = ~((item["kind"] == "prose") & (acc["kind"] == "prose") & (acc["shown_path"] == path))
        entry = F.struct(path.alias("path"), item["kind"].alias("kind"), item["content"].alias("content"), begins.alias("begins"))
        following = {
            "path": F.when(heading, F.concat(F.slice(path, F.lit(1), item["level"] - 1), F.array(item["content"]))).otherwise(path),
            "kind": F.when(shown, item["kind"]).otherwise(acc["kind"]),
            "shown_path": F.when(shown, path).otherwise(acc["shown_path"]),
        }
        return following, F.when(shown, F.array(entry)).otherwise(empty(_SHOWN))

    state = {"path": empty(STRINGS), "kind": F.lit(""), "shown_path": empty(STRINGS)}

    def merged(out: Column) -> Column:
        every = F.transform(out, lambda x, i: F.when(x["begins"], i))
        starts = F.filter(every, lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            def one(start: Column, n: Column) -> Column:
                stop = F.coalesce(F.get(at, n + 1), F.size(out))
                first = F.get(out, start)
                texts = F.transform(F.slice(out, start + 1, stop - start), lambda x: x["content"])
                return F.struct(first["path"].alias("path"), first["kind"].alias("kind"), F.array_join(texts, " ").alias("content"))

            return F.transform(at, one)

        return bind(starts, cut)

    return bind(scan(filled, state, _SHOWN, step), merged)


# --- size-limited parts ----------------------------------------------------


def split_sentences(col: Column | str) -> Column:
    # The split itself eats the white space between sentences.
    return F.filter(F.split(strip(col), SENTENCE_END, -1), lambda s: s != "")


def _tail_within(sentences: Column, overlap: int) -> Column:
    """Last sentences of a chunk: always one, then more while they fit the overlap."""
    def step(acc: Column, sentence: Column) -> Column:
        size = acc["size"] + F.length(sentence) + F.when(acc["n"] > 0, 1).otherwise(0)
        takes = acc["open"] & ((acc["n"] == 0) | (size <= overlap))
        return F.struct(
            F.when(takes, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(takes, size).otherwise(acc["size"]).alias("size"),
            takes.alias("open"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))
    return F.aggregate(
        F.reverse(sentences), start, step,
        lambda acc: F.struct(
            F.slice(sentences, F.size(sentences) - acc["n"] + 1, acc["n"]).alias("items"), acc["size"].alias("size")
        ),
    )


def pack_sentences(sentences: Column | str, max_chars: int, overlap: int) -> Column:
    """Greedy chunks of whole sentences, each opening with the previous chunk's tail.

    The tail is left out where it would not leave room for the next sentence;
    a sentence longer than the limit stays whole.
    """
    def step(acc: Column, sentence: Column) -> Column:
        length = F.length(sentence)

        def opened(tail: Column) -> Column:
            keeps = F.size(tail["items"]) > 0
            return F.struct(
                F.concat(acc["out"], F.array(F.array_join(acc["current"], " "))).alias("out"),
                F.concat(tail["items"], F.array(sentence)).alias("current"),
                (F.when(keeps, tail["size"] + 1).otherwise(0) + length).alias("size"),
            )

        grown = F.struct(
            acc["out"].alias("out"),
            F.concat(acc["current"], F.array(sentence)).alias("current"),
            (acc["size"] + F.when(F.size(acc["current"]) > 0, 1).otherwise(0) + length).alias("size"),
        )
        none = F.struct(empty(STRINGS).alias("items"), F.lit(0).alias("size"))
        if overlap > 0:
            tail = bind(
                _tail_within(acc["current"], overlap),
                lambda t: F.when(t["size"] + 1 + length > max_chars, none).otherwise(
                    F.struct(t["items"].alias("items"), t["size"].alias("size"))
                ),
            )
            closed = bind(tail, opened)
        else:
            closed = opened(none)
        fits = (F.size(acc["current"]) == 0) | (acc["size"] + 1 + length <= max_chars)
        return F.when(fits, grown).otherwise(closed)

    start = F.struct(empty(STRINGS).alias("out"), empty(STRINGS).alias("current"), F.lit(0).alias("size"))
    return F.aggregate(
        _c(sentences), start, step,
        lambda acc: F.when(F.size(acc["current"]) == 0, acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.array_join(acc["current"], " ")))
        ),
    )


def split_table(table_lines: Column | str, max_chars: int) -> Column:
    """Parts of a table that each repeat its first two lines; rows are never cut."""
    rows = _c(table_lines)
    head = F.array_join(F.slice(rows, 1, 2), "\n")

    def step(acc: Column, row: Column) -> Column:
        longer = F.concat(acc["current"], F.lit("\n"), row)
        flush = (acc["current"] != head) & (F.length(longer) > max_chars)
        return F.struct(
            F.when(flush, F.concat(acc["out"], F.array(acc["current"]))).otherwise(acc["out"]).alias("out"),
            F.when(flush, F.concat(head, F.lit("\n"), row)).otherwise(longer).alias("current"),
        )

    start = F.struct(empty(STRINGS).alias("out"), head.alias("current"))
    body = F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0)))
    parts = F.aggregate(body, start, step, lambda acc: F.concat(acc["out"], F.array(acc["current"])))
    return F.when(F.size(rows) <= 2, F.array(F.array_join(rows, "\n"))).otherwise(parts)


def sized_parts(segment: Column, max_chars: int, overlap: int) -> Column:
    return (
        F.when(segment["kind"] == "table", split_table(F.split(segment["content"], "\n"), max_chars))
        .when(segment["kind"] == "code", F.array(segment["content"]))
        .otherwise(pack_sentences(split_sentences(segment["content"]), max_chars, overlap))
    )


def numbered_parts(segs: Column | str, max_chars: int, overlap: int) -> Column:
    """All parts of a document with their ordinal among the parts of one path."""
    sized = F.transform(
        _c(segs),
        lambda s: F.struct(s["path"].alias("path"), s["kind"].alias("kind"), sized_parts(s, max_chars, overlap).alias("parts")),
    )

    def numbered(items: Column) -> Column:
        # How many parts of the same path come before: a running sum over the segments in the order of their paths.
        keyed = F.array_sort(F.transform(
            items, lambda s, i: F.struct(F.array_join(s["path"], "\x01").alias("key"), i.alias("i"), F.size(s["parts"]).cast("bigint").alias("n"))
        ))

        def step(acc: Column, item: Column) -> tuple[dict[str, Column], Column]:
            before = F.when(item["key"] == acc["key"], acc["upto"]).otherwise(F.lit(0).cast("bigint"))
            entry = F.struct(item["i"].alias("i"), before.alias("before"))
            return {"key": item["key"], "upto": before + item["n"]}, F.array(entry)

        state = {"key": F.lit(None).cast("string"), "upto": F.lit(0).cast("bigint")}
        bases = F.array_sort(scan(keyed, state, "array<struct<i:int,before:bigint>>", step))

        def parts(at: Column) -> Column:
            return F.flatten(F.transform(items, lambda s, i: F.transform(s["parts"], lambda part, j: F.struct(
                s["path"].alias("path"), s["kind"].alias("kind"), part.alias("answer"), (F.get(at, i)["before"] + j).alias("ordinal")
            ))))

        return bind(bases, parts)

    return bind(sized, numbered)


# --- labels of a part ------------------------------------------------------


def chunk_category(path: Column | str) -> Column:
    parents = F.slice(_c(path), F.lit(1), F.greatest(F.size(_c(path)) - 1, F.lit(0)))
    return F.when(F.size(_c(path)) > 1, F.array_join(parents, " / ")).otherwise(F.lit(DEFAULT_CATEGORY))


def chunk_question(path: Column | str) -> Column:
    asked = F.filter(_c(path), lambda h: h.rlike("[?？]$"))
    return F.coalesce(
        F.try_element_at(asked, F.lit(-1)), F.try_element_at(_c(path), F.lit(-1)), F.lit(DEFAULT_QUESTION)
    )


def classify_content_type(source: Column | str, path: Column | str) -> Column:
    value = F.lower(F.concat(_c(source), F.lit(" "), F.array_join(_c(path), " ")))
    return (
        F.when(value.rlike(FAQ_WORDS), "product_faq").when(value.rlike(AFTER_SALES_WORDS), "after_sales").otherwise("policy")
    )


def flag_critical(path: Column | str, answer: Column | str) -> Column:
    return F.concat(F.array_join(_c(path), " "), F.lit(" "), F.substring(_c(answer), 1, 160)).rlike(CRITICAL)


def chunk_key(source: Column | str, path: Column | str, ordinal: Column | str) -> Column:
    digest = F.sha2(
        F.concat_ws("\x00", _c(source), F.array_join(_c(path), "/"), _c(ordinal).cast("string")), 256
    )
    return F.concat(F.lit("doc:"), _c(source), F.lit(":"), F.substring(digest, 1, 16))
