"""Registered queries: text functions, chunking steps, question rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import markdown as md
from supportlake.functions import queries as qn
from supportlake.functions import text as tx
from supportlake.operators import chunking
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.sources.tables import read_input

# --- lines, sentences, chunk labels ----------------------------------------


@query(
    "chk_explode_lines",
    """SELECT doc_id, CAST(i AS BIGINT) AS line_no, lines[i + 1] AS line
       FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents) t,
            LATERAL (SELECT unnest(range(len(lines))) AS i) r""",
)
def chk_explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.explode_lines(ad.documents_spread(spark, sf).select("doc_id", "text"))
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "chk_split_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(
          string_split(regexp_replace(text, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)),
          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
       SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest,
              sha256(array_to_string(s, '|')) AS sentences_sha FROM s""",
)
def chk_split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents_spread(spark, sf).select("doc_id", md.split_sentences("text").alias("s"))
    return docs.select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"),
        F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"),
        F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha"),
    )


@query("chk_pack_sentences")
def chk_pack_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents_spread(spark, sf).select(
        "doc_id", F.posexplode_outer(md.pack_sentences(md.split_sentences("text"), 1200, 200)).alias("part_no", "part")
    )
    return docs.filter(F.col("part_no").isNotNull())


def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents rendered as Markdown by line number, so that every block kind occurs."""
    lines = md.lines("text")

    def render(line, i):
        return (
            F.when(i % 9 == 0, F.concat(F.substring(F.lit("######"), 1, (i / F.lit(9)).cast("int") % 4 + 1), F.lit(" "), line))
            .when((i % 9).isin(3, 4, 5), F.concat(F.lit("| "), line, F.lit(" | x |")))
            .when(i % 27 == 16, F.lit("```"))
            .when(i % 27 == 20, F.lit("```"))
            .otherwise(line)
        )

    docs = ad.documents_spread(spark, sf)
    return docs.select("doc_id", "source", F.array_join(F.transform(lines, render), "\n").alias("text"))


@query(
    "chk_segments",
    r"""WITH RECURSIVE raw AS (
      SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents),
    lines AS (
      SELECT doc_id, i, CASE
        WHEN i % 9 = 0 THEN substring('######', 1, CAST(i // 9 AS INTEGER) % 4 + 1) || ' ' || ls[i + 1]
        WHEN i % 9 IN (3, 4, 5) THEN '| ' || ls[i + 1] || ' | x |'
        WHEN i % 27 IN (16, 20) THEN '```' ELSE ls[i + 1] END AS line
      FROM raw, LATERAL (SELECT unnest(range(len(ls))) AS i) r),
    fenced AS (
      SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER w AS fences FROM lines
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    kinds AS (
      SELECT *, CASE
        WHEN fences % 2 = 1 OR line LIKE '```%' THEN 'code'
        WHEN regexp_matches(line, '^#{1,6}\s.') THEN 'heading'
        WHEN regexp_matches(line, '^\s*$') THEN 'blank'
        WHEN regexp_matches(line, '^\s*\|') THEN 'table' ELSE 'prose' END AS kind FROM fenced),
    heads AS (
      SELECT doc_id, i, length(regexp_extract(line, '^(#+)', 1)) AS lvl,
        regexp_replace(regexp_extract(line, '^#{1,6}\s+(.+?)\s*#*\s*$', 1), '^\s+|\s+$', '', 'g') AS title,
        row_number() OVER (PARTITION BY doc_id ORDER BY i) AS h FROM kinds WHERE kind = 'heading'),
    depths AS (
      SELECT *, h + least(0, min(lvl - h) OVER (PARTITION BY doc_id ORDER BY h)) AS depth FROM heads),
    paths AS (
      SELECT d.doc_id, d.i, list(p.title ORDER BY p.depth) AS path FROM depths d JOIN depths p
        ON p.doc_id = d.doc_id AND p.h <= d.h AND p.depth <= d.depth
        AND NOT EXISTS (SELECT 1 FROM depths q WHERE q.doc_id = d.doc_id AND q.h > p.h AND q.h <= d.h AND q.depth <= p.depth)
      GROUP BY d.doc_id, d.i),
    placed AS (
      SELECT k.doc_id, k.i, k.line, k.kind,
        CASE WHEN kind = 'code' THEN (fences + CASE WHEN line LIKE '```%' THEN fences % 2 ELSE 1 END) // 2 END AS block,
        (SELECT max(h.i) FROM heads h WHERE h.doc_id = k.doc_id AND h.i < k.i) AS hi FROM kinds k),
    located AS (
      SELECT p.doc_id, p.i, p.line, p.kind, p.block, coalesce(array_to_string(t.path, ' > '), '') AS path
      FROM placed p LEFT JOIN paths t ON t.doc_id = p.doc_id AND t.i = p.hi),
    flagged AS (
      SELECT *, CASE
          WHEN kind IN ('heading', 'blank') THEN 0
          WHEN kind = 'prose' THEN CASE WHEN lag(CASE WHEN kind IN ('heading', 'blank') THEN NULL ELSE kind || path END IGNORE NULLS)
               OVER w = kind || path THEN 0 ELSE 1 END
          WHEN kind = 'table' THEN CASE WHEN lag(kind) OVER w = 'table' THEN 0 ELSE 1 END
          ELSE CASE WHEN lag(kind) OVER w = 'code' AND lag(block) OVER w = block THEN 0 ELSE 1 END END AS starts
      FROM located WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM flagged)
    SELECT doc_id, CAST(seg - 1 AS BIGINT) AS position, min(kind) AS kind, min(path) AS path,
      sha256(CASE min(kind)
        WHEN 'code' THEN regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g')
        WHEN 'table' THEN string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY i)
        ELSE string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' ' ORDER BY i) END) AS content_sha
    FROM numbered WHERE kind NOT IN ('heading', 'blank') GROUP BY doc_id, seg""",
)
def chk_segments(spark: SparkSession, sf: str) -> DataFrame:
    segs = chunking.document_segments(markdown_documents(spark, sf).select("doc_id", "text"))
    return segs.select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "kind",
        F.array_join("path", " > ").alias("path"), F.sha2("content", 256).alias("content_sha"),
    )


@query("chk_split_table")
def chk_split_table(spark: SparkSession, sf: str) -> DataFrame:
    tables = chunking.document_segments(markdown_documents(spark, sf).select("doc_id", "text")).filter("kind = 'table'")
    parts = md.split_table(F.split("content", "\n"), 400)
    out = tables.select("doc_id", "position", F.posexplode_outer(parts).alias("part_no", "part"))
    return out.filter(F.col("part_no").isNotNull())


_LABEL_CTE = """WITH p AS (SELECT doc_id, source, text,
    CASE doc_id % 3 WHEN 0 THEN [] WHEN 1 THEN [source] ELSE [lang, 'How to ' || source || '?', source] END AS path FROM documents)
"""


def _label_paths(spark: SparkSession, sf: str) -> DataFrame:
    how = F.concat(F.lit("How to "), F.col("source"), F.lit("?"))
    path = (
        F.when(F.col("doc_id") % 3 == 0, md.empty(md.STRINGS))
        .when(F.col("doc_id") % 3 == 1, F.array("source"))
        .otherwise(F.array(F.col("lang"), how, F.col("source")))
    )
    return ad.documents(spark, sf).select("doc_id", "source", "text", path.alias("path"))


@query(
    "chk_labels",
    _LABEL_CTE
    + """SELECT doc_id,
        CASE WHEN len(path) > 1 THEN array_to_string(path[1:len(path) - 1], ' / ') ELSE '电商客服' END AS category,
        coalesce(list_filter(path, lambda h: h LIKE '%?')[-1], path[-1], '电商客服知识') AS question FROM p""",
)
def chk_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _label_paths(spark, sf).select(
        "doc_id", md.chunk_category("path").alias("category"), md.chunk_question("path").alias("question")
    )


@query(
    "chk_classify",
    """WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'FAQ.md' WHEN 1 THEN '售后.md' ELSE source END AS source,
         CASE WHEN doc_id % 5 = 0 THEN ['发票'] ELSE [lang] END AS path FROM documents)
       SELECT doc_id, CASE
           WHEN regexp_matches(lower(source || ' ' || array_to_string(path, ' ')), 'faq|常见问题') THEN 'product_faq'
           WHEN regexp_matches(lower(source || ' ' || array_to_string(path, ' ')), '售后|维修|质保|保修') THEN 'after_sales'
           ELSE 'policy' END AS content_type,
         regexp_matches(array_to_string(path, ' ') || ' ' || substring(text, 1, 160),
           '退款|退货|退换|支付安全|账户安全|隐私|发票|保修|质保|取消订单') AS is_critical FROM d""",
)
def chk_classify(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    docs = ad.documents(spark, sf).select(
        "doc_id", "text",
        F.when(n % 4 == 0, "FAQ.md").when(n % 4 == 1, "售后.md").otherwise(F.col("source")).alias("source"),
        F.when(n % 5 == 0, F.array(F.lit("发票"))).otherwise(F.array("lang")).alias("path"),
    )
    return docs.select(
        "doc_id", md.classify_content_type("source", "path").alias("content_type"),
        md.flag_critical("path", "text").alias("is_critical"),
    )


@query(
    "chk_keys",
    _LABEL_CTE
    + """SELECT doc_id, 'doc:' || source || ':' || substring(
          sha256(source || chr(0) || array_to_string(path, '/') || chr(0) || CAST(doc_id % 5 AS VARCHAR)), 1, 16) AS source_key
        FROM p""",
)
def chk_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label_paths(spark, sf)
    return rows.select("doc_id", md.chunk_key("source", "path", F.col("doc_id") % 5).alias("source_key"))


@query(
    "chk_link_neighbors",
    """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents)
       SELECT doc_id, position, source || '#' || lag(position) OVER w AS previous_source_key,
         source || '#' || lead(position) OVER w AS next_source_key FROM p WINDOW w AS (PARTITION BY source ORDER BY position)""",
)
def chk_link_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    from supportlake.operators.scan import running

    docs = ad.documents(spark, sf).select("doc_id", "source")
    placed = running(docs, ["source"], "doc_id", {"position": ("sum", F.lit(1).cast("bigint"))}, inclusive=False)
    keyed = placed.withColumn("key", F.concat("source", F.lit("#"), F.col("position").cast("string")))
    linked = chunking.link_neighbors(keyed, "source", "position", "key")
    return linked.select("doc_id", "position", "previous_source_key", "next_source_key")


@query("chk_chunk_documents")
def chk_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = markdown_documents(spark, sf)
    return chunking.chunk_documents(
        docs.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text")
    )


# --- normalisation, hashing, redaction -------------------------------------

_EMB = "lang || ' / ' || source || chr(10) || 'About ' || source || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("txt_embedding_text", f"SELECT doc_id, length(e) AS n_chars, sha256(e) AS text_sha FROM (SELECT doc_id, {_EMB} AS e FROM documents)")
def txt_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    text = ad.chunk_drafts(spark, sf).select("doc_id", tx.embedding_text("category", "questions", "answer").alias("e"))
    return text.select("doc_id", F.length("e").cast("bigint").alias("n_chars"), F.sha2("e", 256).alias("text_sha"))


@query("txt_content_hash", f"SELECT doc_id, sha256(nfc_normalize({_EMB})) AS content_hash FROM documents")
def txt_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    drafts = ad.chunk_drafts(spark, sf)
    return drafts.select("doc_id", tx.content_hash("category", "questions", "answer").alias("content_hash"))


FINGERPRINT_SQL = "sha256(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query("txt_fingerprint", f"SELECT doc_id, {FINGERPRINT_SQL.format(_EMB)} AS fingerprint FROM documents")
def txt_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    drafts = ad.chunk_drafts(spark, sf)
    return drafts.select("doc_id", tx.fingerprint("category", "questions", "answer").alias("fingerprint"))


@query("txt_redact_pii")
def txt_redact_pii(spark: SparkSession, sf: str) -> DataFrame:
    return ad.documents_spread(spark, sf).select("doc_id", tx.redact_pii("text").alias("redacted"))


@query("txt_redact_messages")
def txt_redact_messages(spark: SparkSession, sf: str) -> DataFrame:
    return ad.messages(spark, sf).select("id", tx.redact_pii("content").alias("redacted"))


@query("txt_count_pii")
def txt_count_pii(spark: SparkSession, sf: str) -> DataFrame:
    counts = tx.pii_counts("text")
    per_doc = ad.documents_spread(spark, sf).select("source", *[c.alias(n) for n, c in counts.items()])
    return per_doc.groupBy("source").agg(*[F.sum(n).alias(n) for n in counts])


@query(
    "txt_count_email",
    """SELECT source, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS BIGINT) AS n_emails
       FROM documents GROUP BY source""",
)
def txt_count_email(spark: SparkSession, sf: str) -> DataFrame:
    per_doc = ad.documents_spread(spark, sf).select("source", tx.count_matches("text", tx.PII_PATTERNS[1][1]).alias("n"))
    return per_doc.groupBy("source").agg(F.sum("n").alias("n_emails"))


TOKENS_SQL = "CAST(ceil(len(regexp_extract_all({0}, '[㐀-鿿]')) * {1} + (length({0}) - len(regexp_extract_all({0}, '[㐀-鿿]'))) / 4.0) AS BIGINT)"
MESSAGE_TOKENS_SQL = f"({TOKENS_SQL.format('content', '1.0')} + 6 + CASE WHEN tool_calls IS NULL THEN 0 ELSE 12 END)"


@query("txt_estimate_tokens", ad.with_cte("messages") + f"SELECT id, {TOKENS_SQL.format('content', '0.6')} AS tokens FROM messages")
def txt_estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return ad.messages(spark, sf).select("id", tx.estimate_tokens("content", 0.6).alias("tokens"))


@query(
    "txt_estimate_tokens_list",
    ad.with_cte("messages")
    + f"SELECT conversation_id, CAST(sum({MESSAGE_TOKENS_SQL}) AS BIGINT) AS tokens FROM messages GROUP BY conversation_id",
)
def txt_estimate_tokens_list(spark: SparkSession, sf: str) -> DataFrame:
    return ad.messages(spark, sf).groupBy("conversation_id").agg(
        F.sum(tx.message_tokens("content", "tool_calls")).alias("tokens")
    )


@query("txt_estimate_bytes", "SELECT doc_id, CAST(octet_length(encode(text)) + 16 AS BIGINT) AS n_bytes FROM documents")
def txt_estimate_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return ad.documents(spark, sf).select("doc_id", tx.estimate_bytes("text").alias("n_bytes"))


@query(
    "txt_source_url",
    """SELECT doc_id, 'section-' || substring(sha256(lang || '/' || source), 1, 16) AS anchor,
         CASE WHEN doc_id % 4 > 0 THEN '/api/v1/knowledge/source?source=' || url_encode(source || ' a*b~(ü)/' || doc_id || '.md')
           || '#section-' || substring(sha256(lang || '/' || source), 1, 16) END AS url FROM documents""",
)
def txt_source_url(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit(" a*b~(ü)/"), F.col("doc_id").cast("string"), F.lit(".md"))
    prefix = F.when(F.col("doc_id") % 4 > 0, F.lit("doc:")).otherwise(F.lit("faq:"))
    docs = ad.documents(spark, sf).select(
        "doc_id", F.concat(prefix, name, F.lit(":0a")).alias("key"), F.array("lang", "source").alias("path")
    )
    return docs.select("doc_id", tx.section_anchor("path").alias("anchor"), tx.source_url("key", "path").alias("url"))


@query(
    "txt_expand_synonyms",
    """WITH q AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' 邮费' WHEN 1 THEN ' 退货 不开机' ELSE '' END AS raw,
         text || ' now' AS canonical FROM benchmark)
       SELECT item_id, array_to_string(list_concat([raw, canonical],
         CASE item_id % 3 WHEN 0 THEN ['邮费', '运费'] WHEN 1 THEN ['退东西', '退货', '不开机', '无法开机'] ELSE [] END), ' ') AS lexical FROM q""",
)
def txt_expand_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id") % 3
    raw = F.concat(F.col("text"), F.when(n == 0, " 邮费").when(n == 1, " 退货 不开机").otherwise(""))
    items = read_input(spark, sf, "benchmark").select("item_id", raw.alias("raw"), F.concat("text", F.lit(" now")).alias("canonical"))
    return items.select("item_id", qn.expand_synonyms("raw", "canonical").alias("lexical"))


@query(
    "txt_identifier_signature",
    """SELECT doc_id, CAST(len(s) AS BIGINT) AS n_identifiers, sha256(array_to_string(list_sort(s), '|')) AS signature_sha
       FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]*')) AS s FROM documents)""",
)
def txt_identifier_signature(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents_spread(spark, sf).select("doc_id", qn.identifier_signature("text").alias("s"))
    return docs.select(
        "doc_id", F.size("s").cast("bigint").alias("n_identifiers"),
        F.sha2(F.array_join(F.array_sort("s"), "|"), 256).alias("signature_sha"),
    )


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages turned into questions with quantities, units and negations."""
    n = F.col("id") % 5
    tail = (
        F.when(n == 0, "，SE2 买了3件，不能退吗？").when(n == 1, "，用了几个月，第三和四款，但没有5串").when(n == 2, "，-12.5％ 折扣")
        .when(n == 3, "。一起买十台还是二十，¥99").otherwise("，可以吗？")
    )
    return ad.messages(spark, sf).filter("role = 'user'").select("id", F.concat("content", tail).alias("raw"))


@query("txt_quantity_signature")
def txt_quantity_signature(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", F.array_join(qn.quantity_signature("raw"), "|").alias("quantities"))


@query("txt_unknown_unit_clauses")
def txt_unknown_unit_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", F.array_join(qn.unknown_unit_clauses("raw"), "|").alias("clauses"))


@query(
    "txt_negative_clauses",
    ad.with_cte("messages")
    + """, q AS (SELECT id, content || CASE id % 5 WHEN 0 THEN '，SE2 买了3件，不能退吗？' WHEN 1 THEN '，用了几个月，第三和四款，但没有5串'
          WHEN 2 THEN '，-12.5％ 折扣' WHEN 3 THEN '。一起买十台还是二十，¥99' ELSE '，可以吗？' END AS raw FROM messages WHERE role = 'user')
       SELECT id, array_to_string(list_filter(string_split(regexp_replace(raw, '[,，;；。！？!?]+|但是|然而|但', chr(1), 'g'), chr(1)),
         lambda c: regexp_matches(c, '不|无|未|没|非([^常]|$)|(^|[^分])别|(^|[^是能])否')), '|') AS clauses FROM q""",
)
def txt_negative_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", F.array_join(qn.negative_clauses("raw"), "|").alias("clauses"))


@query("txt_accept_rewrite")
def txt_accept_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor(F.col("id") / 2) % 4
    candidate = (
        F.when(n == 0, F.concat(F.col("raw"), F.lit(" "))).when(n == 1, F.regexp_replace("raw", "3件|几个月|不能", "X"))
        .when(n == 2, F.regexp_replace("raw", "可以", "能够"))
    )
    rows = _questions(spark, sf).withColumn("candidate", candidate)
    return rows.select("id", *[c.alias(name) for name, c in qn.accept_rewrite("raw", "candidate").items()])


@query(
    "txt_humanize_status",
    """SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'O' THEN '待处理' WHEN 'F' THEN '已签收' ELSE 'P' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '在保' END AS warranty_status, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS n_fields FROM orders""",
)
def txt_humanize_status(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "delivered").otherwise(F.col("o_orderstatus"))
    tool = F.when(F.col("o_orderkey") % 3 == 0, "query_order").otherwise("external_lookup")
    fields = F.create_map(
        F.lit("order_id"), F.col("o_orderkey").cast("string"), F.lit("status"), code,
        F.lit("internal_note"), F.col("o_orderpriority"), F.lit("warranty_status"), F.lit("in_warranty"),
    )
    orders = read_input(spark, sf, "orders").select("o_orderkey", tx.humanize_status(fields, tool).alias("shown"))
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("shown")["status"].alias("status"),
        F.try_element_at("shown", F.lit("warranty_status")).alias("warranty_status"), F.size("shown").alias("n_fields"),
    )


@query(
    "txt_normalize_url",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
          regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, lower(scheme) || '://' || CASE page_id % 3 WHEN 2 THEN lower(host) || ':8443' ELSE lower(host) END
          || regexp_replace(regexp_replace(path, '/+$', ''), '/v1$', '') || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/x' END AS endpoint FROM u""",
)
def txt_normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    port = (
        F.when(n % 3 == 0, F.when(F.col("url").startswith("https"), ":443").otherwise(":80")).when(n % 3 == 1, "").otherwise(":8443")
    )
    parts = r"^([A-Za-z]+://)([^/?#]*)([^?#]*)(.*)$"
    path = F.regexp_replace(F.regexp_extract("url", parts, 3), "/+$", "")
    url = F.concat(
        F.upper(F.regexp_extract("url", parts, 1)), F.upper(F.regexp_extract("url", parts, 2)), port, path,
        F.when(n % 2 == 0, "/v1/").otherwise("/x/"), F.regexp_extract("url", parts, 4),
    )
    pages = read_input(spark, sf, "pages").select("page_id", url.alias("raw"))
    return pages.select("page_id", tx.normalize_url("raw").alias("endpoint"))
