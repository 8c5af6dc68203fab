"""Registered queries: chunk table maintenance and index sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import merge as mg
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.plans.text_queries import FINGERPRINT_SQL
from supportlake.session import bucketed
from supportlake.sources.tables import read_input


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chunk table: documents as they were before the import."""
    return ad.stored_in_buckets(spark, sf, "chunks", lambda: _old_chunks(spark, sf))


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """The import's drafts, one per key, as the import stores them."""
    return ad.stored_in_buckets(spark, sf, "latest", lambda: mg.latest_drafts(_drafts(spark, sf)))


def _old_chunks(spark: SparkSession, sf: str) -> DataFrame:
    drafts = ad.chunk_drafts(spark, sf).filter("doc_id % 5 <> 4")
    n = F.col("doc_id")
    text = F.when(n % 5 == 1, F.concat("answer", F.lit("!"))).when(n % 5 == 2, F.concat("answer", F.lit(" old"))).otherwise(F.col("answer"))
    old = drafts.withColumn("answer", text).select("doc_id", "source_key", "category", "questions", "answer", "chapter_path", "content_type", "is_critical")

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            (n + 1).alias("id"), "source_key", "category", "questions", "answer",
            tx.embedding_text("category", "questions", "answer").alias("embedding_text"), "chapter_path", "content_type",
            "is_critical", (n % 7 != 0).alias("is_active"),
            F.lit(None).cast("bigint").alias("previous_chunk_id"), F.lit(None).cast("bigint").alias("next_chunk_id"),
            F.when(n % 3 != 0, n + 1).alias("vector_id"), F.when(n % 3 != 0, "vectorized").otherwise("pending").alias("vector_status"),
            tx.fingerprint("category", "questions", "answer").alias("content_hash"),
        )

    return bucketed(old, "source_key", "chunks", finish)


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming drafts: all documents except every sixth, neighbours by document number."""
    drafts = ad.chunk_drafts(spark, sf).filter("doc_id % 6 <> 5")
    docs = ad.documents(spark, sf).select(
        F.col("doc_id").alias("n"), F.concat(F.lit("doc:"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(":0")).alias("k")
    )
    before = docs.select((F.col("n") + 1).alias("doc_id"), F.col("k").alias("previous_source_key"))
    after = docs.select((F.col("n") - 1).alias("doc_id"), F.col("k").alias("next_source_key"))
    bare = drafts.drop("previous_source_key", "next_source_key", "draft_order")
    # Hashed by their keys, so that the texts are not sorted; the order is named last, so that rows that lie by number lie by it.
    joined = bare.join(before.hint("shuffle_hash"), "doc_id", "left").join(after.hint("shuffle_hash"), "doc_id", "left")
    return joined.withColumn("draft_order", F.col("doc_id")).drop("doc_id", "lang")


def _emb(text: str) -> str:
    return f"lang || ' / ' || source || chr(10) || 'About ' || source || chr(10) || regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


_OLD_TEXT = "(text || CASE doc_id % 5 WHEN 1 THEN '!' WHEN 2 THEN ' old' ELSE '' END)"
_STATE = f"""WITH docs AS (SELECT *, 'doc:' || source || '/' || doc_id || ':0' AS source_key FROM documents),
stored AS (SELECT doc_id, source_key, doc_id + 1 AS id, doc_id % 7 <> 0 AS is_active, CASE WHEN doc_id % 3 <> 0 THEN doc_id + 1 END AS vector_id,
  CASE WHEN doc_id % 3 <> 0 THEN 'vectorized' ELSE 'pending' END AS vector_status, {_emb(_OLD_TEXT)} AS emb,
  {FINGERPRINT_SQL.format(_emb(_OLD_TEXT))} AS hash, source, lang FROM docs WHERE doc_id % 5 <> 4),
drafts AS (SELECT doc_id, source_key, {_emb("text")} AS emb, {FINGERPRINT_SQL.format(_emb("text"))} AS hash FROM docs WHERE doc_id % 6 <> 5),
added AS (SELECT source_key, row_number() OVER (ORDER BY doc_id) + (SELECT max(id) FROM stored) AS id FROM drafts d WHERE source_key NOT IN (SELECT source_key FROM stored)),
upserted AS (SELECT coalesce(s.source_key, d.source_key) AS source_key, coalesce(s.id, a.id) AS id, coalesce(d.hash, s.hash) AS content_hash,
  CASE WHEN d.emb IS NOT NULL AND (s.emb IS NULL OR s.emb <> d.emb OR NOT s.is_active) THEN 'pending' ELSE s.vector_status END AS vector_status,
  CASE WHEN d.emb IS NOT NULL AND (s.emb IS NULL OR s.emb <> d.emb OR NOT s.is_active) THEN NULL ELSE s.vector_id END AS vector_id,
  CASE WHEN d.emb IS NOT NULL THEN true ELSE s.is_active END AS is_active, d.doc_id AS draft
  FROM stored s FULL JOIN drafts d USING (source_key) LEFT JOIN added a ON a.source_key = d.source_key)
"""


@query("src_faq_to_drafts", "SELECT 'faq:' || p_partkey AS source_key, p_brand AS category, p_name AS question, p_type AS answer, p_brand AS path, 'product_faq' AS content_type, false AS is_critical FROM part")
def src_faq_to_drafts(spark: SparkSession, sf: str) -> DataFrame:
    drafts = mg.faq_to_drafts(_faq(spark, sf))
    return drafts.select(
        "source_key", "category", F.array_join("questions", "|").alias("question"), "answer",
        F.array_join("chapter_path", "|").alias("path"), "content_type", "is_critical",
    )


def _faq(spark: SparkSession, sf: str) -> DataFrame:
    part = read_input(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.col("p_brand").alias("category")
    )


@query("src_read_tables", """SELECT 'conversations' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels
    UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark""")
def src_read_tables(spark: SparkSession, sf: str) -> DataFrame:
    from functools import reduce

    from supportlake.sources.tables import INPUT_SCHEMAS, read_tables

    tables = read_tables(spark, sf, list(INPUT_SCHEMAS), INPUT_SCHEMAS)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query("mrg_upsert_drafts", _STATE + "SELECT source_key, id, content_hash, vector_status, vector_id, is_active FROM upserted")
def mrg_upsert_drafts(spark: SparkSession, sf: str) -> DataFrame:
    out = mg.upsert_drafts(_chunks(spark, sf), _latest(spark, sf), latest=True)
    return out.select("source_key", "id", "content_hash", "vector_status", "vector_id", "is_active")


@query(
    "mrg_resolve_neighbors",
    _STATE + """SELECT u.id, CASE WHEN u.draft IS NOT NULL THEN p.id END AS previous_chunk_id, CASE WHEN u.draft IS NOT NULL THEN n.id END AS next_chunk_id
      FROM upserted u LEFT JOIN docs pd ON pd.doc_id = u.draft - 1 LEFT JOIN upserted p ON p.source_key = pd.source_key
      LEFT JOIN docs nd ON nd.doc_id = u.draft + 1 LEFT JOIN upserted n ON n.source_key = nd.source_key""",
)
def mrg_resolve_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    drafts = _latest(spark, sf)
    merged = mg.upsert_drafts(_chunks(spark, sf), drafts, latest=True)
    return mg.resolve_neighbors(merged, drafts, latest=True).select("id", "previous_chunk_id", "next_chunk_id")


@query(
    "mrg_retire_missing_documents",
    _STATE + """, r AS (SELECT id, vector_id, is_active AND doc_id % 8 <> 1 AND doc_id % 6 <> 5 AS is_active FROM stored)
      SELECT id, is_active, NOT is_active AND vector_id IS NOT NULL AS stale FROM r""",
)
def mrg_retire_missing_documents(spark: SparkSession, sf: str) -> DataFrame:
    sources = ad.documents(spark, sf).filter("doc_id % 8 <> 1").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"))
    out = mg.retire_missing_documents(_chunks(spark, sf), sources, _drafts(spark, sf))
    return out.select("id", "is_active", "stale")


def _faq_chunks(spark: SparkSession, sf: str) -> DataFrame:
    drafts = mg.faq_to_drafts(_faq(spark, sf))
    n = F.col("draft_order")
    return drafts.select(
        n.alias("id"), "source_key", "content_type", (n % 5 != 0).alias("is_active"), F.when(n % 2 == 0, n).alias("vector_id")
    )


_FAQ = "WITH f AS (SELECT p_partkey AS id, p_partkey % 5 <> 0 AS was, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS vector_id FROM part)"


@query("mrg_retire_missing_faqs", _FAQ + " SELECT id, was AND id % 3 <> 0 AS is_active, id % 3 = 0 AND vector_id IS NOT NULL AS stale FROM f")
def mrg_retire_missing_faqs(spark: SparkSession, sf: str) -> DataFrame:
    keys = mg.faq_to_drafts(_faq(spark, sf).filter("id % 3 <> 0"))
    return mg.retire_missing_faqs(_faq_chunks(spark, sf), keys).select("id", "is_active", "stale")


@query("mrg_clear_vectors", _FAQ + " SELECT id, CASE WHEN NOT was AND id % 4 = 0 THEN NULL ELSE vector_id END AS vector_id FROM f")
def mrg_clear_vectors(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _faq_chunks(spark, sf)
    return mg.clear_vectors(chunks, chunks.filter("id % 4 = 0")).select("id", "vector_id")


@query("mrg_pending_chunks", _STATE + "SELECT id FROM stored WHERE is_active AND vector_status = 'pending' ORDER BY id LIMIT 32")
def mrg_pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return mg.pending_chunks(_chunks(spark, sf), 32).select("id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_input(spark, sf, "embeddings")
    n = F.col("vec_id")
    values = F.when(n % 11 == 3, F.slice("embedding", 1, 10)).when(n % 11 == 5, F.transform("embedding", lambda x: x * F.lit(float("nan")))).otherwise(F.col("embedding"))
    category = F.when(n % 11 == 7, F.repeat(F.lit("x"), 600)).otherwise(F.col("label").cast("string"))
    rows = emb.select(
        F.when(n % 11 == 9, n - 1).otherwise(n).alias("chunk_id"), n.alias("vector_id"), values.alias("embedding"),
        F.col("label").cast("string").alias("text"), category.alias("category"),
    )
    return rows


_VEC = """WITH v AS (SELECT CASE WHEN vec_id % 11 = 9 THEN vec_id - 1 ELSE vec_id END AS chunk_id, vec_id AS vector_id,
  CASE vec_id % 11 WHEN 3 THEN 'dimension' WHEN 5 THEN 'not_finite' WHEN 7 THEN 'category_bytes' END AS p FROM embeddings),
checked AS (SELECT chunk_id, vector_id, CASE WHEN count(*) OVER (PARTITION BY chunk_id) > 1 THEN 'duplicate_id' ELSE p END AS problem FROM v)
"""


@query("mrg_validate_vectors", _VEC + "SELECT vector_id, chunk_id, problem FROM checked")
def mrg_validate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return mg.validate_vectors(_vectors(spark, sf), 64).select("vector_id", "chunk_id", "problem")


@query(
    "mrg_mark_vectorized",
    _STATE.replace("WITH docs", _VEC.strip() + ", docs", 1)
    + """SELECT s.id, CASE WHEN c.chunk_id IS NULL THEN s.vector_id ELSE c.vector_id END AS vector_id,
      CASE WHEN c.chunk_id IS NULL THEN s.vector_status ELSE 'vectorized' END AS vector_status
      FROM stored s LEFT JOIN (SELECT * FROM checked WHERE problem IS NULL) c ON c.chunk_id = s.id""",
)
def mrg_mark_vectorized(spark: SparkSession, sf: str) -> DataFrame:
    good = mg.validate_vectors(_vectors(spark, sf), 64).filter("problem IS NULL")
    return mg.mark_vectorized(_chunks(spark, sf), good).select("id", "vector_id", "vector_status")


@query(
    "mrg_fetch_chunks",
    _STATE + """, req AS (SELECT item_id AS request_id, unnest([item_id * 3 + 2, item_id + 1, item_id * 3 + 2, item_id * 7 + 3]) AS id,
        unnest([0, 1, 2, 3]) AS position FROM benchmark)
      SELECT r.request_id, r.id, min(r.position) AS position FROM req r JOIN stored s ON s.id = r.id
      WHERE s.is_active AND s.vector_status = 'vectorized' GROUP BY 1, 2""",
)
def mrg_fetch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    requests = read_input(spark, sf, "benchmark").select(n.alias("request_id"), F.array(n * 3 + 2, n + 1, n * 3 + 2, n * 7 + 3).alias("ids"))
    return mg.fetch_chunks(_chunks(spark, sf), requests).select("request_id", "id", "position")


_SYNC = _STATE + """, sync AS (SELECT id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE hash END AS hash FROM stored WHERE doc_id % 3 <> 1),
plan AS (SELECT coalesce(a.id, y.chunk_id) AS chunk_id, CASE WHEN a.id IS NULL THEN 'delete' WHEN y.chunk_id IS NULL OR y.hash <> a.hash THEN 'upsert' ELSE 'keep' END AS action, a.hash AS content_hash
  FROM (SELECT id, hash FROM stored WHERE is_active) a FULL JOIN sync y ON y.chunk_id = a.id)
"""


def _sync(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, sf)
    number = F.col("id") - 1
    sync = chunks.filter(number % 3 != 1).select(
        F.col("id").alias("chunk_id"), F.when(number % 4 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash")
    )
    return chunks, sync


@query("mrg_sync_plan", _SYNC + "SELECT * FROM plan")
def mrg_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return mg.sync_plan(*_sync(spark, sf))


@query("mrg_sync_counts", _SYNC + "SELECT count(*) FILTER (WHERE action <> 'delete') AS active, count(*) FILTER (WHERE action = 'upsert') AS synchronized, count(*) FILTER (WHERE action = 'delete') AS deleted FROM plan")
def mrg_sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return mg.sync_counts(mg.sync_plan(*_sync(spark, sf)))


@query(
    "mrg_commit_sync",
    _SYNC + """, written AS (SELECT p.chunk_id, p.content_hash FROM plan p JOIN stored s ON s.id = p.chunk_id WHERE p.action = 'upsert' AND s.is_active AND s.doc_id % 10 <> 0)
      SELECT chunk_id, hash AS content_hash FROM sync WHERE chunk_id NOT IN (SELECT chunk_id FROM written) AND chunk_id NOT IN (SELECT chunk_id FROM plan WHERE action = 'delete')
      UNION ALL SELECT * FROM written""",
)
def mrg_commit_sync(spark: SparkSession, sf: str) -> DataFrame:
    chunks, sync = _sync(spark, sf)
    edited = chunks.withColumn("content_hash", F.when((F.col("id") - 1) % 10 == 0, "edited").otherwise(F.col("content_hash")))
    return mg.commit_sync(sync, mg.sync_plan(chunks, sync), edited)


@query(
    "mrg_pair_vectors_with_inputs",
    """WITH i AS (SELECT vec_id // 20 AS batch_id, vec_id % 20 AS index, vec_id FROM embeddings),
       b AS (SELECT batch_id, bool_and(NOT (vec_id % 97 = 5)) AS complete FROM i GROUP BY 1)
       SELECT batch_id, index, vec_id AS chunk_id, complete, CASE WHEN complete THEN 64 END AS width FROM i JOIN b USING (batch_id)""",
)
def mrg_pair_vectors_with_inputs(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_input(spark, sf, "embeddings")
    batch = F.floor(F.col("vec_id") / 20).alias("batch_id")
    inputs = emb.select(batch, (F.col("vec_id") % 20).alias("index"), F.col("vec_id").alias("chunk_id"))
    response = emb.filter("vec_id % 97 <> 5").select(batch, (F.col("vec_id") % 20).alias("index"), "embedding")
    out = mg.pair_vectors_with_inputs(inputs, response)
    return out.select("batch_id", "index", "chunk_id", "complete", F.when(F.col("complete"), F.size("embedding")).alias("width"))


@query(
    "mrg_sync_summary",
    _STATE.replace("WITH docs", _VEC.strip() + ", docs", 1)
    + """SELECT count(*) AS pending_before, count(c.chunk_id) AS vectorized, count(*) - count(c.chunk_id) AS failed FROM stored s
      LEFT JOIN (SELECT chunk_id FROM checked WHERE problem IS NULL) c ON c.chunk_id = s.id WHERE s.is_active AND s.vector_status = 'pending'""",
)
def mrg_sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    good = mg.validate_vectors(_vectors(spark, sf), 64).filter("problem IS NULL")
    return mg.sync_summary(_chunks(spark, sf), good)


@query("mrg_registered_sources", _STATE + "SELECT DISTINCT source || '/' || doc_id AS source FROM stored WHERE is_active")
def mrg_registered_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mg.registered_sources(_chunks(spark, sf))
