"""Registered queries: retrieval legs, filters, fusion, rerank and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import postings as po
from supportlake.operators import pq
from supportlake.operators import retrieval as rt
from supportlake.plans import adapters as ad
from supportlake.plans.registry import query
from supportlake.session import materialize, path_exists
from supportlake.sources.tables import read_input


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_input(spark, sf, "embeddings").filter("vec_id % 10 = 0")
    return emb.select(F.col("vec_id").alias("query_id"), "embedding", "label")


def corpus_vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_input(spark, sf, "embeddings").filter("vec_id % 10 <> 0")
    return emb.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


DENSE = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 10 = 0),
c AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 10 <> 0),
dense_all AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q.e, c.e), 9) AS score, q.label = c.label AS relevant,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, c.e), 9) DESC, chunk_id) AS rank FROM q, c),
dense AS (SELECT * FROM dense_all WHERE rank <= 50)"""


@query("ret_dense_topk", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def ret_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6))


_PQ_INDEXES: dict[tuple[str, str], pq.PQIndex] = {}


def _stored_codes(spark: SparkSession, sf: str) -> pq.PQIndex:
    """The index of compact codes of the corpus, built once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PQ_INDEXES or not path_exists(spark, _PQ_INDEXES[key].codes_path):
        _PQ_INDEXES[key] = pq.build_pq(corpus_vectors(spark, sf))
    return _PQ_INDEXES[key]


@query("ret_dense_topk_ann")
def ret_dense_topk_ann(spark: SparkSession, sf: str) -> DataFrame:
    return pq.pq_search(query_vectors(spark, sf), _stored_codes(spark, sf), 10)


@query(
    "ret_ann_recall",
    f"""WITH {DENSE} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS finds_nine_of_ten, true AS reads_a_fifth_at_most
        FROM dense WHERE rank <= 10""",
)
def ret_ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate search measured against the exact one: queries, true neighbours, whether 0.9 of them are found, and whether a query
    has at most a fifth of the full vectors re-scored. ``recall`` and ``rescored`` of the index are in the README."""
    index = _stored_codes(spark, sf)
    exact = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 10).select("query_id", "chunk_id")
    near = pq.pq_search(query_vectors(spark, sf), index, 10).select("query_id", "chunk_id", F.lit(1).alias("found"))
    joined = exact.join(near, ["query_id", "chunk_id"], "left")
    return joined.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"),
        (F.count("found") >= 0.9 * F.count("*")).alias("finds_nine_of_ten"), F.lit(5 * index.n_rescored <= index.n_rows).alias("reads_a_fifth_at_most"),
    )


@query("ret_dense_topk_cells")
def ret_dense_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Search of probed cells by full vectors, without codes."""
    return rt.dense_topk_ann(query_vectors(spark, sf), corpus_vectors(spark, sf), 10)


@query("ret_dense_topk_all_cells", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def ret_dense_topk_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cell search with all cells probed, which must be the exact result."""
    hits = rt.dense_topk_ann(query_vectors(spark, sf), corpus_vectors(spark, sf), 10, n_lists=8, n_probe=8)
    return hits.withColumn("score", F.round("score", 6))


# --- lexical ---------------------------------------------------------------

_TOKENS = """docs_tok AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens FROM documents)"""


@query(
    "ret_tokenize",
    f"WITH {_TOKENS} SELECT chunk_id, CAST(len(tokens) AS BIGINT) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS tokens_sha FROM docs_tok",
)
def ret_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return index.select("chunk_id", F.col("doc_len").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents_spread(spark, sf)
    return rt.lexical_index(docs.select(F.col("doc_id").alias("chunk_id"), "text"))


_POSTING_INDEXES: dict[tuple[str, str], po.Postings] = {}


def _stored_postings(spark: SparkSession, sf: str) -> po.Postings:
    """The inverted index of the documents, built once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _POSTING_INDEXES or not path_exists(spark, _POSTING_INDEXES[key].path):
        docs = ad.documents_spread(spark, sf)
        _POSTING_INDEXES[key] = po.build_postings(docs.select(F.col("doc_id").alias("chunk_id"), "text"))
    return _POSTING_INDEXES[key]


_POSTINGS = f"""{_TOKENS},
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM docs_tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM docs_tok),
lens AS (SELECT chunk_id, len(tokens) AS doc_len FROM docs_tok)"""


@query("ret_bm25_postings", f"WITH {_POSTINGS} SELECT term, chunk_id, tf FROM post")
def ret_bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_postings(_index(spark, sf))


@query("ret_bm25_terms", f"WITH {_POSTINGS} SELECT term, df FROM df")
def ret_bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_terms(_index(spark, sf))


@query(
    "ret_posting_blocks",
    f"""WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf) AS occurrences, max(tf) AS max_tf, min(doc_len) AS min_len,
        sum(tf * (chunk_id + 1) * doc_len) AS weighted FROM post JOIN lens USING (chunk_id) GROUP BY term""",
)
def ret_posting_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The stored blocks of every term, added up: what they hold and the bounds they are skipped by."""
    blocks = _stored_postings(spark, sf).blocks(spark).where("term is not null")
    added = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), f)
    whole = added(F.zip_with("ids", F.zip_with("tfs", "lens", lambda x, y: x * y), lambda x, y: (x + 1) * y), lambda a, x: a + x)
    return blocks.groupBy("term").agg(
        F.sum("n").alias("df"), F.sum(added("tfs", lambda a, x: a + x)).alias("occurrences"), F.max("max_tf").alias("max_tf"),
        F.min("min_len").alias("min_len"), F.sum(whole).alias("weighted"),
    )


@query("ret_bm25_stats", f"WITH {_POSTINGS} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats")
def ret_bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_stats(_index(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))


_BM25 = f"""{_POSTINGS},
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark)),
sc AS (SELECT query_id, p.chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM qt JOIN post p USING (term) JOIN df USING (term) JOIN lens l ON l.chunk_id = p.chunk_id, stats GROUP BY 1, 2),
bm25_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return read_input(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("ret_bm25_topk", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25_all WHERE rank <= 10")
def ret_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = po.bm25_search(_benchmark(spark, sf), _stored_postings(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6))


# --- filters ---------------------------------------------------------------


def _chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    return ad.chunk_drafts(spark, sf).select(
        n.alias("chunk_id"), "category", "content_type", (n % 9 != 0).alias("is_active"), "source_key",
    )


_ROWS = """WITH c AS (SELECT doc_id AS chunk_id, lang || ' / ' || source AS category, doc_id % 9 <> 0 AS is_active,
  CASE CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 'product_faq' WHEN 1 THEN 'after_sales' ELSE 'policy' END AS content_type FROM documents)"""


@query("ret_prefilter", _ROWS + " SELECT chunk_id, category FROM c WHERE is_active AND (category LIKE 'en / src1%' OR category LIKE 'd%') AND chunk_id % 2 = 0")
def ret_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunk_rows(spark, sf)
    out = rt.prefilter(rows, prefixes=("en / src1", "d"), ids=rows.filter("chunk_id % 2 = 0"))
    return out.select("chunk_id", "category")


@query("ret_typed_scope", _ROWS + " SELECT chunk_id, category, content_type FROM c WHERE is_active AND content_type IN ('policy', 'after_sales') AND (category LIKE 'en / %' OR category = 'de / src2')")
def ret_typed_scope(spark: SparkSession, sf: str) -> DataFrame:
    out = rt.typed_scope(_chunk_rows(spark, sf), rt.POLICY_TYPES, ("en", "de / src2"))
    return out.select("chunk_id", "category", "content_type")


@query(
    "ret_policy_scope",
    """WITH i AS (SELECT conv_id * 1000000000 + turn AS id, CASE (conv_id + turn) % 3 WHEN 0 THEN '退款退货' WHEN 1 THEN '售后' ELSE '物流' END AS intent FROM conversations)
       SELECT id, intent, unnest(CASE intent WHEN '退款退货' THEN ['退换货与退款'] WHEN '售后' THEN ['退换货与退款', '支付与售后'] ELSE [NULL] END) AS category_prefix,
         CASE WHEN intent <> '物流' THEN 'policy,after_sales' END AS content_types,
         CASE WHEN intent = '物流' THEN 'policy_retrieval_needs_refund_or_after_sale' END AS error FROM i""",
)
def ret_policy_scope(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_input(spark, sf, "conversations")
    n = (F.col("conv_id") + F.col("turn")) % 3
    intents = raw.select(
        (F.col("conv_id") * ad.TURNS + F.col("turn")).alias("id"),
        F.when(n == 0, "退款退货").when(n == 1, "售后").otherwise("物流").alias("intent"),
    )
    return rt.policy_scope(intents).withColumn("content_types", F.array_join("content_types", ","))


_POLICY_HITS = """WITH h AS (SELECT item_id AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n,
        CASE doc_id % 4 WHEN 0 THEN '退换货与退款' WHEN 1 THEN '退换货与退款 / ' || source WHEN 2 THEN '支付与售后 / ' || source ELSE '支付与售后服务' END AS category,
        CASE CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 'product_faq' WHEN 1 THEN 'after_sales' ELSE 'policy' END AS content_type
      FROM documents JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark))
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS n, category, content_type FROM h
    WHERE content_type <> 'product_faq' AND ((query_id % 3 = 0 AND chunk_id % 4 < 2) OR (query_id % 3 = 1 AND chunk_id % 4 < 3))"""


@query("ret_policy_hits", _POLICY_HITS)
@query("ret_policy_hits_all_items", _POLICY_HITS)
def ret_policy_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, dealt over all benchmark items, as hits with the scope their item's intent forces."""
    return _policy_hits(spark, sf, read_input(spark, sf, "benchmark").count())


def _policy_hits(spark: SparkSession, sf: str, n_items: int) -> DataFrame:
    n, source = F.col("doc_id") % 4, F.col("source")
    items = read_input(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    category = (
        F.when(n == 0, "退换货与退款").when(n == 1, F.concat(F.lit("退换货与退款 / "), source))
        .when(n == 2, F.concat(F.lit("支付与售后 / "), source)).otherwise("支付与售后服务")
    )
    docs = ad.documents(spark, sf).select(
        (F.col("doc_id") % n_items).alias("query_id"), F.col("doc_id").alias("chunk_id"), category.alias("category"),
        ad.content_type_of(source).alias("content_type"), F.col("doc_id").alias("n"),
    ).join(items, "query_id", "left_semi")
    kind = F.col("query_id") % 3
    intents = items.withColumn("intent", F.when(kind == 0, "退款退货").when(kind == 1, "售后").otherwise("物流"))
    return rt.policy_hits(docs, rt.policy_scope(intents)).select("query_id", "chunk_id", "n", "category", "content_type")


# --- fusion and evidence ---------------------------------------------------
# The lexical leg of the fused queries ranks all documents, with or without a vector.

_TEXT_LEG = """t AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens FROM documents),
tp AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM t) GROUP BY 1, 2),
tdf AS (SELECT term, count(*) AS df FROM tp GROUP BY 1), ts AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM t), tl AS (SELECT chunk_id, len(tokens) AS doc_len FROM t),
tq AS (SELECT DISTINCT query_id, term FROM (SELECT e.vec_id AS query_id, unnest(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]+')) AS term
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 10 = 0)),
lex_all AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, p.chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM tq JOIN tp p USING (term) JOIN tdf USING (term) JOIN tl l ON l.chunk_id = p.chunk_id, ts GROUP BY 1, 2)),
fused_all AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (
  SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank FROM lex_all WHERE rank <= 50) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused_all) WHERE rank <= 100)"""


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table whose texts are all documents and whose vectors are the corpus vectors, where there is one."""
    # The text is stored once; it is the answer and what is searched.
    return ad.stored(spark, sf, "searched-chunks", lambda: _searched(spark, sf)).withColumn("embedding_text", F.col("answer"))


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    drafts = ad.chunk_drafts(spark, sf)
    vectors = corpus_vectors(spark, sf).withColumnRenamed("chunk_id", "doc_id")
    n = F.col("doc_id")
    # Vectors are hashed, so that the texts are moved but not sorted.
    return drafts.join(vectors.hint("shuffle_hash"), "doc_id", "left").select(
        n.alias("id"), "source_key", "category", "questions", "answer", "chapter_path",
        "content_type", F.lit(True).alias("is_active"), "embedding", "label", F.when(F.col("embedding").isNotNull(), "vectorized").otherwise("pending").alias("vector_status"),
        F.concat(F.lit("h"), n.cast("string")).alias("content_hash"),
    )


def _sync(chunks: DataFrame) -> DataFrame:
    """Sync rows; every seventh chunk was edited since."""
    return chunks.select(
        F.col("id").alias("chunk_id"), F.when(F.col("id") % 7 == 3, "old").otherwise(F.col("content_hash")).alias("content_hash")
    )


def _text_queries(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("text").alias("lexical"))
    return query_vectors(spark, sf).join(docs, "query_id").select("query_id", "embedding", "lexical")


@query("ret_rrf_fuse", f"WITH {DENSE}, {_TEXT_LEG} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fused")
def ret_rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    queries, stored = _text_queries(spark, sf), _stored(spark, sf)
    searched = stored.select(F.col("id").alias("chunk_id"), "embedding", F.col("embedding_text").alias("text"))
    dense = rt.dense_topk(queries, searched)
    # Read for its terms, its sizes and the scores: texts are cut into words once.
    index = materialize(rt.lexical_index(searched), "lexical-index")
    lexical = rt.bm25_topk(queries.select("query_id", F.col("lexical").alias("text")), index)
    return rt.rrf_fuse([dense, lexical]).withColumn("score", F.round("score", 9))


@query(
    "ret_retrieve_hybrid",
    f"""WITH {DENSE}, {_TEXT_LEG} SELECT query_id, chunk_id, n, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fused WHERE chunk_id % 7 <> 3) WHERE n <= 10""",
)
def ret_retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored(spark, sf)
    _, final = rt.retrieve(_text_queries(spark, sf), stored, _sync(stored), "hybrid")
    return final.select("query_id", "chunk_id", "n", F.round("score", 9).alias("score"))


def _scores(candidates: DataFrame) -> DataFrame:
    """Stand-in rerank scores per candidate position; every 50th query's are broken."""
    relevance = F.round(((F.col("chunk_id") * 37) % 101) / F.lit(101.0), 6)
    top = candidates.filter(F.col("n") <= 10)
    bad = (F.col("query_id") % 50 == 40) & (F.col("n") == 1)
    return top.select("query_id", F.when(bad, F.lit(999)).otherwise(F.col("n") - 1).cast("bigint").alias("index"), relevance.alias("relevance"))


_RERANK = """cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, count(*) OVER (PARTITION BY query_id) AS total FROM dense WHERE rank <= 10),
reranked AS (SELECT query_id, chunk_id, round((chunk_id * 37 % 101) / 101.0, 6) AS score, CAST(NULL AS VARCHAR) AS error,
  row_number() OVER (PARTITION BY query_id ORDER BY round((chunk_id * 37 % 101) / 101.0, 6) DESC, n) AS n FROM cand WHERE query_id % 50 <> 40
  UNION ALL SELECT DISTINCT query_id, NULL, NULL, 'invalid_rerank_result', NULL FROM cand WHERE query_id % 50 = 40)"""


@query("ret_rerank", f"WITH {DENSE}, {_RERANK} SELECT query_id, chunk_id, n, score, error FROM reranked")
def ret_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 10).withColumnRenamed("rank", "n")
    candidates = materialize(found, "candidates")
    return rt.rerank(candidates, _scores(candidates)).select("query_id", "chunk_id", "n", "score", "error")


_STRATEGIES = """legs AS (
  SELECT 'dense' AS strategy, query_id, chunk_id, rank, score FROM dense UNION ALL
  SELECT 'bm25', query_id, chunk_id, rank, score FROM lex_all WHERE rank <= 50 UNION ALL
  SELECT 'hybrid', query_id, chunk_id, rank, score FROM fused),
cand AS (SELECT strategy, query_id, chunk_id, score, row_number() OVER (PARTITION BY strategy, query_id ORDER BY rank) AS n FROM legs WHERE chunk_id % 7 <> 3),
top AS (SELECT query_id, chunk_id, n, round((chunk_id * 37 % 101) / 101.0, 6) AS given FROM cand WHERE strategy = 'hybrid' AND n <= 10)
SELECT strategy, query_id, chunk_id, n, round(score, 6) AS score FROM cand WHERE n <= 10 UNION ALL
SELECT 'hybrid_rerank', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY given DESC, n), given FROM top WHERE query_id % 50 <> 40 UNION ALL
SELECT DISTINCT 'hybrid_rerank', query_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM top WHERE query_id % 50 = 40"""


@query("ret_retrieve_strategies", f"WITH {DENSE}, {_TEXT_LEG}, {_STRATEGIES}")
def ret_retrieve_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """All four strategies over the whole query table."""
    stored = _stored(spark, sf)
    sync, queries, out = _sync(stored), _text_queries(spark, sf), None
    legs = rt.search_legs(queries, stored)
    for strategy in rt.STRATEGIES:
        base = "hybrid" if strategy == "hybrid_rerank" else strategy
        candidates, final = rt.retrieve(queries, stored, sync, base, legs=legs)
        if strategy == "hybrid_rerank":
            # Read by the scores, by their checks and by the order: written once.
            candidates = materialize(candidates.select("query_id", "chunk_id", "n", "score"), "candidates")
            final = rt.rerank(candidates, _scores(candidates))
        part = final.select(F.lit(strategy).alias("strategy"), "query_id", "chunk_id", "n", F.round("score", 6).alias("score"))
        part = materialize(part, "strategy")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "ret_hydrate",
    f"""WITH {DENSE} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, 'About ' || source AS question, source AS category
        FROM dense JOIN documents ON doc_id = chunk_id WHERE rank <= 50 AND chunk_id % 7 <> 3
        AND CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 > 0""",
)
def ret_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored(spark, sf)
    hits = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 50).withColumn(
        "content_hash", F.concat(F.lit("h"), F.col("chunk_id").cast("string"))
    )
    out = rt.hydrate(hits, stored, _sync(stored), rt.POLICY_TYPES)
    return out.select("query_id", "chunk_id", "n", "question", F.element_at("section_path", 2).alias("category"))


@query(
    "ret_faq_retrieve",
    f"""WITH {DENSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score, 'About ' || source AS question FROM dense JOIN documents ON doc_id = chunk_id
        WHERE rank <= 5 AND score >= 0.3""",
)
def ret_faq_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 5)
    out = rt.faq_retrieve(hits, _stored(spark, sf), 5, 0.3)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "question")


@query(
    "ret_merge_multi_query",
    f"""WITH {DENSE}, h AS (SELECT query_id // 50 AS question_id, query_id * 100 + rank AS arrival, CASE WHEN chunk_id % 4 = 1 THEN NULL ELSE chunk_id END AS chunk_id,
          CASE WHEN chunk_id % 8 = 1 THEN NULL ELSE 's' || (chunk_id % 40) END AS source_key, CASE WHEN chunk_id % 13 = 0 THEN NULL ELSE round(score, 1) END AS score FROM dense WHERE rank <= 20),
        k AS (SELECT *, CASE WHEN chunk_id IS NOT NULL THEN 'c' || chunk_id WHEN source_key IS NOT NULL THEN 's' || source_key ELSE 'u' || arrival END AS key FROM h),
        b AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY coalesce(score, -9) DESC, arrival) AS r FROM k)
        SELECT question_id, arrival, chunk_id, source_key, score, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(score, -9) DESC, arrival) AS n FROM b WHERE r = 1""",
)
def ret_merge_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 20)
    c = F.col("chunk_id")
    variants = hits.select(
        F.floor(F.col("query_id") / 50).alias("question_id"), (F.col("query_id") * 100 + F.col("rank")).alias("arrival"),
        F.when(c % 4 != 1, c).alias("chunk_id"), F.when(c % 8 != 1, F.concat(F.lit("s"), (c % 40).cast("string"))).alias("source_key"),
        F.when(c % 13 != 0, F.round("score", 1)).alias("score"),
    )
    return rt.merge_multi_query(variants)


@query(
    "ret_evidence_gate",
    f"""WITH {DENSE}, e AS (SELECT query_id, CASE WHEN chunk_id % 5 = 0 THEN ' ' ELSE 'a' END AS answer, CASE WHEN chunk_id % 7 = 0 THEN NULL ELSE round(score, 6) END AS score FROM dense WHERE rank <= 3),
        g AS (SELECT query_id, max(score) AS gate_score, count(*) AS usable FROM e WHERE answer = 'a' AND score IS NOT NULL GROUP BY 1)
        SELECT q.query_id, gate_score, coalesce(usable, 0) AS usable, coalesce(gate_score >= 0.4, false) AS gate_passed,
          CASE WHEN NOT coalesce(gate_score >= 0.4, false) THEN 'retrieval_low_conf' END AS stop_reason FROM q LEFT JOIN g USING (query_id)""",
)
def ret_evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    queries = query_vectors(spark, sf)
    hits = rt.dense_topk(queries, corpus_vectors(spark, sf), 3)
    c = F.col("chunk_id")
    evidence = hits.select(
        "query_id", F.when(c % 5 == 0, " ").otherwise("a").alias("answer"),
        F.when(c % 7 == 0, F.lit(float("nan"))).otherwise(F.round("score", 6)).alias("score"),
    )
    out = rt.evidence_gate(evidence, queries.select("query_id"), 0.4, "dense")
    return out.select("query_id", "gate_score", "usable", "gate_passed", "stop_reason")


@query("ret_fit_evidence")
def ret_fit_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.documents(spark, sf)
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    fitted = rt.fit_evidence(lines, lambda x: tx.estimate_tokens(x) + tx.MESSAGE_OVERHEAD, 5, 150)
    return docs.select("doc_id", F.size(lines).alias("n_lines"), fitted.alias("kept")).select(
        "doc_id", "n_lines", F.size("kept").alias("n_kept"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha")
    )


@query(
    "ret_arrange_evidence",
    f"""WITH {DENSE} SELECT query_id, rank AS n, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 1000 - rank END) AS place FROM dense WHERE rank <= 9""",
)
def ret_arrange_evidence(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 9).withColumnRenamed("rank", "n")
    return rt.arrange_evidence(hits).select("query_id", "n", "place")


@query(
    "ret_parse_expansions",
    ad.with_cte("messages")
    + """, u AS (SELECT id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS q FROM messages WHERE role = 'user')
      SELECT id, CASE id % 7 WHEN 0 THEN q || '|alpha  one|beta' WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q || '|a|b|c' WHEN 4 THEN q WHEN 5 THEN q ELSE q || '|x' END AS queries FROM u""",
)
def ret_parse_expansions(spark: SparkSession, sf: str) -> DataFrame:
    users = ad.messages(spark, sf).filter("role = 'user'").select("id", tx.strip("content").alias("q"))
    n = F.col("id") % 7
    raw = (
        F.when(n == 0, F.to_json(F.struct(F.array(F.lit(" alpha  one"), F.lit("Alpha one "), F.lit("beta"), F.lit("")).alias("queries"))))
        .when(n == 1, F.lit('{"queries":["a",2]}'))
        .when(n == 2, F.lit('{"queries":["a"],"more":1}'))
        .when(n == 3, F.lit('{"queries":["a","b","c","d"]}'))
        .when(n == 4, F.lit("not json"))
        .when(n == 5, F.lit('{"queries":["a"],"queries":["b"]}'))
        .otherwise(F.to_json(F.struct(F.array(F.col("q"), F.lit("x"), F.repeat(F.lit("y"), 241)).alias("queries"))))
    )
    return users.select("id", F.array_join(rt.parse_expansions(raw, F.col("q")), "|").alias("queries"))


@query("ret_adapt_evidence")
def ret_adapt_evidence(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored(spark, sf)
    hits = materialize(rt.dense_topk(query_vectors(spark, sf), corpus_vectors(spark, sf), 5), "hits")
    hashed = hits.withColumn("content_hash", F.concat(F.lit("h"), F.col("chunk_id").cast("string")))
    evidence = rt.hydrate(hashed, stored, _sync(stored))
    faq = rt.faq_retrieve(hits, stored, 5, 0.2).withColumnRenamed("rank", "n")
    traced = rt.adapt_evidence(evidence, "traced").withColumn("shape", F.lit("traced"))
    plain = rt.adapt_evidence(evidence, "plain", prefixes=("en",), content_types=rt.POLICY_TYPES).withColumn("shape", F.lit("plain"))
    legacy = rt.adapt_evidence(faq, "faq", prefixes=("fr", "de")).withColumn("shape", F.lit("faq"))
    return traced.unionByName(plain).unionByName(legacy)
