"""Batch retrieval: dense and lexical legs, filters, fusion, rerank, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.functions import jsonval as js
from supportlake.functions import text as tx
from supportlake.functions.lexical import tokenize
from supportlake.operators.products import bm25_best, pack_queries
from supportlake.operators.scan import running
from supportlake.operators.topk import BROADCAST_BYTES, _Best, rank_hits, topk
from supportlake.session import materialize, run_dir

# Candidate limits, fusion constant, and the policy scopes.
LEG_LIMIT = 50
HYBRID_LIMIT = 100
FINAL_LIMIT = 10
FAQ_LIMIT = 5
RRF_K = 60
STRATEGIES = ("dense", "bm25", "hybrid", "hybrid_rerank")
POLICY_PREFIXES = {"退款退货": ("退换货与退款",), "售后": ("退换货与退款", "支付与售后")}
POLICY_TYPES = ("policy", "after_sales")
#: Share of the exact neighbours that a search by cells must find, queries it is measured on, and most cells.
RECALL = 0.9
RECALL_QUERIES = 512
MAX_CELLS = 256
#: A cell of fewer rows is one file.
CELL_FILE_ROWS = 128
#: Rows and queries that are multiplied at once.
DENSE_ROWS, DENSE_QUERIES = 4096, 1024


# --- dense leg -------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``width`` components, none of them NULL, and which rows these are."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = flat.reshape(len(good), width)
    whole = ~np.isnan(values).any(axis=1)
    values, good = values[whole], good[whole]
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0), good


def _pack_vectors(rows: pa.Table, width: int | None = None) -> dict:
    """Queries as unit vectors by width (or of one width only); NULL and empty vectors find nothing."""
    column = rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding")
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    groups, keys, n = [], [], 0
    for size in np.unique(sizes[sizes > 0]) if width is None else [width]:
        vectors, good = _matrix(column, int(size))
        groups.append((int(size), np.arange(n, n + len(good)), vectors))
        keys.append(good)
        n += len(good)
    kept = np.concatenate(keys) if keys else np.empty(0, dtype=int)
    return {"query_ids": rows.column("query_id").to_numpy()[kept], "groups": groups}


def _cosine(rows: pa.Table, packed: dict) -> np.ndarray:
    """Scores of all rows; vectors of different widths, and NULL vectors, score minus infinity."""
    out = np.full((len(packed["query_ids"]), rows.num_rows), -np.inf)
    for width, who, vectors in packed["groups"]:
        found, good = _matrix(rows.column("embedding"), width)
        if len(good) and len(who):
            out[np.ix_(who, good)] = vectors @ found.T
    return out


def _cosine_best(tables: Iterator[pa.Table], packed: dict, k: int) -> pa.RecordBatch:
    """The k best rows per query, many rows against a block of queries: the more rows at once, the fewer reach a query's k-th score."""
    best = _Best(k, len(packed["query_ids"]))
    for table in tables:
        for start in range(0, table.num_rows, DENSE_ROWS):
            part = table.slice(start, DENSE_ROWS)
            ids = part.column("chunk_id").to_numpy()
            for width, who, vectors in packed["groups"]:
                found, good = _matrix(part.column("embedding"), width)
                for low in range(0, len(who) if len(good) else 0, DENSE_QUERIES):
                    block = slice(low, low + DENSE_QUERIES)
                    best.add(ids[good], vectors[block] @ found.T, who[block])
    return best.batch(packed["query_ids"])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = LEG_LIMIT, **options) -> DataFrame:
    """Cosine top-k. Queries: query_id, embedding. Chunks: chunk_id, embedding."""
    return topk(
        queries.select("query_id", "embedding"), chunks.select("chunk_id", "embedding"), k, _pack_vectors, None, search=_cosine_best, **options
    )


def vector_cells(chunks: DataFrame, n_lists: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """Chunks (chunk_id, embedding) written by k-means cell, and the unit centres of the cells.

    Centres are fitted on all usable vectors. NULL, empty and zero vectors have no cell. The table is partitioned by ``cell``, so a search
    reads the cells it probes and no others; a cell of more than a task's share of rows is many files and many tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = chunks.where("embedding is not null and exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null)")
    points = usable.select("chunk_id", "embedding", array_to_vector("embedding").alias("features"))
    model = KMeans(k=n_lists, seed=seed, featuresCol="features", predictionCol="cell", distanceMeasure="cosine").fit(points)
    centres = np.array(model.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    path = run_dir(chunks.sparkSession, "vector-cells")
    sizes = model.summary.clusterSizes
    share = max(CELL_FILE_ROWS, -(-sum(sizes) // int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.get(F.array(*[F.lit(-(-n // share) or 1) for n in sizes]), "cell")
    told = model.transform(points).select("chunk_id", "embedding", "cell")
    told.repartition("cell", F.pmod(F.xxhash64("chunk_id"), parts)).write.partitionBy("cell").parquet(path)
    return chunks.sparkSession.read.schema("chunk_id bigint, embedding array<float>, cell int").parquet(path), centres


def search_cells(
    queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int, n_probe: int, **options
) -> DataFrame:
    """Cosine top-k of each query over its ``n_probe`` nearest cells; scores are exact, recall grows with ``n_probe``.

    Cells that no query probes are not read (partition filter); a cell's rows are multiplied with the queries that
    probe the cell only. With all cells probed the result is that of ``dense_topk``.
    """

    width = centres.shape[1]

    def near(vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :n_probe]

    def probed(batches):
        for batch in batches:
            vectors = _pack_vectors(pa.Table.from_batches([batch]), width)["groups"][0][2]
            if len(vectors):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(near(vectors)), pa.int32())], ["cell"])

    asked = queries.select("query_id", "embedding")
    wanted = [r.cell for r in asked.mapInArrow(probed, "cell int").distinct().collect()]  # at most one row per cell

    def pack(rows: pa.Table) -> dict:
        packed = _pack_vectors(rows, width)
        vectors = packed["groups"][0][2]
        probes = np.zeros((len(vectors), len(centres)), dtype=bool)
        if len(probes):
            np.put_along_axis(probes, near(vectors), True, axis=1)
        return {**packed, "vectors": vectors, "probes": probes}

    def score(rows: pa.Table, packed: dict) -> np.ndarray:
        out = np.full((len(packed["vectors"]), rows.num_rows), -np.inf)
        found = rows.column("cell").to_numpy()
        for cell in np.unique(found):
            at, who = np.flatnonzero(found == cell), np.flatnonzero(packed["probes"][:, cell])
            if len(who):
                part = {"query_ids": who, "groups": [(width, np.arange(len(who)), packed["vectors"][who])]}
                out[np.ix_(who, at)] = _cosine(rows.take(pa.array(at)), part)
        return out

    return topk(asked, cells.where(F.col("cell").isin(wanted)), k, pack, score, **options)


def cell_count(rows: int) -> int:
    """Cells for a corpus of ``rows`` vectors: about the square root, so that a cell holds as many rows as there are cells."""
    return max(1, min(MAX_CELLS, rows, round(rows**0.5)))


def probes_for_recall(queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int, recall: float, sample: int = RECALL_QUERIES) -> int:
    """Fewest probed cells that find ``recall`` of the exact top-k neighbours, measured on ``sample`` queries picked by hash.

    The cell of a true neighbour is probed from its place in the query's order of cells on, so one exact search of the sample
    gives the recall of every number of probes. The mean over the sample must exceed ``recall`` by three standard errors, for the
    queries outside it; with all queries in the sample it is the recall itself.
    """
    asked = queries.select("query_id", "embedding").where("embedding is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample + 1)
    rows = asked.toArrow()  # at most sample + 1 rows
    whole, rows = rows.num_rows <= sample, rows.slice(0, sample)
    packed = _pack_vectors(rows, centres.shape[1])
    vectors, names = packed["groups"][0][2], packed["query_ids"]
    probed = queries.sparkSession.createDataFrame(rows)
    hits = dense_topk(probed, cells.select("chunk_id", "embedding"), k).join(cells.select("chunk_id", "cell"), "chunk_id")
    found = hits.select("query_id", "cell").toArrow()  # at most k rows per query of the sample
    if not len(names) or not found.num_rows:
        return len(centres)
    nearest = np.argsort(-(vectors @ centres.T), axis=1, kind="stable")
    order = np.argsort(nearest, axis=1)  # place of each cell
    at = {int(q): i for i, q in enumerate(names)}
    query = np.array([at[q] for q in found.column("query_id").to_pylist()])
    places = order[query, found.column("cell").to_numpy()]
    asked_of = np.bincount(query, minlength=len(names))
    for n_probe in range(1, len(centres)):
        hit = np.bincount(query, places < n_probe, minlength=len(names))[asked_of > 0] / asked_of[asked_of > 0]
        slack = 0.0 if whole else 3 * hit.std() / len(hit) ** 0.5
        if hit.mean() - slack >= recall:
            return n_probe
    return len(centres)


def dense_topk_ann(
    queries: DataFrame, chunks: DataFrame, k: int, n_lists: int | None = None, n_probe: int | None = None, seed: int = 7, recall: float = RECALL
) -> DataFrame:
    """Cells of ``chunks`` built and searched at once; see ``vector_cells`` and ``search_cells``.

    Without ``n_lists`` the number of cells follows the rows; without ``n_probe`` it is measured for ``recall`` (``probes_for_recall``).
    """
    cells, centres = vector_cells(chunks, n_lists or cell_count(chunks.count()), seed)
    return search_cells(queries, cells, centres, k, n_probe or probes_for_recall(queries, cells, centres, k, recall))


# --- lexical leg -----------------------------------------------------------


def lexical_index(chunks: DataFrame) -> DataFrame:
    """Forward index: chunk_id, tokens, doc_len. Chunks: chunk_id, text."""
    return chunks.select("chunk_id", tokenize("text").alias("tokens")).withColumn("doc_len", F.size("tokens").cast("bigint"))


def bm25_postings(index: DataFrame) -> DataFrame:
    """(term, chunk_id, tf), combined before the shuffle as a chunk's tokens sit in one task."""
    return index.select("chunk_id", F.explode("tokens").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def bm25_terms(index: DataFrame) -> DataFrame:
    """Document frequency per term."""
    return index.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def bm25_topk(
    queries: DataFrame, index: DataFrame, k: int = LEG_LIMIT, k1: float = 1.2, b: float = 0.75, **options
) -> DataFrame:
    """BM25 top-k. Queries: query_id, text. Index: from :func:`lexical_index`.

    Each distinct query term counts once. A term that occurs in every chunk costs arithmetic, never a row per pair: see ``products``.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    # Counted first, so that a term of nearly every chunk is combined before it moves.
    used = bm25_terms(index).join(terms.select("term").distinct(), "term", "left_semi")
    stats = bm25_stats(index).first()
    n_docs, avg_len = stats["n_docs"], stats["avg_len"] or 1.0
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(used, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("entries"))
    # Written once: its size is checked before it is read. A query is one row, no larger than its text and its numbers.
    weighted = materialize(weighted.select("query_id", F.col("entries.term").alias("terms"), F.col("entries.idf").alias("idfs")), "query-terms")

    def search(tables: Iterator[pa.Table], packed: dict, k: int) -> pa.RecordBatch:
        return bm25_best(tables, packed, k, k1, b, avg_len)

    # Packed words are a quarter of the size of their rows. A row is read as one text, as its tokens have no blanks.
    options.setdefault("broadcast_bytes", 2 * BROADCAST_BYTES)
    corpus = index.select("chunk_id", F.array_join("tokens", " ").alias("words"), "doc_len")
    return topk(weighted, corpus, k, pack_queries, None, search=search, **options)


# --- filters, fusion, hydration --------------------------------------------


def prefilter(
    chunks: DataFrame, category: str | None = None, prefixes: tuple[str, ...] | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Rows a search may see; applied before any top-k. An empty id list leaves nothing."""
    if category is not None and (not category.strip() or len(category.encode()) > 512):
        raise ValueError("invalid category filter")
    if prefixes and any(not p.strip() or len(p.encode()) > 512 for p in prefixes):
        raise ValueError("invalid category prefix filter")
    out = chunks.filter("is_active")
    if category is not None:
        out = out.filter(F.col("category") == category)
    if prefixes:
        out = out.filter(_any(F.col("category").startswith(p) for p in prefixes))
    if ids is not None:
        out = out.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def in_scope(category: Column, prefixes: tuple[str, ...] | None) -> Column:
    """Equal to a prefix or below it as a path."""
    if not prefixes:
        return F.lit(True)
    return _any((category == p) | category.startswith(p + " / ") for p in prefixes)


def typed_scope(chunks: DataFrame, content_types: tuple[str, ...], prefixes: tuple[str, ...] | None = None) -> DataFrame:
    """Active chunks of the allowed types inside the category prefixes."""
    return chunks.filter(
        F.col("is_active") & F.col("content_type").isin(*content_types) & in_scope(F.col("category"), prefixes)
    )


def policy_scope(intents: DataFrame) -> DataFrame:
    """One (intent, prefix) row per scope of a high-risk intent, with the content types it forces; other intents carry an error."""
    scopes = F.create_map(*[x for name, values in POLICY_PREFIXES.items() for x in (F.lit(name), F.array(*map(F.lit, values)))])
    found = F.try_element_at(scopes, F.col("intent"))
    return intents.select(
        "*", F.explode_outer(found).alias("category_prefix"),
    ).withColumns({
        "content_types": F.when(F.col("category_prefix").isNotNull(), F.array(*map(F.lit, POLICY_TYPES))),
        "error": F.when(F.col("category_prefix").isNull(), "policy_retrieval_needs_refund_or_after_sale"),
    })


def policy_hits(hits: DataFrame, scopes: DataFrame, key: str = "query_id") -> DataFrame:
    """Hits inside the scope that the intent of their query forces, each once, renumbered in hit order.

    Hits: ``key``, n, category, content_type and payload. Scopes: from ``policy_scope``, with ``key``. A query without a
    scope has no hits. Scopes are at most a few rows per query, so they are folded to one row each before the join.
    ``n`` is an integer and unique per query; hits are numbered in blocks of it, so a query may have any number of hits.
    """
    folded = scopes.where("error is null").groupBy(key).agg(
        F.collect_set("category_prefix").alias("__prefixes"), F.first("content_types").alias("__types")
    )
    inside = F.exists("__prefixes", lambda p: (F.col("category") == p) | F.col("category").startswith(F.concat(p, F.lit(" / "))))
    kept = hits.join(folded, key).filter(inside & F.array_contains("__types", F.col("content_type")))
    numbered = running(kept.drop("__prefixes", "__types"), [key], "n", {"__place": ("sum", F.lit(1).cast("bigint"))})
    return numbered.withColumn("n", F.col("__place")).drop("__place")


def rrf_fuse(legs: list[DataFrame], limit: int = HYBRID_LIMIT, k: int = RRF_K, leg_limit: int = LEG_LIMIT) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs, each cut to its best ``leg_limit``."""
    if not 50 <= limit <= 100:
        raise ValueError("the fused output limit must be in [50, 100]")
    ranked = None
    for leg in legs:
        part = leg.filter(F.col("rank") <= leg_limit).select("query_id", "chunk_id", (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("s"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 12).alias("score"))
    return rank_hits(fused, limit)


def hydrate(
    hits: DataFrame, chunks: DataFrame, sync: DataFrame, content_types: tuple[str, ...] | None = None
) -> DataFrame:
    """Evidence rows: hits whose chunk is active and whose hash agrees everywhere.

    Hits: query_id, chunk_id, score, rank, content_hash. ``n`` renumbers the
    accepted hits of a query in rank order.
    """
    live = chunks.filter("is_active").select(
        F.col("id").alias("chunk_id"), "content_hash", F.col("chapter_path").alias("section_path"),
        F.coalesce(F.get("questions", F.lit(0)), F.lit("")).alias("question"), "answer", "source_key", "category", "content_type",
    )
    if content_types:
        live = live.filter(F.col("content_type").isin(*content_types))
    agreed = live.join(sync.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
    accepted = hits.join(agreed, ["chunk_id", "content_hash"])
    order = Window.partitionBy("query_id").orderBy("rank")
    return accepted.withColumn("n", F.row_number().over(order).cast("bigint")).drop("rank", "content_hash")


def rerank(candidates: DataFrame, scores: DataFrame, top_n: int = FINAL_LIMIT) -> DataFrame:
    """Apply external scores to candidates (query_id, n, ...); keep the best ``top_n``.

    Scores: query_id, index (0-based candidate position), relevance. A query's
    scores must be valid, unique, finite and complete; else ``error`` is set on
    its rows and no order is given.
    """
    counts = candidates.groupBy("query_id").agg(F.count("*").alias("n_candidates"))
    given = scores.join(counts, "query_id")
    finite = ~F.isnan("relevance") & (F.abs("relevance") != F.lit(float("inf")))
    valid = F.col("index").between(0, F.col("n_candidates") - 1) & F.coalesce(finite, F.lit(False))
    checks = given.groupBy("query_id", "n_candidates").agg(
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"),
        F.count("*").alias("given"), F.count_distinct("index").alias("distinct"),
    )
    expected = F.least(F.lit(top_n), F.col("n_candidates"))
    error = (
        F.when(F.col("given").isNull(), "incomplete_rerank_result")
        .when((F.col("invalid") > 0) | (F.col("distinct") != F.col("given")), "invalid_rerank_result")
        .when(F.col("given") != expected, "incomplete_rerank_result")
    )
    verdicts = counts.join(checks.drop("n_candidates"), "query_id", "left").select("query_id", error.alias("error"))
    scored = candidates.withColumn("index", F.col("n") - 1).join(scores, ["query_id", "index"], "left").join(verdicts, "query_id")
    kept = scored.filter(F.col("error").isNull() & F.col("relevance").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "n")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    failed = scored.filter(F.col("error").isNotNull()).select("query_id", "error").distinct()
    rows = ranked.select(
        *[c for c in candidates.columns if c not in ("n", "score")],
        F.col("rank").cast("bigint").alias("n"), F.col("relevance").alias("score"), "error",
    )
    return rows.unionByName(failed, allowMissingColumns=True)


def search_legs(queries: DataFrame, chunks: DataFrame, dense: bool = True, lexical: bool = True) -> dict[str, DataFrame]:
    """Both ranked legs over the active chunks, each written once for all its uses.

    Queries: query_id, embedding, lexical. Chunks: id, embedding, embedding_text.
    """
    searched = chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "embedding", F.col("embedding_text").alias("text"))
    legs = {}
    if dense:
        with_vector = searched.filter(F.col("embedding").isNotNull())
        legs["dense"] = materialize(dense_topk(queries, with_vector), "dense-leg")
    if lexical:
        index = materialize(lexical_index(searched), "lexical-index")
        asked = queries.select("query_id", F.col("lexical").alias("text"))
        legs["bm25"] = materialize(bm25_topk(asked, index), "lexical-leg")
    return legs


def retrieve(
    queries: DataFrame, chunks: DataFrame, sync: DataFrame, strategy: str, scores: DataFrame | None = None,
    limit: int = HYBRID_LIMIT, legs: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, final) of one strategy for a whole query table.

    Ranked hits are written once. Candidates are a view of hits and chunks, so that answers are read, moved and written for
    those uses only that take them; whoever uses candidates often writes the columns in question. Pass ``legs`` to share the
    searches of strategies.
    """
    if strategy not in STRATEGIES:
        raise ValueError("unknown strategy")
    if strategy == "hybrid_rerank" and scores is None:
        raise ValueError("hybrid_rerank needs a score table")
    if legs is None:
        legs = search_legs(queries, chunks, strategy != "bm25", strategy != "dense")
    hits = legs[strategy] if strategy in legs else materialize(rrf_fuse([legs["dense"], legs["bm25"]], limit), "fused-hits")
    hashes = chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "content_hash")
    candidates = hydrate(hits.join(hashes, "chunk_id"), chunks, sync)
    if strategy == "hybrid_rerank":
        return candidates, rerank(candidates, scores)
    return candidates, candidates.filter(F.col("n") <= FINAL_LIMIT)


# --- FAQ and policy retrieval ----------------------------------------------


def shown_question(questions: Column, path: Column, category: Column) -> Column:
    """First non-blank question, else the last heading, else the category."""
    asked = F.get(F.filter(F.transform(questions, tx.strip), lambda q: q != ""), F.lit(0))
    heading = tx.strip(F.try_element_at(path, F.lit(-1)))
    return F.coalesce(asked, F.when(heading != "", heading), category)


def faq_retrieve(hits: DataFrame, chunks: DataFrame, top_k: int = FAQ_LIMIT, min_similarity: float = 0.6) -> DataFrame:
    """At most five hits above the threshold with their answers, in hit order."""
    if top_k < 1 or not -1 <= min_similarity <= 1:
        raise ValueError("top_k must be positive and min_similarity a cosine value")
    kept = hits.filter((F.col("score") >= min_similarity) & (F.col("rank") <= min(top_k, FAQ_LIMIT)))
    ready = chunks.filter(F.col("is_active") & (F.col("vector_status") == "vectorized")).select(
        F.col("id").alias("chunk_id"), shown_question(F.col("questions"), F.col("chapter_path"), F.col("category")).alias("question"),
        "answer", "category",
    )
    return kept.join(ready, "chunk_id").filter((F.col("question") != "") & ~tx.is_blank("answer"))


def merge_multi_query(hits: DataFrame) -> DataFrame:
    """Best row per chunk over the query variants of one question, renumbered.

    Hits: question_id, arrival (unique, increasing per question), chunk_id,
    source_key, score and payload. A better later duplicate takes over with its
    own arrival; equal scores keep the first.
    """
    key = (
        F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("c:"), F.col("chunk_id").cast("string")))
        .when(F.coalesce(F.col("source_key"), F.lit("")) != "", F.concat(F.lit("s:"), F.col("source_key")))
        .otherwise(F.concat(F.lit("u:"), F.col("arrival").cast("string")))
    )
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != F.lit(float("inf")))
    scored = hits.withColumns({"__key": key, "__score": F.when(finite, F.col("score")).otherwise(F.lit(float("-inf")))})
    best = Window.partitionBy("question_id", "__key").orderBy(F.desc("__score"), "arrival")
    kept = scored.withColumn("__r", F.row_number().over(best)).filter("__r = 1")
    order = Window.partitionBy("question_id").orderBy(F.desc("__score"), "arrival")
    return kept.withColumn("n", F.row_number().over(order).cast("bigint")).drop("__key", "__score", "__r")


def evidence_gate(evidence: DataFrame, questions: DataFrame, min_score: float, strategy: str) -> DataFrame:
    """Per question: best usable score, whether it passes, and the low-confidence reason."""
    finite = ~F.isnan("score") & (F.abs("score") != F.lit(float("inf")))
    usable = evidence.filter(F.coalesce(~tx.is_blank("answer"), F.lit(False)) & F.coalesce(finite, F.lit(False)))
    best = usable.groupBy("query_id").agg(F.max("score").alias("gate_score"), F.count("*").alias("usable"))
    out = questions.join(best, "query_id", "left")
    passed = F.coalesce(F.col("gate_score") >= min_score, F.lit(False))
    reason = F.concat(
        F.lit(f"strategy={strategy}; score="), F.coalesce(F.col("gate_score").cast("string"), F.lit("None")), F.lit(f"; threshold={min_score}")
    )
    return out.withColumns({
        "usable": F.coalesce("usable", F.lit(0)), "gate_passed": passed,
        "stop_reason": F.when(~passed, "retrieval_low_conf"), "reason": F.when(~passed, reason),
    })


def fit_evidence(items: Column, cost, top_k: int, budget: int) -> Column:
    """Greedy selection among the first ``top_k`` array items: one that does not
    fit is skipped and the next is tried."""
    kind = "array<int>"

    def step(acc: Column, i: Column) -> Column:
        price = cost(F.get(items, i))
        fits = acc["used"] + price <= budget
        return F.struct(
            F.when(fits, F.concat(acc["chosen"], F.array(i))).otherwise(acc["chosen"]).alias("chosen"),
            (acc["used"] + F.when(fits, price).otherwise(F.lit(0).cast("bigint"))).alias("used"),
        )

    first = F.slice(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0))), F.lit(1), F.least(F.size(items), F.lit(top_k)))
    start = F.struct(F.array().cast(kind).alias("chosen"), F.lit(0).cast("bigint").alias("used"))
    return F.aggregate(first, start, step, lambda acc: F.transform(acc["chosen"], lambda i: F.get(items, i)))


def arrange_evidence(evidence: DataFrame) -> DataFrame:
    """Prompt place: odd ranks ascending, then even ranks descending."""
    odd = F.col("n") % 2 == 1
    order = Window.partitionBy("query_id").orderBy(F.when(odd, 0).otherwise(1), F.when(odd, F.col("n")).otherwise(-F.col("n")))
    return evidence.withColumn("place", F.row_number().over(order).cast("bigint"))


# --- query expansion and evidence shapes -----------------------------------

MAX_EXPANSION_CHARS = 240
MAX_EXPANSIONS = 3


def parse_expansions(raw: Column | str, fallback: Column | str) -> Column:
    """Fallback question first, then at most three distinct valid expansions."""
    raw, fallback = tx._c(raw), tx._c(fallback)

    def strings(v: Column) -> Column:
        """The listed strings, or NULL unless this is one object with one key full of strings."""
        values = js.value(v, "$.queries", "array<variant>")
        texts = F.transform(values, lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")))
        valid = js.is_object(v) & js.keys_are(raw, "queries") & ~F.exists(texts, lambda t: t.isNull())
        return F.when(valid, texts)

    texts = js.read_object(raw, strings)

    def normalized(value: Column) -> Column:
        # Lower case plus the two letters whose case folding differs from it.
        lowered = F.lower(F.regexp_replace(value, rf"(?U){tx.WS}+", " "))
        return F.regexp_replace(F.regexp_replace(lowered, "ß", "ss"), "ς", "σ")

    def step(acc: Column, item: Column) -> Column:
        text = tx.strip(item)
        fresh = (
            (text != "") & (F.length(text) <= MAX_EXPANSION_CHARS) & (F.size(acc) <= MAX_EXPANSIONS)
            & ~F.exists(acc, lambda seen: normalized(seen) == normalized(text))
        )
        return F.when(fresh, F.concat(acc, F.array(text))).otherwise(acc)

    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.array(fallback), step)


EVIDENCE = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("chunk_id", T.LongType()),
    T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("source_key", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("category", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("source_url", T.StringType()),
])


def adapt_evidence(
    hits: DataFrame, shape: str, category: str | None = None, prefixes: tuple[str, ...] | None = None,
    content_types: tuple[str, ...] | None = None,
) -> DataFrame:
    """One evidence schema for the three result shapes: traced, plain and FAQ.

    Traced results were filtered before ranking; plain ones are filtered by type
    and category path only if types are given; FAQ hits get fixed source fields.
    """
    scope = in_scope(F.col("category"), prefixes)
    if shape == "traced":
        out = hits.withColumn("source_url", tx.source_url("source_key", "section_path"))
    elif shape == "plain":
        out = hits
        if content_types:
            out = out.filter(F.col("content_type").isin(*content_types) & scope)
    elif shape == "faq":
        out = hits.withColumns({
            "source_key": F.lit("legacy-faq"), "section_path": F.array().cast("array<string>"), "content_type": F.lit("product_faq"),
        })
        if category:
            out = out.filter(F.col("category") == category)
        out = out.filter(scope)
        if content_types:
            out = out.filter(F.col("content_type").isin(*content_types))
    else:
        raise ValueError("unknown evidence shape")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in EVIDENCE if f.name not in out.columns}
    return out.withColumns(missing).select(*EVIDENCE.names)


def question_numbers(hits: DataFrame, key: str, order: str) -> DataFrame:
    """Arrival numbers per question for hits in a unique integer order."""
    return running(hits, [key], order, {"arrival": ("sum", F.lit(1).cast("bigint"))})
