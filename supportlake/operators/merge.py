"""Keeping the chunk table, its vectors and the search index in step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators.scan import dense_numbers, first_per_key
from supportlake.session import bucketed, materialize

# Status names and byte limits of indexed fields.
PENDING, VECTORIZED = "pending", "vectorized"
MAX_TEXT_BYTES = 65535
MAX_CATEGORY_BYTES = 512

_DRAFT_FIELDS = ("category", "questions", "answer", "chapter_path", "content_type", "is_critical")


def faq_to_drafts(faq: DataFrame) -> DataFrame:
    """FAQ rows as chunk drafts keyed ``faq:<id>``."""
    none = F.lit(None).cast("string")
    return faq.select(
        F.concat(F.lit("faq:"), F.col("id").cast("string")).alias("source_key"),
        "category", F.array("question").alias("questions"), "answer", F.array("category").alias("chapter_path"),
        F.lit("product_faq").alias("content_type"), F.lit(False).alias("is_critical"),
        none.alias("previous_source_key"), none.alias("next_source_key"), F.col("id").alias("draft_order"),
    )


def spread_nulls(key: Column | str, by: str) -> Column:
    """A join key whose NULLs become distinct values that match nothing."""
    return F.coalesce(tx._c(key), F.concat(F.lit("\x00"), F.col(by).cast("string")))


def flag_member(
    df: DataFrame, key: Column, values: DataFrame, value: str, flag: str, salt_by: str, salts: int = 16
) -> DataFrame:
    """Add a boolean: is ``key`` among ``values``? Salted, since few keys may hold most rows."""
    listed = values.select(F.col(value).alias("__key")).distinct().withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ).withColumn("__found", F.lit(True))
    salted = df.withColumns({"__key": key, "__salt": F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")})
    joined = salted.join(listed, ["__key", "__salt"], "left")
    return joined.withColumn(flag, F.coalesce("__found", F.lit(False))).drop("__key", "__salt", "__found")


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """The last draft (highest ``draft_order``) of each key with its text and hash, as a table in buckets of the key."""
    last = first_per_key(drafts, ["source_key"], "draft_order", last=True)
    return bucketed(last, "source_key", "latest_drafts", lambda rows: rows.withColumns({
        "embedding_text": tx.embedding_text("category", "questions", "answer"), "content_hash": tx.fingerprint("category", "questions", "answer"),
    }))


def upsert_drafts(chunks: DataFrame, drafts: DataFrame, latest: bool = False) -> DataFrame:
    """Chunk table after an upsert; the last draft (highest ``draft_order``) of a key wins.

    A changed embedding text or a retired chunk goes back to pending without a
    vector; an unchanged chunk keeps its vector. New chunks get ids after the
    highest one, in draft order. ``content_hash`` is the fingerprint, so a
    punctuation-only edit resets the vector but keeps the hash. ``latest`` says that ``drafts`` come from ``latest_drafts``. A chunk table
    that is stored in buckets of ``source_key`` is not shuffled. The result is a view of the two tables, so a use of it reads the columns it
    needs; texts are compared by their SHA-256, so a use that needs no text does not join or sort them.
    """
    last = drafts if latest else latest_drafts(drafts)
    digest = F.sha2("embedding_text", 256)
    incoming = last.select(
        "source_key", *[F.col(c).alias(f"new_{c}") for c in (*_DRAFT_FIELDS, "embedding_text", "content_hash", "draft_order")], digest.alias("__new_digest")
    )
    both = chunks.withColumn("__digest", digest).join(incoming, "source_key", "full_outer")
    drafted, existed = F.col("new_draft_order").isNotNull(), F.col("id").isNotNull()
    # A NULL in the old row counts as changed, as any other difference does.
    reset = drafted & (~existed | ~F.col("__digest").eqNullSafe(F.col("__new_digest")) | ~F.col("is_active"))
    merged = both.withColumns({
        **{c: F.when(drafted, F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*_DRAFT_FIELDS, "content_hash")},
        "embedding_text": F.when(reset, F.col("new_embedding_text")).otherwise(F.col("embedding_text")),
        "vector_status": F.when(reset, F.lit(PENDING)).otherwise(F.col("vector_status")),
        "vector_id": F.when(~reset | ~drafted, F.col("vector_id")),
        "is_active": F.when(drafted, F.lit(True)).otherwise(F.col("is_active")),
    }).select(*chunks.columns, "new_draft_order")
    top = F.coalesce(chunks.agg(F.max("id")).scalar(), F.lit(0))
    # Written once, keys and numbers only: they are counted, numbered and looked up.
    added = materialize(merged.where("id is null").select("source_key", "new_draft_order"), "added-keys")
    numbers = dense_numbers(added, "new_draft_order", "new_id").select("source_key", "new_id")
    numbered = merged.join(numbers.hint("shuffle_hash"), "source_key", "left").withColumn("id", F.coalesce("id", F.col("new_id") + top))
    return numbered.select(*chunks.columns)


def resolve_neighbors(chunks: DataFrame, drafts: DataFrame, latest: bool = False) -> DataFrame:
    """Set previous/next chunk ids of drafted chunks; unknown keys give NULL. ``latest`` as in ``upsert_drafts``.

    Both neighbours are looked up by one join; NULL keys ask for nothing.
    """
    last = drafts if latest else first_per_key(drafts, ["source_key"], "draft_order", last=True)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("previous_source_key").alias("wanted")), F.struct(F.lit(1).alias("side"), F.col("next_source_key").alias("wanted")))
    asked = last.select("source_key", F.explode(sides).alias("s")).select("source_key", "s.side", "s.wanted")
    ids = chunks.select(F.col("source_key").alias("wanted"), F.col("id").alias("__id"))
    found = asked.where("wanted is not null").join(ids, "wanted")
    links = asked.select("source_key", "side", F.lit(None).cast("bigint").alias("__id")).unionByName(found.select("source_key", "side", "__id")).groupBy("source_key").agg(
        F.max(F.when(F.col("side") == 0, F.col("__id"))).alias("__previous_id"), F.max(F.when(F.col("side") == 1, F.col("__id"))).alias("__next_id"),
    ).withColumn("__drafted", F.lit(True))
    joined = chunks.join(links, "source_key", "left")
    drafted = F.coalesce("__drafted", F.lit(False))
    return joined.withColumns({
        "previous_chunk_id": F.when(drafted, F.col("__previous_id")).otherwise(F.col("previous_chunk_id")),
        "next_chunk_id": F.when(drafted, F.col("__next_id")).otherwise(F.col("next_chunk_id")),
    }).select(*chunks.columns)


def retire_missing_documents(chunks: DataFrame, sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Retire ``doc:`` chunks whose source or key is gone; ``stale`` marks every
    inactive document chunk that still holds a vector."""
    is_doc = F.col("source_key").startswith("doc:")
    flagged = flag_member(chunks, tx.source_name("source_key"), sources, "source", "__source", "source_key")
    kept = keys.select("source_key").distinct().withColumn("__kept", F.lit(True))
    out = flagged.join(kept, "source_key", "left").withColumn(
        "is_active", F.col("is_active") & (~is_doc | (F.col("__source") & F.coalesce("__kept", F.lit(False))))
    )
    stale = is_doc & ~F.col("is_active") & F.col("vector_id").isNotNull()
    return out.select(*chunks.columns, stale.alias("stale"))


def retire_missing_faqs(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Retire FAQ chunks whose row is gone; ``stale`` marks those absent now with a vector."""
    is_faq = (F.col("content_type") == "product_faq") & F.col("source_key").startswith("faq:")
    kept = keys.select("source_key").distinct().withColumn("__kept", F.lit(True))
    gone = is_faq & F.col("__kept").isNull()
    out = chunks.join(kept, "source_key", "left").withColumn("is_active", F.col("is_active") & ~gone)
    return out.select(*chunks.columns, (gone & F.col("vector_id").isNotNull()).alias("stale"))


def clear_vectors(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the vector id of the listed chunks that are inactive."""
    listed = ids.select("id").distinct().withColumn("__listed", F.lit(True))
    clears = F.coalesce("__listed", F.lit(False)) & ~F.col("is_active")
    return chunks.join(listed, "id", "left").withColumn("vector_id", F.when(~clears, F.col("vector_id"))).select(*chunks.columns)


def pending_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Active chunks without a current vector, by id; the limit is the caller's batch."""
    waiting = chunks.filter(F.col("is_active") & (F.col("vector_status") == PENDING))
    if limit is None:
        return waiting
    return waiting.orderBy("id").limit(max(limit, 0))


def mark_vectorized(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Set vector id and status where a valid vector arrived; others stay pending. Of several vectors of a chunk the largest id counts."""
    done = vectors.groupBy(F.col("chunk_id").alias("id")).agg(F.max("vector_id").alias("__vector"))
    has = F.col("__vector").isNotNull()
    return chunks.join(done, "id", "left").withColumns({
        "vector_id": F.when(has, F.col("__vector")).otherwise(F.col("vector_id")),
        "vector_status": F.when(has, F.lit(VECTORIZED)).otherwise(F.col("vector_status")),
    }).select(*chunks.columns)


def fetch_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Active, vectorised chunks of each request's id list, with their position in it."""
    wanted = requests.select("request_id", F.posexplode_outer("ids").alias("position", "id")).filter(F.col("id").isNotNull())
    firsts = wanted.groupBy("request_id", "id").agg(F.min("position").alias("position"))
    ready = chunks.filter(F.col("is_active") & (F.col("vector_status") == VECTORIZED))
    return firsts.join(ready, "id")


def sync_plan(chunks: DataFrame, sync: DataFrame) -> DataFrame:
    """(chunk_id, action, content_hash): what the search index must delete or upsert."""
    active = chunks.filter("is_active").select(F.col("id").alias("chunk_id"), "content_hash")
    synced = sync.select("chunk_id", F.col("content_hash").alias("synced_hash"))
    both = active.withColumn("__active", F.lit(True)).join(synced.withColumn("__synced", F.lit(True)), "chunk_id", "full_outer")
    action = (
        F.when(F.col("__active").isNull(), "delete")
        .when(F.col("__synced").isNull() | ~F.col("content_hash").eqNullSafe(F.col("synced_hash")), "upsert")
        .otherwise("keep")
    )
    return both.select("chunk_id", action.alias("action"), "content_hash")


def sync_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action") != "delete").alias("active"),
        F.count_if(F.col("action") == "upsert").alias("synchronized"),
        F.count_if(F.col("action") == "delete").alias("deleted"),
    )


def commit_sync(sync: DataFrame, plan: DataFrame, current: DataFrame) -> DataFrame:
    """Sync state after a run: an upsert counts only if the chunk still has that hash."""
    still = current.filter("is_active").select(F.col("id").alias("chunk_id"), "content_hash")
    written = plan.filter("action = 'upsert'").select("chunk_id", "content_hash").join(
        still, ["chunk_id", "content_hash"], "left_semi"
    )
    gone = plan.filter("action = 'delete'").select("chunk_id").unionByName(written.select("chunk_id"))
    untouched = sync.select("chunk_id", "content_hash").join(gone, "chunk_id", "left_anti")
    return untouched.unionByName(written)


def validate_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """State per row why a vector must not be indexed (NULL where it is fine).

    Rows: chunk_id, embedding, text, category.
    """
    counts = vectors.groupBy("chunk_id").agg(F.count("*").alias("__n"))
    bad_number = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return vectors.join(counts, "chunk_id").withColumn(
        "problem",
        F.when(F.col("__n") > 1, "duplicate_id")
        .when(F.coalesce(F.size("embedding") != dim, F.lit(True)), "dimension")
        .when(bad_number, "not_finite")
        .when(F.octet_length("text") > MAX_TEXT_BYTES, "text_bytes")
        .when(F.octet_length("category") > MAX_CATEGORY_BYTES, "category_bytes"),
    ).drop("__n")


def pair_vectors_with_inputs(inputs: DataFrame, response: DataFrame) -> DataFrame:
    """Put response vectors back on their inputs by index; a batch with holes,
    repeats or foreign indexes is rejected as a whole.

    Inputs: batch_id, index, chunk_id. Response: batch_id, index, embedding.
    """
    grouped = response.groupBy("batch_id", "index").agg(F.count("*").alias("__n"), F.first("embedding").alias("embedding"))
    both = inputs.withColumn("__input", F.lit(True)).join(grouped, ["batch_id", "index"], "full_outer")
    wrong = F.col("__input").isNull() | F.coalesce(F.col("__n") != 1, F.lit(True))
    batches = both.groupBy("batch_id").agg((F.count_if(wrong) == 0).alias("complete"))
    return both.filter("__input").join(batches, "batch_id").select(
        "batch_id", "index", "chunk_id", F.when(F.col("complete"), F.col("embedding")).alias("embedding"), "complete"
    )


def sync_summary(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pending_before, vectorized, failed) of one run over all pending chunks."""
    done = vectors.select(F.col("chunk_id").alias("id")).distinct().withColumn("__done", F.lit(True))
    ok = F.col("__done").isNotNull()
    return pending_chunks(chunks).join(done, "id", "left").agg(
        F.count("*").alias("pending_before"), F.count_if(ok).alias("vectorized"), F.count_if(~ok).alias("failed")
    )


def registered_sources(chunks: DataFrame) -> DataFrame:
    docs = chunks.filter(F.col("is_active") & F.col("source_key").startswith("doc:"))
    return docs.select(tx.source_name("source_key").alias("source")).distinct()
