"""Stored inverted lists for the lexical leg, searched with score bounds (MaxScore).

The corpus is cut into ranges of documents, as the tasks that read it find them. A row of the stored table is one posting block: the
documents of one range that hold one term, with term frequencies, lengths, the largest frequency and the shortest length.
No posting of the block can score more than those two together, whatever the parameters of the score. The
table is partitioned by term bucket, so a search reads the buckets of its terms and, of these, the blocks of its terms.

A search meets the blocks range by range. With the k-th best score of a query so far as the floor, a range whose bounds add up to
less is skipped; else the terms with the smallest bounds, as long as these add up to less than the floor, cannot
bring in a document on their own: they are only looked up for documents of the other terms that can still reach the floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.functions.lexical import tokenize
from supportlake.operators.topk import BROADCAST_BYTES, HITS, SCORE_DIGITS, _Best, rank_hits
from supportlake.session import materialize, run_dir

#: Documents of a range, postings that a bucket is planned for, and most buckets.
RANGE_DOCS = 2048
BUCKET_DOCS = 10_000
MAX_BUCKETS = 4096
#: Ranges that share a file of a bucket.
FILE_RANGES = 256
#: Bucket of the rows that hold a range's size: documents (n), tokens (max_tf) and documents with a text (min_len).
SIZES = -1
BLOCKS = (
    "term string, first_id bigint, n bigint, max_tf bigint, min_len bigint, ids array<bigint>, tfs array<bigint>, lens array<bigint>"
)


@dataclass(frozen=True)
class Postings:
    """A stored index: its folder, number of buckets, documents and mean length."""

    path: str
    n_buckets: int
    n_docs: int
    avg_len: float

    def blocks(self, spark) -> DataFrame:
        return spark.read.schema(f"{BLOCKS}, bucket int").parquet(self.path)


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def invert(ids: np.ndarray, tokens: pa.ListArray) -> pa.RecordBatch:
    """Posting blocks of one range by term, and a row without a term that has its size (see SIZES)."""
    order = np.argsort(ids, kind="stable")
    counts = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    owner = np.repeat(rank, counts)
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(ids), 1) + owner, return_counts=True)
    term, doc = pair // max(len(ids), 1), pair % max(len(ids), 1)
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    bounds = np.r_[start, len(term)].astype(np.int32)
    lengths = counts[order][doc]
    n = len(start)
    first = int(ids.min())
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(term[start])).cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.full(n + 1, first), pa.int64()),
        pa.array(np.r_[np.diff(bounds), len(ids)].astype(np.int64)),
        pa.array(np.r_[np.maximum.reduceat(tf, start) if n else [], int(counts.sum())].astype(np.int64)),
        pa.array(np.r_[np.minimum.reduceat(lengths, start) if n else [], len(ids) - tokens.null_count].astype(np.int64)),
        *[_lists(v, np.r_[bounds, bounds[-1]]) for v in (ids[order][doc], tf, lengths)],
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])


def build_postings(chunks: DataFrame, name: str = "postings") -> Postings:
    """The stored index of ``chunks`` (``chunk_id`` unique bigint, ``text``). A null text counts as a document, but not in the mean length.

    A range is inverted in the task that reads it, named by its smallest id, so that the only shuffle, to the buckets, moves blocks, not
    postings. A term of every document is a block per range, dealt over as many files as there are FILE_RANGES ranges.
    """
    spark = chunks.sparkSession
    n_docs = chunks.count()
    n_buckets = min(MAX_BUCKETS, max(16, n_docs // BUCKET_DOCS))
    n_ranges = -(-n_docs // RANGE_DOCS)
    parts = max(1, -(-n_ranges // FILE_RANGES))
    tokens = chunks.select("chunk_id", tokenize("text").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return invert(table.column("chunk_id").to_numpy(), table.column("tokens").combine_chunks())

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, RANGE_DOCS - rows)
                batch, rows = batch.slice(part.num_rows), rows + part.num_rows
                held.append(part)
                if rows == RANGE_DOCS:
                    yield close()
                    held, rows = [], 0
        if held:
            yield close()

    made = tokens.mapInArrow(run, BLOCKS)
    placed = made.withColumn("bucket", F.when(F.col("term").isNull(), SIZES).otherwise(_bucket(n_buckets)))
    path = run_dir(spark, name)
    dealt = placed.repartition(n_buckets * parts if parts > 1 else n_buckets, "bucket", F.pmod(F.xxhash64("first_id"), F.lit(parts)))
    dealt.sortWithinPartitions("bucket", "term", "first_id").write.partitionBy("bucket").parquet(path)
    sizes = spark.read.schema(f"{BLOCKS}, bucket int").parquet(path).where(F.col("bucket") == SIZES)
    tokens_in, texts_in = sizes.agg(F.sum("max_tf"), F.sum("min_len")).first()
    return Postings(path, n_buckets, n_docs, tokens_in / texts_in if tokens_in else 1.0)


def buckets_of(postings: Postings, terms: DataFrame) -> list[int]:
    """The buckets of ``terms``, at most MAX_BUCKETS numbers."""
    return sorted(r.bucket for r in terms.select(_bucket(postings.n_buckets).alias("bucket")).distinct().collect())


def posting_blocks(postings: Postings, terms: DataFrame, buckets: list[int], *columns: str) -> DataFrame:
    """The stored blocks of ``terms`` (distinct ``term``), which lie in ``buckets``: no others are read."""
    stored = postings.blocks(terms.sparkSession).where(F.col("bucket").isin(buckets)).select("term", *columns)
    return stored.join(terms.select("term"), "term", "left_semi")


def pack_terms(rows: pa.Table) -> dict:
    """Queries of (query_id, term, idf) rows: each query's terms as numbers, one query after the other."""
    names, who = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(who, kind="stable")
    return {
        "query_ids": names, "terms": coded.dictionary, "codes": coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order],
        "idf": rows.column("idf").to_numpy()[order], "first": np.searchsorted(who[order], np.arange(len(names) + 1)),
    }


class Seen:
    """What a search did: postings scored and all postings of the queries' terms, ranges skipped and all."""

    def __init__(self):
        self.scored = self.postings = self.skipped = self.ranges = 0


def score_range(block: pa.Table, packed: dict, best: _Best, k1: float, b: float, avg_len: float, seen: Seen) -> None:
    """Adds one range to the best hits: ``block`` has the range's posting blocks."""
    lists = block.column("ids").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    ids, doc = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    tf = block.column("tfs").combine_chunks().flatten().to_numpy()
    lens = block.column("lens").combine_chunks().flatten().to_numpy()
    bounds = bounds - bounds[0]
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / avg_len))
    top, least = block.column("max_tf").to_numpy(), block.column("min_len").to_numpy()
    most = top * (k1 + 1) / (top + k1 * (1 - b + b * least / avg_len))
    at = np.full(len(packed["terms"]), -1)
    place = pc.index_in(block.column("term").combine_chunks(), value_set=packed["terms"]).fill_null(-1).to_numpy()
    at[place[place >= 0]] = np.flatnonzero(place >= 0)
    size = np.diff(bounds)
    for q in range(len(packed["query_ids"])):
        part = slice(packed["first"][q], packed["first"][q + 1])
        mine = at[packed["codes"][part]]
        held = mine >= 0
        mine, idf = mine[held], packed["idf"][part][held]
        if not len(mine):
            continue
        reach = idf * most[mine]
        seen.ranges += 1
        seen.postings += int(size[mine].sum())
        floor = best.scores[q, -1] - 10.0**-SCORE_DIGITS
        if reach.sum() < floor:
            seen.skipped += 1
            continue
        order = np.argsort(reach, kind="stable")
        mine, idf, reach = mine[order], idf[order], reach[order]
        below = np.cumsum(reach)
        weak = int(np.searchsorted(below, floor))  # lists that cannot reach the floor together
        strong = mine[weak:]
        seen.scored += int(size[strong].sum())
        spots = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in strong.tolist()])
        found = doc[spots]
        score = np.bincount(found, np.repeat(idf[weak:], size[strong]) * weight[spots], len(ids))
        hits = np.flatnonzero(np.bincount(found, minlength=len(ids)))
        for j in range(weak - 1, -1, -1):
            hits = hits[score[hits] + below[j] >= floor]
            if not len(hits):
                break
            low, high = bounds[mine[j]], bounds[mine[j] + 1]
            own = doc[low:high]
            spot = np.minimum(np.searchsorted(own, hits), len(own) - 1)
            there = own[spot] == hits
            seen.scored += int(there.sum())
            score[hits[there]] += idf[j] * weight[low + spot[there]]
        if len(hits):
            _keep(best, q, ids[hits], np.round(score[hits], SCORE_DIGITS))


def _keep(best: _Best, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
    k = best.scores.shape[1]
    scores, ids = np.r_[best.scores[q], scores], np.r_[best.ids[q], ids]
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    best.scores[q], best.ids[q] = scores[order], ids[order]


def score_ranges(tables: Iterator[pa.Table], packed: dict, k: int, k1: float, b: float, avg_len: float, seen: Seen | None = None) -> pa.RecordBatch:
    """The k best of the ranges in ``tables``, whose rows are sorted by ``first_id``; a range may go on in the next table."""
    best, seen = _Best(k, len(packed["query_ids"])), seen or Seen()
    rest: pa.Table | None = None
    for table in tables:
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        first = table.column("first_id").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(first)) + 1]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            score_range(table.slice(a, z - a), packed, best, k1, b, avg_len, seen)
        rest = table.slice(int(cuts[-1]))
    if rest is not None:
        score_range(rest, packed, best, k1, b, avg_len, seen)
    return best.batch(packed["query_ids"])


def bm25_search(
    queries: DataFrame, postings: Postings, k: int, k1: float = 1.2, b: float = 0.75, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """BM25 top-k (query_id, chunk_id, score, rank). Queries: query_id, text; each distinct term counts once. Index: ``build_postings``.

    Blocks of query terms move once, to the task of their range, whatever the number of queries. The query set is
    broadcast if its measured size is within the limit; a larger one is cut into blocks, and posting blocks go to each of them.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    asked = materialize(queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term")), "query-words")
    terms = asked.select("term").distinct()
    buckets = buckets_of(postings, terms)
    often = posting_blocks(postings, terms, buckets, "n").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(postings.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = materialize(asked.join(often, "term").select("query_id", "term", idf.alias("idf")), "query-terms")
    size = weighted.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    wanted = posting_blocks(postings, weighted.select("term").distinct(), buckets, "first_id", "max_tf", "min_len", "ids", "tfs", "lens")
    avg_len = postings.avg_len
    if size <= broadcast_bytes:
        packed = spark.sparkContext.broadcast(pack_terms(weighted.toArrow()))

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield score_ranges((pa.Table.from_batches([x]) for x in batches), packed.value, k, k1, b, avg_len)

        hits = wanted.repartition("first_id").sortWithinPartitions("first_id").mapInArrow(narrow, HITS)
    else:
        blocks = int(-(-size // broadcast_bytes))
        slices = max(1, -(-postings.n_docs // (8 * RANGE_DOCS)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_batches([], schema=pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))
            return pa.Table.from_batches([score_ranges(iter([right.sort_by("first_id")]), pack_terms(left), k, k1, b, avg_len)])

        here = weighted.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        there = wanted.withColumn("__slice", F.pmod(F.xxhash64("first_id"), F.lit(slices)).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        hits = here.groupBy("__block", "__slice").cogroup(there.groupBy("__block", "__slice")).applyInArrow(meet, HITS)
    return rank_hits(hits, k)
