"""Exact top-k of a corpus for many queries, without emitting pairs.

Scores are computed block against block in Arrow batches and only the k best
rows per query leave a task. A query set whose packed size is within the limit
is broadcast, so the corpus is read in place and not shuffled. A larger set is
cut into blocks; corpus slices and query blocks then meet in a grid of bounded
cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 2**20
SLICE_ROWS = 100_000
#: With at most this many blocks of queries the corpus is read in place for each; beyond, it is moved to the cells of the grid.
PASSES = 8
#: A task sends up to k rows per query, so tasks follow the cores and not the size of the corpus; a cluster that still grows has at least some.
TASKS_PER_CORE, LEAST_TASKS = 3, 24
# Scores are compared at this many decimals, so equal vectors tie exactly.
SCORE_DIGITS = 9

HITS = "query_id bigint, chunk_id bigint, score double"

# pack(arrow table of query rows) -> packed queries with a ``query_ids`` array; plain values, as a broadcast is read without this package
Pack = Callable[[pa.Table], dict]
# score(arrow batch or table of corpus rows, packed) -> matrix of queries x rows
Score = Callable[[pa.Table, dict], np.ndarray]
# search(tables of corpus rows, packed, k) -> batch of the k best rows per query, for scores that are not made as one matrix
Search = Callable[[Iterator[pa.Table], dict, int], pa.RecordBatch]


class _Best:
    """The k best (score, lowest id first) per query seen so far, as two matrices."""

    def __init__(self, k: int, n_queries: int):
        self.scores = np.full((n_queries, k), -np.inf)
        self.ids = np.full((n_queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, ids: np.ndarray, matrix: np.ndarray, who: np.ndarray | None = None, above: float = -np.inf) -> None:
        """Scores above ``above`` of the queries (all, or the numbers ``who``) for the rows ``ids``; scores are rounded here.

        Only scores that reach the k-th of their query are looked at one by one.
        """
        k = self.scores.shape[1]
        if not matrix.size:
            return
        who = np.arange(len(matrix)) if who is None else who
        floor = self.scores[who, -1]
        if matrix.shape[1] > 2 * k:
            # Queries with fewer than k rows so far: the k best scores and all that tie with the last of them.
            fresh = np.flatnonzero(floor == -np.inf)
            floor[fresh] = np.fmax(-np.partition(-matrix[fresh], k - 1, axis=1)[:, k - 1], -np.inf)
        # A score just below the floor may be rounded up to it.
        least = np.maximum(floor - 10.0**-SCORE_DIGITS, np.nextafter(above, np.inf))
        query, column = np.divmod(np.flatnonzero(matrix >= least[:, None]), matrix.shape[1])
        if not len(query):
            return
        hit, query_place = np.unique(query, return_inverse=True)
        mine = who[hit]
        owner = np.r_[query_place, np.repeat(np.arange(len(hit)), k)]
        scores = np.r_[np.round(matrix[query, column], SCORE_DIGITS), self.scores[mine].ravel()]
        keys = np.r_[ids[column], self.ids[mine].ravel()]
        order = np.lexsort((keys, -scores, owner))
        size = np.bincount(owner)
        pick = order[(np.cumsum(size) - size)[:, None] + np.arange(k)]
        self.scores[mine], self.ids[mine] = scores[pick], keys[pick]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        query, rank = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(query_ids, dtype=np.int64)[query], pa.int64()),
                pa.array(self.ids[query, rank], pa.int64()),
                pa.array(self.scores[query, rank], pa.float64()),
            ],
            names=["query_id", "chunk_id", "score"],
        )


def _best_of(tables: Iterator[pa.Table], packed: dict, score: Score, k: int) -> pa.RecordBatch:
    n_queries = len(packed["query_ids"])
    best = _Best(k, n_queries)
    # The score matrix of a step stays at a few million cells for any query set.
    step = min(4096, max(64, 4_000_000 // max(n_queries, 1)))
    for table in tables:
        for start in range(0, table.num_rows if n_queries else 0, step):
            part = table.slice(start, step)
            best.add(part.column("chunk_id").to_numpy(), score(part, packed))
    return best.batch(packed["query_ids"])


def _narrow(packed: Broadcast, search: Search, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = packed.value
        yield search((pa.Table.from_batches([b]) for b in batches), values, k)

    return narrow


def rank_hits(hits: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rank 1..k per query by score, then id; Spark limits each task to k rows first."""
    spec = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    pack: Pack,
    score: Score | None,
    broadcast_bytes: int = BROADCAST_BYTES,
    search: Search | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best corpus rows per query.

    ``queries`` has ``query_id`` (several rows per query are allowed) and
    ``corpus`` a unique ``chunk_id``; both are bigint. ``search`` takes the place of ``score``.
    """
    search = search or (lambda tables, packed, k: _best_of(tables, packed, score, k))
    if k < 1:
        raise ValueError("k must be positive")
    row_bytes = F.lit(16)
    for name, kind in queries.dtypes:
        if kind.startswith("array"):
            row_bytes = row_bytes + F.coalesce(F.size(name), F.lit(0)) * 8
        else:
            row_bytes = row_bytes + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    size = queries.agg(F.sum(row_bytes)).first()[0] or 0
    blocks = max(1, int(-(-size // broadcast_bytes)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    if blocks <= PASSES:
        context = queries.sparkSession.sparkContext
        corpus = corpus.coalesce(max(LEAST_TASKS, TASKS_PER_CORE * context.defaultParallelism))
        hits = None
        for number in range(blocks):
            part = queries.where(block == number) if blocks > 1 else queries
            found = corpus.mapInArrow(_narrow(context.broadcast(pack(part.toArrow())), search, k), HITS)
            hits = found if hits is None else hits.unionByName(found)
    else:
        slices = max(1, -(-corpus.count() // SLICE_ROWS))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows == 0 or right.num_rows == 0:
                return pa.Table.from_batches([], schema=pa.schema(
                    [("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))
            return pa.Table.from_batches([search(iter([right]), pack(left), k)])

        here = queries.withColumn("__block", block).withColumn(
            "__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
        )
        there = corpus.withColumn("__slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices))).withColumn(
            "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
        )
        cell = ["__block", "__slice"]
        hits = here.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(meet, HITS)
    return rank_hits(hits, k)
