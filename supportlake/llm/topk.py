"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are small integers per dimension. Rows are ordered by a sign signature, cut into shards and, inside a shard, into
blocks of consecutive rows. A block keeps the largest and the smallest value of every dimension; the sum over dimensions
of the better of the two products is a bound on every score in the block. A query visits blocks in descending order of
bounds, scores a block through its forward index (the matrix of its rows) and stops at the first bound that cannot reach
its k-th result. Every query first visits the shard it was dealt to; its k-th score there prunes whole other shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.session import materialize

#: Most shards; shards grow beyond. So the bounds of all shards (two vectors each) have a fixed size.
MAX_SHARDS = 4096
SHARD_ROWS = 8192
BLOCK_ROWS = 128
#: Queries scored at once, and queries of one shard that one task gets.
BATCH = 512
SLICE_QUERIES = 1 << 15
SIGN_BITS = 16


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * component) per component, as doubles with whole values.

    Rows with a null id, a null vector, no component or a null or non-finite component take no part.
    """
    parts = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    bad = F.exists(
        F.col(vector_column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    )
    usable = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & ~bad
    return vectors.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), parts.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), width)


def _signature(width: int, bits: int) -> np.ndarray:
    return np.random.default_rng(width).standard_normal((width, bits))


def with_signature(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``code``: signs of fixed random projections; near vectors share leading bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _signature(width, SIGN_BITS)
        for batch in batches:
            values = matrix(batch.column("v"), width)
            norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
            bits = np.round(values / np.maximum(norms, 1e-300) @ planes, 6) > 0
            code = bits @ (1 << np.arange(SIGN_BITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], [*batch.schema.names, "code"])

    return rows.mapInArrow(sign, "vec_id long, row long, v array<double>, is_query boolean, code long")


class Shard:
    """Blocks of one shard: bounds, forward indexes and ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        """``rows`` tells rows apart that share an id."""
        n = len(ids)
        self.rows = rows
        self.ids = np.sort(ids, kind="stable")  # by id: a row's place stands for its id where scores are equal
        self.place = np.empty(n, dtype=np.int64)
        self.place[np.argsort(ids, kind="stable")] = np.arange(n)
        self.row_ids = ids
        self.cuts = np.arange(0, n, BLOCK_ROWS)
        self.values = values
        self.high = np.maximum.reduceat(values, self.cuts, axis=0)
        self.low = np.minimum.reduceat(values, self.cuts, axis=0)
        self.least = np.minimum.reduceat(ids, self.cuts)

    def search(self, own: np.ndarray, own_row: np.ndarray, queries: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int):
        """(query, id, score) of each query's k best rows that beat its floor (score, then smaller id); its own row is none of them."""
        n = len(self.ids)
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = np.full((len(queries), k), -1, dtype=np.int64)  # places of rows
        score = np.full((len(queries), k), -np.inf)
        floor, floor_id = floor.copy(), floor_id.copy()
        live = np.arange(len(queries))
        for step in range(len(self.cuts)):
            block = order[live, step]
            bound = bounds[live, block]
            live, block = live[bound >= floor[live]], block[bound >= floor[live]]  # bounds descend: the rest is below too
            if not len(live):
                break
            # At an equal bound only a smaller id could still enter.
            chance = (bounds[live, block] > floor[live]) | (self.least[block] <= floor_id[live])
            rows, blocks = live[chance], block[chance]
            by_block = np.argsort(blocks, kind="stable")
            rows, blocks = rows[by_block], blocks[by_block]
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(blocks)) + 1):
                if not len(part):
                    continue
                q, a = rows[part], self.cuts[blocks[part[0]]]
                z = min(a + BLOCK_ROWS, n)
                got = queries[q] @ self.values[a:z].T
                ids = self.row_ids[a:z]
                keep = (got > floor[q, None]) | ((got == floor[q, None]) & (ids[None, :] <= floor_id[q, None]))
                keep &= (ids[None, :] != own[q, None]) | (self.rows[None, a:z] != own_row[q, None])
                some = np.flatnonzero(keep.any(axis=1))
                if not len(some):
                    continue
                q = q[some]
                fresh = np.where(keep[some], got[some], -np.inf)
                places = np.broadcast_to(self.place[a:z], fresh.shape)
                both, where = np.hstack([score[q], fresh]), np.hstack([best[q], places])
                top = np.lexsort((where, -both), axis=1)[:, :k]
                score[q], best[q] = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)
                full = score[q, -1] > -np.inf
                floor[q[full]] = score[q[full], -1]
                floor_id[q[full]] = self.ids[best[q[full], -1]]
        at, rank = np.nonzero(score > -np.inf)
        return at, self.ids[best[at, rank]], score[at, rank].astype(np.int64)


_OUT = "query_id long, query_row long, vec_id long, score long"
_FIELDS = pa.schema([(name, pa.int64()) for name in ("query_id", "query_row", "vec_id", "score")])


def _hits(shard: Shard, ids, rows, values, floor, floor_id, k) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), BATCH):
        part = slice(at, at + BATCH)
        query, found, score = shard.search(ids[part], rows[part], values[part], floor[part], floor_id[part], k)
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids[part][query], rows[part][query], found, score)], schema=_FIELDS
            )


def top_k(
    vectors: DataFrame, is_query: Column, k: int, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding", width: int = 64
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row that is a query, ties to the smaller id.

    The score is the inner product of the quantized vectors, exact while it is below 2**53. Vectors of another than the given
    ``width`` take no part. Rows that repeat an id with another vector are rows of their own, as queries and as candidates (a query that repeats
    its id gives k hits for each of its vectors); rows that repeat id and quantized vector are one. Fewer than k other rows give all of them; an
    empty table gives no rows.
    ``is_query`` is evaluated on the column ``vec_id``.
    """
    usable = quantized(vectors, id_column, vector_column, scale).where(F.size("v") == width)
    rows = usable.distinct().withColumn("row", F.xxhash64("v")).select("vec_id", "row", "v")
    rows = materialize(rows.withColumn("is_query", is_query), "topk-rows")
    facts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_shards = max(1, min(MAX_SHARDS, -(-facts.n // SHARD_ROWS)))
    coded = with_signature(rows, width)
    # Rows with one and the same vector are split between shards too: the id is part of the order.
    dealt = coded.repartitionByRange(n_shards, "code", "vec_id", "row").withColumn("shard", F.spark_partition_id())
    index = materialize(dealt, "topk-index")

    low = F.array(*[F.min(F.col("v")[i]) for i in range(width)])
    high = F.array(*[F.max(F.col("v")[i]) for i in range(width)])
    shards = index.groupBy("shard").agg(low.alias("low"), high.alias("high"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    summary = sorted(shards.collect(), key=lambda r: r.shard)  # at most MAX_SHARDS rows of fixed width

    queries = index.where("is_query").select("vec_id", "row", "v", "shard")
    n_slices = max(1, -(-facts.q // SLICE_QUERIES))

    def meet(pairs: DataFrame) -> DataFrame:
        """Hits of queries (``vec_id, row, v, shard, floor, floor_id``) in the shards they were sent to."""
        task = lambda c: F.pmod(F.xxhash64(c), F.lit(n_slices)).cast("int")
        asked = pairs.select("shard", task("vec_id").alias("slice"), F.lit(1).alias("kind"), "vec_id", "row", "v", "floor", "floor_id")
        forward = index.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), F.lit(0).alias("kind"), "vec_id", "row", "v",
            F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("floor_id"), "code",
        )
        both = forward.unionByName(asked.withColumn("code", F.lit(0).cast("long")))
        laid = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind", "code", "vec_id", "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, shard, held = None, None, []
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "slice", "kind")], axis=1)
                cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
                for a, z in zip(cuts, cuts[1:]):
                    if a == z:
                        continue
                    part, key = batch.slice(a, z - a), tuple(keys[a][:2])
                    if key != at:
                        at, shard, held = key, None, []
                    own = part.column("vec_id").to_numpy(), part.column("row").to_numpy(), matrix(part.column("v"), width)
                    if not keys[a][2]:
                        held.append(own)
                        continue
                    if shard is None:
                        shard = Shard(*[np.concatenate(x) for x in zip(*held)])
                        held = []
                    yield from _hits(shard, *own, part.column("floor").to_numpy(), part.column("floor_id").to_numpy(), k)

        return laid.mapInArrow(run, _OUT)

    open_floor = [F.lit(float("-inf")).alias("floor"), F.lit(2**63 - 1).cast("long").alias("floor_id")]
    home = materialize(meet(queries.select("vec_id", "row", "v", "shard", *open_floor)), "topk-home")
    if len(summary) > 1:
        place = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
        kth = home.withColumn("r", F.row_number().over(place)).where(F.col("r") == k)
        floors = kth.select(F.col("query_id").alias("vec_id"), F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"), F.col("vec_id").alias("floor_id"))
        known = queries.join(floors, ["vec_id", "row"], "left").select(
            "vec_id", "row", "v", "shard", F.coalesce("floor", open_floor[0]).alias("floor"), F.coalesce("floor_id", open_floor[1]).alias("floor_id")
        )
        numbers = np.array([r.shard for r in summary])
        highs, lows = np.array([r.high for r in summary]), np.array([r.low for r in summary])
        least = np.array([r.least for r in summary])

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), BATCH):
                    part = batch.slice(a, BATCH)
                    values, floor = matrix(part.column("v"), width), part.column("floor").to_numpy()[:, None]
                    bound = np.maximum(values, 0) @ highs.T + np.minimum(values, 0) @ lows.T
                    go = (bound > floor) | ((bound == floor) & (least[None, :] <= part.column("floor_id").to_numpy()[:, None]))
                    go &= numbers[None, :] != part.column("shard").to_numpy()[:, None]
                    query, shard = np.nonzero(go)
                    if len(query):
                        sent = part.take(pa.array(query))
                        yield pa.RecordBatch.from_arrays(
                            [sent.column("vec_id"), sent.column("row"), sent.column("v"), pa.array(numbers[shard], pa.int32()), sent.column("floor"), sent.column("floor_id")],
                            ["vec_id", "row", "v", "shard", "floor", "floor_id"],
                        )

        away = meet(known.mapInArrow(route, "vec_id long, row long, v array<double>, shard int, floor double, floor_id long"))
        hits = home.unionByName(away)
    else:
        hits = home
    place = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
