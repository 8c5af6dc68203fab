"""Approximate search by product quantisation over cells, with exact re-scoring.

A vector is its cell and a code of a few bytes: the residual to the cell's centre, cut into sub-vectors, each replaced by the
number of its nearest of at most 256 codewords. The score of a row is the product of the query with the vector its code stands for: a block of
rows of a cell is decoded once and multiplied with all queries that probe the cell. Only the best rows by that score are looked up
in the table of full vectors and scored exactly.

How many cells are probed and how many rows are re-scored is measured when the index is built, against an exact search of a bounded
sample of its own rows, and stored with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.operators.retrieval import RECALL, _matrix, _pack_vectors, cell_count, dense_topk, vector_cells
from supportlake.operators.topk import BROADCAST_BYTES, SCORE_DIGITS, _Best, rank_hits, topk
from supportlake.session import materialize, run_dir

#: Components of a sub-vector, codewords, and rows they are fitted on (picked by hash; the bound of the fit).
SUB_WIDTH = 4
CODEWORDS = 256
FIT_ROWS = 1 << 16
#: Rows of the corpus on which probes and re-scored rows are measured, and most re-scored rows of a query.
MEASURE_ROWS = 256
MOST_RESCORED = 1000
#: Queries and rows that are scored at once.
SCORE_QUERIES, SCORE_ROWS = 1024, 4096
CODES = "chunk_id bigint, cell int, code binary"


@dataclass(frozen=True)
class PQIndex:
    """Paths of codes (by cell) and vectors (by hash of id), centres, codewords, and what was measured."""

    codes_path: str
    vectors_path: str
    centres: np.ndarray
    codewords: np.ndarray  # sub-vector x codeword x component
    n_rows: int
    n_probe: int = 0
    n_rescored: int = 0
    recall: float = 0.0

    def codes(self, spark) -> DataFrame:
        return spark.read.schema(CODES).parquet(self.codes_path)

    def vectors(self, spark) -> DataFrame:
        return spark.read.schema("chunk_id bigint, embedding array<float>").parquet(self.vectors_path)


def _padded(width: int) -> int:
    return -(-width // SUB_WIDTH) * SUB_WIDTH


def _residuals(vectors: np.ndarray, cells: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows x sub-vectors x components."""
    rest = vectors - centres[cells]
    rest = np.pad(rest, ((0, 0), (0, _padded(rest.shape[1]) - rest.shape[1])))
    return rest.reshape(len(rest), -1, SUB_WIDTH)


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * points @ words.T, axis=1)


def fit_codewords(points: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means of sub-vectors (a bounded sample); a word without points goes to the worst represented ones."""
    rng = np.random.default_rng(seed)
    words = points[rng.choice(len(points), min(n, len(points)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(points, words)
        held = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, points[:, j], len(words)) for j in range(points.shape[1])], axis=1)
        lost = np.flatnonzero(held == 0)
        far = np.argsort(-((points - words[own]) ** 2).sum(axis=1), kind="stable")[: len(lost)]
        words = sums / np.maximum(held, 1)[:, None]
        words[lost[: len(far)]] = points[far]
    return np.pad(words, ((0, n - len(words)), (0, 0)))


def _fit(cells: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Codewords of every sub-vector, fitted on FIT_ROWS rows at most, a task per sub-vector."""
    n_subs, width = _padded(centres.shape[1]) // SUB_WIDTH, centres.shape[1]
    sample = cells.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT_ROWS)
    spread = sample.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(n_subs - 1))))
    # Dealt by number, as a shuffle of so few bytes would otherwise be put together to one task that fits all of them.
    cut = spread.select("sub", "cell", "chunk_id", "embedding").repartition(n_subs, "sub")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        vectors, good = _matrix(table.column("embedding"), width)
        sub = table.column("sub")[0].as_py()
        points = _residuals(vectors, table.column("cell").to_numpy()[good], centres)[:, sub]
        words = fit_codewords(points, CODEWORDS) if len(points) else np.zeros((CODEWORDS, SUB_WIDTH))
        return pa.table({"sub": pa.array([sub], pa.int32()), "words": pa.array([words.ravel().tolist()], pa.list_(pa.float64()))})

    found = cut.groupBy("sub").applyInArrow(fit, "sub int, words array<double>").toArrow()  # one row per sub-vector
    words = np.zeros((n_subs, CODEWORDS, SUB_WIDTH))
    for sub, row in zip(found.column("sub").to_pylist(), found.column("words").to_pylist()):
        words[sub] = np.array(row).reshape(CODEWORDS, SUB_WIDTH)
    return words


def build_pq(chunks: DataFrame, n_lists: int | None = None, k: int = 10, recall: float = RECALL, seed: int = 7) -> PQIndex:
    """The stored index of ``chunks`` (``chunk_id`` unique bigint, ``embedding``, all of one width). NULL, empty and zero vectors are never found.

    Cells are fitted on all vectors and codewords on a bounded sample; every vector gets a code. Probes and re-scored rows are the fewest
    whose recall of the exact ``k`` neighbours of MEASURE_ROWS rows of the index reaches ``recall`` by three standard errors.
    """
    spark = chunks.sparkSession
    n_rows = chunks.count()
    cells, centres = vector_cells(chunks, n_lists or cell_count(n_rows), seed)
    words = _fit(cells, centres)
    width = centres.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, good = _matrix(batch.column("embedding"), width)
            cell = batch.column("cell").to_numpy()[good]
            rest = _residuals(vectors, cell, centres)
            code = np.stack([_nearest(rest[:, j], words[j]) for j in range(len(words))], axis=1).astype(np.uint8) if len(good) else np.empty((0, len(words)), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id").take(pa.array(good)), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary())],
                ["chunk_id", "cell", "code"],
            )

    index = PQIndex(run_dir(spark, "pq-codes"), run_dir(spark, "pq-vectors"), centres, words, n_rows)
    cells.mapInArrow(encode, CODES).write.partitionBy("cell").parquet(index.codes_path)
    cells.select("chunk_id", "embedding").repartition("chunk_id").sortWithinPartitions("chunk_id").write.parquet(index.vectors_path)
    return _measured(index, cells, k, recall)


def _measured(index: PQIndex, cells: DataFrame, k: int, recall: float) -> PQIndex:
    spark = cells.sparkSession
    rows = cells.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(MEASURE_ROWS)
    asked = materialize(rows.select(F.col("chunk_id").alias("query_id"), "embedding"), "pq-sample")
    exact = dense_topk(asked, cells, k + 1).where("query_id <> chunk_id").join(cells.select("chunk_id", "cell"), "chunk_id").select("query_id", "chunk_id", "cell")
    most = max(1, min(MOST_RESCORED, index.n_rows // 5))
    near = code_topk(asked, index, most, len(index.centres)).select("query_id", "chunk_id", F.col("rank").alias("place"))
    found = exact.join(near, ["query_id", "chunk_id"], "left").select("query_id", "cell", "place").toArrow()  # k rows of a query at most
    packed = _pack_vectors(asked.toArrow(), index.centres.shape[1])
    vectors, names = packed["groups"][0][2], packed["query_ids"]
    if not len(names) or not found.num_rows:
        return PQIndex(**{**index.__dict__, "n_probe": len(index.centres), "n_rescored": most})
    at = {int(q): i for i, q in enumerate(names)}
    query = np.array([at[q] for q in found.column("query_id").to_pylist()])
    order = np.argsort(np.argsort(-(vectors @ index.centres.T), axis=1, kind="stable"), axis=1)
    cell_place = order[query, found.column("cell").to_numpy()]
    row_place = found.column("place").fill_null(most + 1).to_numpy() if found.column("place").null_count else found.column("place").to_numpy()
    asked_of = np.bincount(query, minlength=len(names))

    def reached(hit: np.ndarray, goal: float) -> tuple[bool, float]:
        share = (np.bincount(query, hit, minlength=len(names)) / np.maximum(asked_of, 1))[asked_of > 0]
        return bool(share.mean() - 3 * share.std() / len(share) ** 0.5 >= goal), float(share.mean())

    # Half of the loss may come from cells that are not probed.
    n_probe = next((n for n in range(1, len(index.centres)) if reached(cell_place < n, (1 + recall) / 2)[0]), len(index.centres))
    inside = cell_place < n_probe
    n_rescored = next((n for n in range(k, most + 1) if reached(inside & (row_place <= n), recall)[0]), most)
    return PQIndex(**{**index.__dict__, "n_probe": n_probe, "n_rescored": n_rescored, "recall": reached(inside & (row_place <= n_rescored), 0.0)[1]})


def code_topk(queries: DataFrame, index: PQIndex, k: int, n_probe: int, **options) -> DataFrame:
    """The best rows by code score (query_id, chunk_id, score, rank) in each query's ``n_probe`` nearest cells; other cells are not read."""
    centres, words = index.centres, index.codewords
    width = centres.shape[1]

    def near(vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :n_probe]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _pack_vectors(pa.Table.from_batches([batch]), width)["groups"][0][2]
            if len(vectors):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(near(vectors)), pa.int32())], ["cell"])

    def pack(rows: pa.Table) -> dict:
        packed = _pack_vectors(rows, width)
        vectors = packed["groups"][0][2]
        probes = np.zeros((len(vectors), len(centres)), dtype=bool)
        if len(vectors):
            np.put_along_axis(probes, near(vectors), True, axis=1)
        return {"query_ids": packed["query_ids"], "vectors": vectors, "probes": probes}

    def search(tables: Iterator[pa.Table], packed: dict, k: int) -> pa.RecordBatch:
        best, vectors, probes = _Best(k, len(packed["query_ids"])), packed["vectors"], packed["probes"]
        for table in tables:
            order = np.argsort(table.column("cell").to_numpy(), kind="stable")
            for start in range(0, len(order), SCORE_ROWS):
                rows = table.take(pa.array(order[start : start + SCORE_ROWS]))
                ids, cell = rows.column("chunk_id").to_numpy(), rows.column("cell").to_numpy()
                decoded = decode(rows.column("code"), cell)
                cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)].tolist()
                for first in range(0, len(vectors), SCORE_QUERIES):
                    own, asked = probes[first : first + SCORE_QUERIES], vectors[first : first + SCORE_QUERIES]
                    matrix = np.full((len(own), len(cell)), -np.inf)
                    for low, high in zip(cuts[:-1], cuts[1:]):
                        who = np.flatnonzero(own[:, cell[low]])
                        matrix[who, low:high] = asked[who] @ decoded[low:high].T
                    best.add(ids, matrix, np.arange(first, first + len(own)))
        return best.batch(packed["query_ids"])

    def decode(codes: pa.ChunkedArray, cell: np.ndarray) -> np.ndarray:
        """The rows' centres plus the codewords they stand for: one product with these is the sum of a query's table entries."""
        code = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(cell), -1)
        rest = words[np.arange(len(words)), code].reshape(len(cell), -1)
        return centres[cell] + rest[:, :width]

    # A query has its vector, its probes and its best rows: the limit is that of all three.
    options.setdefault("broadcast_bytes", BROADCAST_BYTES * 8 * (width + 2) // (8 * (width + 2) + len(centres) + 16 * k))
    asked = queries.select("query_id", "embedding")
    stored = index.codes(queries.sparkSession)
    if n_probe < len(centres):
        wanted = [r.cell for r in asked.mapInArrow(probed, "cell int").distinct().collect()]  # at most one row per cell
        stored = stored.where(F.col("cell").isin(wanted))
    return topk(asked, stored, k, pack, None, search=search, **options)


def pq_search(queries: DataFrame, index: PQIndex, k: int, n_probe: int | None = None, n_rescored: int | None = None, **options) -> DataFrame:
    """Cosine top-k (query_id, chunk_id, score, rank): codes choose ``n_rescored`` rows of each query, whose vectors give exact scores."""
    spark = queries.sparkSession
    width = index.centres.shape[1]
    chosen = code_topk(queries, index, max(k, n_rescored or index.n_rescored), n_probe or index.n_probe, **options)
    own = queries.select("query_id", F.col("embedding").alias("asked"))
    pairs = chosen.select("query_id", "chunk_id").join(index.vectors(spark), "chunk_id").join(own, "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, _ = _matrix(part.column("embedding"), width)
                y, _ = _matrix(part.column("asked"), width)
                score = np.round((x * y).sum(axis=1), SCORE_DIGITS)
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("chunk_id"), pa.array(score)], ["query_id", "chunk_id", "score"])

    return rank_hits(pairs.select("query_id", "chunk_id", "embedding", "asked").mapInArrow(exact, "query_id bigint, chunk_id bigint, score double"), k)
