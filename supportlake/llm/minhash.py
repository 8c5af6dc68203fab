"""Near-duplicates by ProbMinHash signatures, banding and verification.

A text is its weighted word shingles (weight: number of occurrences). Its signature has ``bands * rows`` registers. Each
shingle is a Poisson process whose rate is its share of the text's weight; an arrival falls into a random register, and
the first arrival of a register gives its value, the shingle. Arrivals of a shingle depend on the shingle alone, so two
texts agree in a register with the probability Jaccard similarity. A shingle stops at its first arrival later than the
first arrivals of all registers (early termination).

Equal texts are one node. Texts that agree in all registers of a band share a bucket. In a bucket every text is compared
with the most central one. Where a bucket's texts are still in different components, those outside its largest one are
compared with all others, inside tasks that hold a bounded slice and emit links only: no bucket is capped, no pairs are
written out, and no link that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.components import connected_components
from supportlake.llm.words import Words, grams, inside, list_column, mix, slices
from supportlake.session import materialize

#: Members that one task compares with one leader.
SLICE_MEMBERS = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, occurrences), ordered by document; a text of fewer than k words is one shingle, without words none."""
    hashes, first, counts = words.hashes, words.first, words.counts
    keep = np.flatnonzero(inside(first, k))
    owner, values = words.owner()[keep], grams(hashes, k)[keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = counts[short].astype(np.uint64)
        for j in range(k - 1):
            at = np.minimum(first[short] + j, len(hashes) - 1)
            whole = mix(whole * _GOLDEN + np.where(j < counts[short], hashes[at], np.uint64(0)))
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    start = np.flatnonzero(fresh)
    return owner[start], values[start], np.diff(np.append(start, len(owner)))


def signatures(owner: np.ndarray, values: np.ndarray, weights: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """``n_docs x size`` registers: the shingle of the first arrival in each. Documents without a shingle stay 0."""
    first = np.full(n_docs * size, np.inf)
    held = np.zeros(n_docs * size, dtype=np.uint64)
    if not len(owner):
        return held.reshape(n_docs, size)
    number = np.bincount(owner, minlength=n_docs)
    rate = weights / np.bincount(owner, weights=weights, minlength=n_docs)[owner]
    # Arrivals of a shingle come in runs; a text of few shingles needs many from each.
    run = np.clip(np.ceil(2.0 * size / np.maximum(number, 1)), 1, 256).astype(np.int64)
    live, clock, step = np.arange(len(owner)), np.zeros(len(owner)), np.zeros(len(owner), dtype=np.int64)
    while len(live):
        doc = owner[live]
        n = run[doc]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        seed = np.repeat(values[live], n) + (np.repeat(step[live], n) + inner + 1).astype(np.uint64) * _GOLDEN
        draw = mix(seed)
        wait = -np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / np.repeat(rate[live], n)
        total = np.cumsum(wait)
        base = total[begin] - wait[begin]
        arrival = total - np.repeat(base, n) + np.repeat(clock[live], n)
        register = ((mix(draw ^ _GOLDEN) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        slot = np.repeat(doc * size, n) + register
        at = np.flatnonzero(arrival < first[slot])
        slot, arrival_in = slot[at], arrival[at]
        np.minimum.at(first, slot, arrival_in)
        won = first[slot] == arrival_in
        held[slot[won]] = np.repeat(values[live], n)[at[won]]
        latest = first.reshape(n_docs, size).max(axis=1)
        ends = begin + n - 1
        clock[live], step[live] = arrival[ends], step[live] + n
        live = live[arrival[ends] < latest[doc]]
    return held.reshape(n_docs, size)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, mixed with the band's number."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(registers), bands)).copy()
    cut = registers.reshape(len(registers), bands, rows)
    for j in range(rows):
        key = mix(key * np.uint64(0xBF58476D1CE4E5B9) + cut[:, :, j])
    return key


def probability_jaccard(values_x, weights_x, values_y, weights_y) -> float:
    """Exact probability Jaccard similarity of two weighted sets (values sorted)."""
    if not len(values_x) or not len(values_y):
        return 0.0
    both, in_x, in_y = np.intersect1d(values_x, values_y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = weights_x / weights_x.sum(), weights_y / weights_y.sum()
    sx, sy = x[in_x], y[in_y]
    # Sum over all j of max(x_j / x_i, y_j / y_i), by the order of the ratios x / y.
    order = np.argsort(sx / sy, kind="stable")
    sx, sy = sx[order], sy[order]
    ratio = sx / sy
    last = np.searchsorted(ratio, ratio, side="right")
    up_to_y = np.cumsum(sy)[last - 1]
    beyond_x = sx.sum() - np.cumsum(sx)[last - 1]
    only_x, only_y = 1.0 - sx.sum(), 1.0 - sy.sum()
    return float((1.0 / ((beyond_x + only_x) / sx + (up_to_y + only_y) / sy)).sum())


def sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, node, keys``: node is the md5 of the text, keys the band keys (null without words)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, words in slices(batch.column("text"), 1 << 20):
                owner, values, counts = shingles(words, k)
                keys = band_keys(signatures(owner, values, counts.astype(float), z - a, bands * rows), bands, rows)
                filled = list_column(keys.ravel().view(np.int64), np.full(z - a, bands), pa.int64())
                column = pc.if_else(pa.array(words.counts > 0), filled, pa.nulls(z - a, filled.type))
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), column], ["doc_id", "node", "keys"])

    return given.mapInArrow(run, "doc_id long, node binary, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs (``a, b``) whose texts are at least ``threshold`` alike. ``texts``: ``node, text``."""
    leaders = pairs.groupBy("a").agg(F.count("*").alias("n"))
    n_slices = F.ceil(F.col("n") / SLICE_MEMBERS).cast("int")
    sized = leaders.select("a", n_slices.alias("n_slices"))
    salt = F.pmod(F.xxhash64("b"), F.col("n_slices")).cast("int")
    members = pairs.join(sized, "a").select("a", "b", salt.alias("slice"))
    right = members.join(texts.withColumnRenamed("node", "b"), "b").select("a", "slice", "b", "text")
    left = sized.join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"), F.lit(None).cast("binary").alias("b"), "text"
    )
    laid = left.unionByName(right).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            found: list[tuple] = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for start, end, words in slices(batch.column("text")):
                owner, values, counts = shingles(words, k)
                cuts = np.searchsorted(owner, np.arange(end - start + 1))
                for i in range(end - start):
                    own = values[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]].astype(float)
                    if b[start + i] is None:
                        leader = own
                        continue
                    alike = probability_jaccard(*leader, *own)
                    if alike >= threshold - 1e-12:
                        found.append((a[start + i], b[start + i], alike))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found])],
                    ["a", "b", "similarity"],
                )

    return laid.mapInArrow(run, "a binary, b binary, similarity double")


class Bucket:
    """Texts of one bucket that are compared with each other in one task: a slice of outer texts and those that pass by.

    Outer texts are those outside the bucket's largest component. Links found join components here too, so a pair of texts
    that is connected already is not compared again.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rows: list[tuple] = []  # (node, keys, shingles, shares) of the slice
        self.root: dict[bytes, bytes] = {}

    def top(self, part: bytes) -> bytes:
        while (above := self.root.get(part, part)) != part:
            part = above
        return part

    def meet(self, nodes: list[bytes], parts: list[bytes], keys: np.ndarray, held: list[np.ndarray], counts: list[np.ndarray], band: int):
        """Links (outer node, node) between the slice and a batch of texts."""
        sizes = np.array([len(h) for h in held])
        begin = np.cumsum(sizes) - sizes
        flat = np.concatenate(held)
        share = np.concatenate(counts) / np.repeat([c.sum() for c in counts], sizes)
        plain = np.array([c.max() == 1 for c in counts])
        tops = np.array([self.top(p) for p in parts], dtype=object)
        links = []
        for node, part, own_keys, own, own_counts in self.rows:
            # Not the same component, and no band before this one in common: each pair is compared in one bucket only.
            go = np.flatnonzero((tops != self.top(part)) & ~(keys[:, :band] == own_keys[:band]).any(axis=1))
            if not len(go):
                continue
            n = sizes[go]
            at = np.repeat(begin[go] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            spot = np.minimum(np.searchsorted(own, flat[at]), len(own) - 1)
            common = own[spot] == flat[at]
            cuts = np.cumsum(n) - n
            c = np.add.reduceat(common.astype(np.int64), cuts)
            jaccard = c / (len(own) + n - c)
            simple = plain[go] & (own_counts.max() == 1)  # sets: the two similarities are one
            # Else the similarity is at most the common part of either text's weight.
            own_share = own_counts / own_counts.sum()
            bound = np.minimum(np.add.reduceat(common * share[at], cuts), np.add.reduceat(common * own_share[spot], cuts))
            for i in np.flatnonzero(np.where(simple, jaccard, bound) >= self.threshold - 1e-12).tolist():
                j = int(go[i])
                mine, theirs = self.top(part), self.top(parts[j])
                if mine == theirs:
                    continue
                if not simple[i] and probability_jaccard(own, own_counts.astype(float), held[j], counts[j].astype(float)) < self.threshold - 1e-12:
                    continue
                links.append((node, nodes[j]))
                self.root[max(mine, theirs)] = min(mine, theirs)
                tops = np.array([self.top(p) for p in parts], dtype=object)
        return links


def link_rest(open_rows: DataFrame, texts: DataFrame, keys: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b``: links between different components of a bucket, enough of them to join all that are linked there.

    ``open_rows``: ``key, band, node, part`` of buckets with several components; ``texts``: ``node, text``; ``keys``: ``node, keys``.
    Every text outside the largest component of its bucket is compared with every text of other components in it, unless
    they were joined meanwhile, inside tasks that hold SLICE_MEMBERS such texts and let the bucket pass by. No pairs are emitted but links.
    """
    sizes = open_rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    n_slices = F.ceil((F.col("all") - F.col("most")) / SLICE_MEMBERS).cast("int")
    facts = materialize(facts.select("key", "main", n_slices.alias("n_slices")), "minhash-facts")
    joined = open_rows.join(facts, "key").withColumn("outer", F.col("part") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.col("n_slices")).cast("int")
    held = joined.where("outer").select("key", "band", "node", "part", own.alias("slice"), F.lit(0).alias("kind"))
    passing = joined.select("key", "band", "node", "part", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"), F.lit(1).alias("kind"))
    rows = held.unionByName(passing).join(texts, "node").join(keys, "node")
    laid = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for batch in batches:
            links: list[tuple] = []
            where = list(zip(batch.column("key").to_pylist(), batch.column("slice").to_pylist()))
            kinds, bands = batch.column("kind").to_pylist(), batch.column("band").to_pylist()
            nodes, parts = batch.column("node").to_pylist(), batch.column("part").to_pylist()
            for start, end, words in slices(batch.column("text"), 1 << 20):
                owner, values, counts = shingles(words, k)
                cuts = np.searchsorted(owner, np.arange(end - start + 1))
                all_keys = batch.column("keys").slice(start, end - start).flatten().to_numpy().reshape(end - start, -1)
                i = start
                while i < end:
                    j = i + 1
                    while j < end and where[j] == where[i] and kinds[j] == kinds[i]:
                        j += 1
                    if where[i] != at:
                        at, bucket = where[i], Bucket(threshold)
                    sets = [values[cuts[r - start] : cuts[r - start + 1]] for r in range(i, j)]
                    times = [counts[cuts[r - start] : cuts[r - start + 1]] for r in range(i, j)]
                    if kinds[i] == 0:
                        bucket.rows += zip(nodes[i:j], parts[i:j], all_keys[i - start : j - start], sets, times)
                    else:
                        links += bucket.meet(nodes[i:j], parts[i:j], all_keys[i - start : j - start], sets, times, bands[i])
                    i = j
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

    return laid.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 28, rows: int = 5) -> DataFrame:
    """``doc_id, class_id, node, component, worded``: one row per row of ``docs``; the class is named by its smallest id.

    A class is a component of texts linked by a verified probability Jaccard similarity of at least ``threshold``, with
    equal texts in one class. Two texts at the threshold 0.8 meet in some band with probability above 0.99998. Texts
    without a word (null, empty, blank) are never duplicates: their class is their own id. Rows that repeat an id stay.
    Null ids are smallest only where a class has no other. An empty table gives no rows. ``node`` is the text's md5, ``component`` the least
    of the class (null without a word), which tells classes apart where ids repeat.
    """
    signed = materialize(sign(docs, k, bands, rows), "minhash-signed")
    nodes = signed.where("keys is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("keys").alias("keys"))
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = materialize(entries.join(buckets, "key").select("key", "band", "node", "n"), "minhash-entries")
    # The leader of a bucket is the text whose buckets are the fullest: in a group of near copies one with few edits of its own, which is near to most.
    central = crowd.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = crowd.join(central, "node")
    best = ranked.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"))
    members = materialize(crowd.join(best, "key"), "minhash-buckets")

    wanted = members.select("node").distinct()
    unique = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "doc_id", "text")
    firsts = nodes.select("node", "first_id").join(wanted, "node", "left_semi")
    texts = unique.join(firsts, (unique.node == firsts.node) & unique.doc_id.eqNullSafe(firsts.first_id)).select(unique.node, "text")
    texts = materialize(texts.groupBy("node").agg(F.max("text").alias("text")), "minhash-texts")

    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(verify(pairs, texts, k, threshold).select("a", "b"), "minhash-links")
    parts = connected_components(stars)
    # Buckets of two are done, and so is every leader.
    rest = members.where("n > 2 and node <> leader").select("key", "band", "node")
    placed = rest.join(parts, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("part"))
    open_keys = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    open_rows = materialize(placed.join(open_keys, "key"), "minhash-open")
    more = materialize(link_rest(open_rows, texts, nodes.select("node", "keys"), k, threshold), "minhash-more-links")
    parts = connected_components(stars.unionByName(more))
    named = nodes.select("node", "first_id").join(parts, "node", "left")
    whole = named.select("node", "first_id", F.coalesce("component", "node").alias("component"))
    classes = whole.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_node = whole.join(classes, "component").select("node", "component", "class_id", F.lit(True).alias("worded"))
    out = signed.select("doc_id", "node", F.col("keys").isNotNull().alias("worded")).join(by_node, ["node", "worded"], "left")
    return out.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "node", "component", "worded")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one row with the smallest id, and every text without words.

    ``classes`` comes from ``near_duplicates``. Columns of ``docs`` stay; repeated rows of the chosen text are one row. Columns named ``keep_id``, ``keep_node``, ``keep_key`` go.
    """
    chosen = classes.where("worded and doc_id <=> class_id").groupBy("component").agg(
        F.min("node").alias("keep_node"), F.min("class_id").alias("keep_id")
    ).drop("component")
    docs = docs.drop("keep_id", "keep_node", "keep_key")
    keyed = docs.withColumn("keep_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.where(worded).join(chosen, (F.col("keep_key") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = kept.drop("keep_node", "keep_id").dropDuplicates(["keep_key"])
    return kept.unionByName(keyed.where(~worded)).drop("keep_key")
