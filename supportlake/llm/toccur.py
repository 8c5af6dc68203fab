"""Similarity join of word n-gram sets by T-occurrence search (DivideSkip).

Two sets of sizes x and y have a Jaccard similarity of at least P percent only if they share T = ceil(P (x + y) / (100 + P))
elements, so at least ceil(P x / 100). A query asks an inverted index for the sets that occur on T of its lists. DivideSkip
puts the longest lists aside, merges the others with a heap that skips what cannot reach the rest of T, and looks the
found sets up in the long lists by binary search, as long as T can still be reached.

Who meets whom is found by two cuts that lose no link (all orders below are global):

* Of each set only its smallest hashes are compared first, x - ceil(P x / 100) + t of them: linked sets share t or more of
  these. Their document frequencies are counted. A set with fewer than t that occur elsewhere has no link.
* Of those, by ascending frequency, all but the t - 1 most frequent are routes: linked sets share one.

Routes make families. On every route all sets meet its most central one (a star), in slices that are indexed and searched.
Sets on routes that still join different components are compared as a whole by the second cut: of their elements only those count that
sets of two components have, and a set that has fewer than ceil(P x / 100) of these has no link outside its component. The routes of the
others form families of sets; in each, those outside its largest component are indexed in slices and all others search them, by portions.
Tasks hold a slice and emit links only: no group is capped, and no pairs are written out.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.llm.components import connected_components
from supportlake.llm.minhash import shingles
from supportlake.llm.words import Words, list_column, slices
from supportlake.session import materialize

#: Sets that one task indexes at once, and sets that search them there.
SLICE_MEMBERS = 512
SLICE_QUERIES = 2048
#: Weight of a list's length in the choice of long lists, and t as a share (1 / TIMES) of a set.
MU, TIMES = 0.0085, 20


def lower_ascii(column: pa.Array) -> pa.Array:
    """A-Z in lower case, all other characters unchanged (``ascii_lower`` touches no byte of other characters)."""
    return pc.ascii_lower(column)


def sets_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the distinct k-word shingles of each document, ascending; fewer than k words are one element."""
    owner, values, _ = shingles(words, k)
    return values, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def least_overlap(size: int | np.ndarray, percent: int):
    """The fewest elements that a set shares with any set it is linked with."""
    return -(-percent * size // 100)


def is_linked(shared, x, y, percent: int):
    return 100 * shared >= percent * (x + y - shared)


class Index:
    """Inverted lists over the sets of one slice: list i of element ``vocabulary[i]`` has ascending numbers of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        who = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.postings = who[order]
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        self.vocabulary, self.offsets = flat[start], np.r_[start, len(flat)]
        rank = np.repeat(np.arange(len(start)), np.diff(self.offsets))
        self.places = rank * len(sets) + self.postings  # ascending, for binary search in any list

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that are linked with ``query`` (ascending elements)."""
        fewest = int(least_overlap(len(query), percent))
        if not len(self.vocabulary) or not len(query):
            return np.empty(0, np.int64)
        spot = np.minimum(np.searchsorted(self.vocabulary, query), len(self.vocabulary) - 1)
        lists = spot[self.vocabulary[spot] == query]
        if len(lists) < fewest:
            return np.empty(0, np.int64)
        length = self.offsets[lists + 1] - self.offsets[lists]
        lists = lists[np.argsort(length, kind="stable")]
        n_long = min(fewest - 1, int(fewest / (MU * math.log2(1 + int(length.max())) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, count = merge_skip([self.postings[self.offsets[i] : self.offsets[i + 1]].tolist() for i in short.tolist()], fewest - n_long)
        if not len(found):
            return found
        near = (100 * self.sizes[found] >= percent * len(query)) & (100 * len(query) >= percent * self.sizes[found])
        found, count = found[near], count[near]
        need = -(-percent * (len(query) + self.sizes[found]) // (100 + percent))
        # The long lists, the shortest of them first, in a few passes: sets that cannot reach T any more drop out.
        for begin in range(0, len(long), 64):
            open_ = np.flatnonzero(count + (len(long) - begin) >= need)
            found, count, need = found[open_], count[open_], need[open_]
            if not len(found):
                return found
            wanted = long[begin : begin + 64, None] * len(self.sizes) + found
            at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            count = count + (self.places[at] == wanted).sum(axis=0)
        return found[is_linked(count, len(query), self.sizes[found], percent)]


def merge_skip(lists: list[list[int]], times: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur on at least ``times`` of the ascending lists, and on how many, by a heap that skips.

    If the smallest number lies on fewer lists, ``times - 1`` lists in all leave the heap and go on where the new smallest one could be.
    """
    found, counts = [], []
    heap = [(values[0], i, 0) for i, values in enumerate(lists) if values]
    heapq.heapify(heap)
    while len(heap) >= times:
        least, out = heap[0][0], []
        while heap and heap[0][0] == least:
            out.append(heapq.heappop(heap))
        if len(out) >= times:
            found.append(least)
            counts.append(len(out))
            for _, i, at in out:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while heap and len(out) < times - 1:
            out.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, i, at in out:
            at = bisect.bisect_left(lists[i], goal, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


def sign(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, node, size, need, heads``: md5 of the text, size of its set, t, and its smallest elements (null without words)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, words in slices(lower_ascii(batch.column("text")), 1 << 20):
                values, cuts = sets_of(words, k)
                sizes = np.diff(cuts)
                fewest = least_overlap(sizes, percent)
                # A partner has at least ``fewest`` elements, so the share of t that both have is that of the smaller size.
                taken = sizes - fewest + -(-sizes // TIMES)
                inner = np.arange(len(values)) - np.repeat(cuts[:-1], sizes)
                heads = list_column(values[inner < np.repeat(taken, sizes)].view(np.int64), taken, pa.int64())
                worded = pa.array(sizes > 0)
                column = pc.if_else(worded, heads, pa.nulls(z - a, heads.type))
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("node"), pa.array(sizes, pa.int64()), pa.array(-(-fewest // TIMES), pa.int64()), column],
                    ["doc_id", "node", "size", "need", "heads"],
                )

    return given.mapInArrow(run, "doc_id long, node binary, size long, need long, heads array<long>")


def routes(nodes: DataFrame) -> DataFrame:
    """``route, id`` of ``id, need, heads`` and perhaps ``part``: the elements by which a set meets others, each on sets of two parts or more."""
    part = ["part"] if "part" in nodes.columns else []  # without it each set is a part
    entries = nodes.select("id", "need", *part, F.explode("heads").alias("route"))
    unlike = F.min("part") < F.max("part") if part else F.count("*") > 1
    often = entries.groupBy("route").agg(F.count("*").alias("n"), unlike.alias("unlike")).where("unlike").drop("unlike")
    shared = entries.select("id", "need", "route").join(often, "route")
    own = Window.partitionBy("id")
    ranked = shared.withColumn("r", F.row_number().over(own.orderBy("n", "route"))).withColumn("all", F.count("*").over(own))
    return ranked.where("r <= all - need + 1").select("route", "id")


def _by_group(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(group, slice, kind, node, part, set) of rows in their order."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "slice", "kind", "node", "part")]
        for start, end, words in slices(lower_ascii(batch.column("text")), 1 << 18):
            values, cuts = sets_of(words, k)
            for i in range(start, end):
                yield *(c[i] for c in columns), values[cuts[i - start] : cuts[i - start + 1]]


def search_slices(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links between indexed and searching sets of a slice, enough to join all that are linked.

    ``rows``: ``grp, slice, kind, node, part, text``, the slice a number or a struct of numbers; kind 0 is indexed, kind 1 searches. Sets of one ``part`` are joined already, and so are
    sets that a link has joined before in the task.
    """
    laid = rows.repartition("grp", "slice").sortWithinPartitions("grp", "slice", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, index, root = None, [], None, {}
        links: list[tuple] = []

        def top(part: bytes) -> bytes:
            while (above := root.get(part, part)) != part:
                root[part] = part = root.get(above, above)
            return part

        for group, piece, kind, node, part, own in _by_group(batches, k):
            if (group, piece) != at:
                at, members, index, root = (group, piece), [], None, {}
            if kind == 0:
                members.append((node, part, own))
                continue
            index = index or Index([m[2] for m in members])
            if not members:
                continue
            if len(members) > 1 and all(top(m[1]) == top(part) for m in members):
                continue
            for j in index.search(own, percent).tolist():
                other, there, _ = members[j]
                mine, theirs = top(part), top(there)
                if mine != theirs:
                    root[max(mine, theirs)] = min(mine, theirs)
                    links.append((node, other))
            if len(links) > 10_000:
                yield _links(links)
                links = []
        yield _links(links)

    return laid.mapInArrow(run, "a binary, b binary")


def _links(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])


def star_links(met: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs ``leader, node`` that are linked: a leader searches its slices of indexed nodes."""
    n_slices = F.ceil(F.col("n") / SLICE_MEMBERS).cast("int")
    leaders = met.groupBy("leader").agg(F.count("*").alias("n")).select("leader", n_slices.alias("n_slices"))
    piece = F.pmod(F.xxhash64("node"), F.col("n_slices")).cast("int")
    members = met.join(leaders, "leader").select(F.col("leader").alias("grp"), piece.alias("slice"), F.lit(0).alias("kind"), "node", F.col("node").alias("part"))
    asking = leaders.select(
        F.col("leader").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"), F.lit(1).alias("kind"),
        F.col("leader").alias("node"), F.col("leader").alias("part"),
    )
    return search_slices(members.unionByName(asking).join(texts, "node"), k, percent)


def whole_sets(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, part, id, need, heads`` of ``node, part, text``: all elements of a set, and how many it shares with any set it is linked with."""
    given = rows.select("node", "part", F.xxhash64("node").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, words in slices(lower_ascii(batch.column("text")), 1 << 20):
                values, cuts = sets_of(words, k)
                sizes = np.diff(cuts)
                need = pa.array(least_overlap(sizes, percent), pa.int64())
                heads = list_column(values.view(np.int64), sizes, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.slice(a, z - a).column(c) for c in ("node", "part", "id")), need, heads], ["node", "part", "id", "need", "heads"])

    return given.mapInArrow(run, "node binary, part binary, id long, need long, heads array<long>")


def unlike_routes(rows: DataFrame) -> DataFrame:
    """The rows of ``route, node, part`` whose route joins different parts."""
    unlike = rows.groupBy("route").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("route")
    return rows.join(unlike, "route")


def narrowed(open_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``route, node, part`` like ``open_rows``, by whole sets: linked sets of different parts that share a route there share one here.

    Only elements of two parts or more count. Sets that meet by a common passage, or by chance, have too few of them and are left out.
    """
    sets = materialize(whole_sets(open_rows.select("node", "part").distinct().join(texts, "node"), k, percent), "toccur-sets")
    met = routes(sets.select("id", "need", "heads", F.xxhash64("part").alias("part")))
    return materialize(unlike_routes(met.join(sets.select("id", "node", "part"), "id").select("route", "node", "part")), "toccur-narrowed")


def family_links(open_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links between different components that share a route. ``open_rows``: ``route, node, part``.

    Sets that are joined by routes are a family. Those outside its largest component are indexed, and every set of it searches them.
    """
    hub = open_rows.groupBy("route").agg(F.min("node").alias("hub"))
    ties = open_rows.join(hub, "route").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    families = connected_components(ties).withColumnRenamed("component", "grp")
    placed = materialize(open_rows.select("node", "part").distinct().join(families, "node"), "toccur-families")
    sizes = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("grp").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    n_slices = F.ceil((F.col("all") - F.col("most")) / SLICE_MEMBERS).cast("int")
    n_portions = F.ceil(F.col("all") / SLICE_QUERIES).cast("int")
    joined = placed.join(facts.select("grp", "main", n_slices.alias("n_slices"), n_portions.alias("n_portions")).where("n_slices > 0"), "grp")
    piece = F.pmod(F.xxhash64("node"), F.col("n_slices")).cast("int")
    portion = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_portions")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = joined.where("part <> main").select("grp", piece.alias("x"), every("n_portions").alias("y"), F.lit(0).alias("kind"), "node", "part")
    asking = joined.select("grp", every("n_slices").alias("x"), portion.alias("y"), F.lit(1).alias("kind"), "node", "part")
    rows = indexed.unionByName(asking).withColumn("slice", F.struct("x", "y")).drop("x", "y")
    return search_slices(rows.join(texts, "node"), k, percent)


def similarity_components(docs: DataFrame, percent: int = 85, k: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs`` (``doc_id, text``; other columns are ignored).

    A document is the set of its k-word shingles, of words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer words are one shingle.
    Documents are linked if 100 times the size of the intersection is at least ``percent`` times that of the union. ``component_id`` is the smallest
    id that links reach. Texts without words (null, empty, blank) have no shingles and no links: their component is their own id.
    Rows that repeat an id stay; with unlike texts they may be in unlike components. A null id is never the smallest one where there is another.
    An empty table gives no rows. Shingles are told by 64-bit hashes, texts by md5.
    """
    signed = materialize(sign(docs, k, percent), "toccur-signed")
    nodes = materialize(
        signed.where("heads is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("size").alias("size"), F.any_value("need").alias("need"), F.any_value("heads").alias("heads"))
        .withColumn("id", F.xxhash64("node")), "toccur-nodes",
    )
    # Rows carry 64-bit ids; two texts with one id would only both be compared.
    met = materialize(routes(nodes.select("id", "need", "heads")), "toccur-routes")
    counts = met.groupBy("route").agg(F.count("*").alias("n")).where("n > 1")
    crowd = materialize(met.join(counts, "route").join(nodes.select("id", "node", "size"), "id").select("route", "node", "size", "n"), "toccur-crowd")
    # The centre of a route is the set whose routes are the fullest: in a group of near copies one with few edits of its own.
    central = crowd.groupBy("node").agg(F.sum("n").alias("weight"))
    best = crowd.join(central, "node").groupBy("route").agg(F.max(F.struct("weight", "node", "size")).alias("top"))
    members = materialize(crowd.join(best.select("route", F.col("top.node").alias("leader"), F.col("top.size").alias("leader_size")), "route"), "toccur-members")

    firsts = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first_id")
    keyed = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = keyed.join(firsts, (keyed.node == firsts.node) & keyed.doc_id.eqNullSafe(firsts.first_id)).select(keyed.node, "text")
    texts = materialize(texts.groupBy("node").agg(F.max("text").alias("text")), "toccur-texts")

    # Sets of sizes that no link allows need not meet.
    near = F.greatest("size", "leader_size") * percent <= F.least("size", "leader_size") * 100
    pairs = members.where(near & (F.col("node") != F.col("leader"))).select("leader", "node").distinct()
    stars = materialize(star_links(pairs, texts, k, percent), "toccur-links")
    parts = connected_components(stars)
    placed = members.where("n > 2").join(parts, "node", "left").select("route", "node", F.coalesce("component", "node").alias("part"))
    more = materialize(family_links(narrowed(unlike_routes(placed), texts, k, percent), texts, k, percent), "toccur-more-links")
    # The new links join components of the stars: a small graph of its own.
    place = lambda df, end: df.join(parts.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = connected_components(place(place(more, "a"), "b").where("a <> b").distinct())
    first = place(nodes.select("node", "first_id", F.col("node").alias("part")), "part")
    whole = first.join(joined.withColumnRenamed("node", "part"), "part", "left").select("node", "first_id", F.coalesce("component", "part").alias("component"))
    classes = whole.groupBy("component").agg(F.min("first_id").alias("least"))
    named = whole.join(classes, "component").select("node", "least", F.lit(True).alias("worded"))
    out = signed.select("doc_id", "node", "size", F.col("heads").isNotNull().alias("worded")).join(named, ["node", "worded"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("worded"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
