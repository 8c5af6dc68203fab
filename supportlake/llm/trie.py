"""Prefix trie of conversations, by double arrays per prefix shard.

A conversation is the path of its turns. Paths are cut into segments of at most SEGMENT turns; a segment is a path below the
node at which it begins, so a conversation of any length is many bounded rows. Segments are range-partitioned by where
they begin, their first turns and the conversation: a shard holds neighbours, and a common prefix is cut where a shard is
full. Each shard gives its turns dense ids, packs its nodes into BASE and CHECK arrays (the child of state s by turn c is
t = BASE[s] + c if CHECK[t] = s), sends its conversations through them and adds up counts per state and sums per subtree.

Nodes that lie in several shards, or above a segment that goes on elsewhere, are few: the upper nodes that shards share. They are
merged by key, get what their unshared children sum up to, and pass it on to all shared nodes above by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.session import materialize

#: Turns of a segment, and about as many turns as a shard holds.
SEGMENT = 256
SHARD_TURNS = 1 << 16
#: Turns that are numbered, and ending conversations that are listed, in one group.
BLOCK_BITS = 12
_WORDS = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.md5(b"").digest()
_NODE = (
    "key binary, parent_key binary, depth long, n long, conv long, words long, children long, leaves long, saved long, "
    "open_ boolean, ends boolean"
)


def number_turns(turns: DataFrame, *ties: str) -> DataFrame:
    """``turns`` with ``pos`` from 1: the order by ``turn`` in each ``conv_id``, a null first, turns of one number by ``ties``.

    ``turns``: ``conv_id, turn`` and the ties. Equal rows are counted before the shuffle. A conversation is numbered by blocks of turn numbers, and
    blocks' sizes, one row each, are carried forward; rows of one turn number are numbered in one group.
    """
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62)))
    counted = turns.groupBy("conv_id", "turn", *ties).agg(F.count("*").alias("m")).withColumn("block", block)
    order = [F.col("turn").asc_nulls_first(), *[F.col(t) for t in ties]]
    inner = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("conv_id", "block").agg(F.sum("m").alias("size"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(carried), F.lit(0)).alias("before"))
    placed = counted.withColumn("upto", F.sum("m").over(inner)).join(offsets, ["conv_id", "block"])
    last = F.col("before") + F.col("upto")
    return placed.select("conv_id", "turn", *ties, F.explode(F.sequence(last - F.col("m") + 1, last)).alias("pos"))


def segments(turns: DataFrame, conversations: DataFrame, size: int) -> DataFrame:
    """``conv_id, seg, root_key, next_key, last, keys, words``: a row per segment, and one without turns for other ``conversations``.

    A key of 16 bytes names the node at which a segment begins: a digest of the segments before it. ``next_key`` names the node
    where a full one ends.
    """
    turn_key = F.unhex(F.md5(F.concat_ws("", F.length("role"), F.lit(":"), "role", "text")))
    short = turns.select("conv_id", "turn", turn_key.alias("key"), F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"))
    placed = number_turns(short, "key", "words").withColumn("seg", F.expr(f"(pos - 1) div {size}"))
    listed = placed.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("turns"))
    rows = materialize(listed.select("conv_id", "seg", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words")), "trie-segments")
    own = F.md5(F.concat_ws("", F.transform("keys", lambda k: F.hex(k))))
    line = Window.partitionBy("conv_id").orderBy("seg")
    # Digests of the segments before, one row of each: only conversations of several segments need them.
    many = rows.where(f"seg > 0 or size(keys) = {size}").select("conv_id", "seg", own.alias("digest"))
    before = F.collect_list("digest").over(line.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.collect_list("digest").over(line.rowsBetween(Window.unboundedPreceding, 0))
    known = many.select(
        "conv_id", "seg", F.unhex(F.md5(F.array_join(before, ""))).alias("root_key"), F.unhex(F.md5(F.array_join(upto, ""))).alias("next_key"),
        F.lead("seg").over(line).isNull().alias("last"),
    )
    whole = rows.join(known, ["conv_id", "seg"], "left")
    paths = whole.select(
        "conv_id", "seg", F.when(F.col("seg") > 0, F.col("root_key")).otherwise(F.lit(ROOT)).alias("root_key"),
        F.when(F.size("keys") == size, F.col("next_key")).alias("next_key"), F.coalesce("last", F.lit(True)).alias("last"), "keys", "words",
    )
    silent = conversations.where("conv_id is not null").select("conv_id").distinct().join(rows.select("conv_id"), "conv_id", "left_anti")
    empty = silent.select(
        "conv_id", F.lit(0).cast("long").alias("seg"), F.lit(ROOT).alias("root_key"), F.lit(None).cast("binary").alias("next_key"),
        F.lit(True).alias("last"), F.array().cast("array<binary>").alias("keys"), F.array().cast("array<long>").alias("words"),
    )
    return paths.unionByName(empty)


class DoubleArray:
    """A trie over dense codes in two arrays: the child of state s by code c is t = base[s] + c, if check[t] = s. The root is state 0."""

    def __init__(self):
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = 1  # no slot below is free
        self.end = 1  # no slot from here on is taken

    def _hold(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _open_slots(self, n: int) -> np.ndarray:
        """The first n free slots."""
        self._hold(self.end + n)
        near = self.free + np.flatnonzero(self.check[self.free : min(self.free + 64 * n, self.end + n)] < 0)[:n]
        return near if len(near) == n else self.free + np.flatnonzero(self.check[self.free : self.end + n] < 0)[:n]

    def _take(self, state: int, base: int, codes: np.ndarray) -> None:
        self._hold(base + int(codes[-1]) + 1)
        self.base[state] = base
        self.check[base + codes] = state
        self.end = max(self.end, base + int(codes[-1]) + 1)

    def add(self, states: np.ndarray, codes: np.ndarray) -> None:
        """Children ``codes`` (unlike ones, ascending in each state) of ``states`` (sorted), which have none yet."""
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        sizes = np.diff(np.r_[first, len(states)])
        for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = codes[a : a + n]
            for slot in self._open_slots(16).tolist():
                spots = slot - own[0] + own
                if (self.check[spots[spots < self.end]] < 0).all():
                    break
            else:
                slot = self.end
            self._take(int(states[a]), slot - int(own[0]), own)
        single = first[sizes == 1]
        if len(single):  # any free slot does for an only child
            slots = self._open_slots(len(single))
            self.base[states[single]] = slots - codes[single]
            self.check[slots] = states[single]
            self.end = max(self.end, int(slots[-1]) + 1)
        taken = self.check[self.free : self.end] >= 0
        self.free = self.end if taken.all() else self.free + int(taken.argmin())

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes; -1 where there is none."""
        to = self.base[states] + codes
        there = (to > 0) & (to < len(self.check))
        to = np.where(there, to, 0)
        return np.where(there & (self.check[to] == states), to, -1)


def shard_nodes(seg, root_key, next_key, last, conv, keys: pa.Array, words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Node rows of one shard, and rows of conversations that end in it (``ends``). ``keys`` and ``words`` are those of all segments in a row."""
    coded = keys.dictionary_encode()
    codes, turn_keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    roots = {name: i for i, name in enumerate(dict.fromkeys(zip(seg.tolist(), root_key)))}
    start = np.array([roots[name] for name in zip(seg.tolist(), root_key)], dtype=np.int64) + len(turn_keys)
    order = np.argsort(-counts, kind="stable")  # the longest first: those that go on are a prefix
    begin = (np.cumsum(counts) - counts)[order]
    counts, start, conv, last, seg = counts[order], start[order], conv[order], last[order], seg[order]

    trie, width = DoubleArray(), len(turn_keys) + len(roots)
    state, levels, going = np.zeros(len(counts), dtype=np.int64), [], len(counts)
    final = np.zeros(len(counts), dtype=np.int64)
    depth = 0
    while going:
        at = begin[:going] + depth - 1
        code = start if depth == 0 else codes[at]
        edges, one, n = np.unique(state[:going] * width + code, return_index=True, return_counts=True)
        above, edge = edges // width, edges % width
        trie.add(above, edge)
        state[:going] = trie.step(state[:going], code)
        levels.append((trie.step(above, edge), above, one, n))
        final[:going] = state[:going]
        depth += 1
        going = int(np.searchsorted(-counts, -depth, side="right"))

    slots = len(trie.check)
    members, conv_least = np.zeros(slots, dtype=np.int64), np.full(slots, np.iinfo(np.int64).max)
    own_words, children = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    leaves, saved, open_ = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=bool)
    level_of = np.zeros(slots, dtype=np.int64)
    name: dict[int, bytes] = {}
    open_[final[~last]] = True
    np.minimum.at(conv_least, final, conv)
    out: list[tuple] = []
    for k, (to, above, one, n) in enumerate(levels):
        members[to], level_of[to] = n, k
        if k:
            own_words[to] = words[begin[one] + k - 1]
            np.add.at(children, above, 1)
        for i, (t, up, path) in enumerate(zip(to.tolist(), above.tolist(), one.tolist())):
            original = int(order[path])
            if k == 0:
                name[t] = root_key[original]
            elif next_key[original] is not None and k == counts[path]:
                name[t] = next_key[original]
            else:
                name[t] = hashlib.md5(name[up] + turn_keys[codes[begin[path] + k - 1]]).digest()
    for k in range(len(levels) - 1, -1, -1):
        to, above, one, n = levels[k]
        if k:
            saved[to] += (n - 1) * own_words[to]
        leaves[to] += (children[to] == 0) & ~open_[to]
        if k:
            np.add.at(leaves, above, leaves[to])
            np.add.at(saved, above, saved[to])
            np.minimum.at(conv_least, above, conv_least[to])
            open_[above[open_[to]]] = True
    shift = np.zeros(slots, dtype=np.int64)  # depth of the segment's beginning
    for k, (to, above, one, _) in enumerate(levels):
        shift[to] = seg[one]
        keep = to if k else to[seg[one] == 0]  # a later segment begins at a node that the one before it has
        parents = [name[u] if k else None for u in trie.check[keep].tolist()]
        out.append((keep, k, [name[t] for t in keep.tolist()], parents))
    columns: list[list] = [[] for _ in range(11)]
    for keep, k, names, parents in out:
        depths = shift[keep] * SEGMENT + k
        for column, values in zip(columns, (names, parents, depths, members[keep], conv_least[keep], own_words[keep], children[keep], leaves[keep], saved[keep], open_[keep])):
            column.extend(values if isinstance(values, list) else values.tolist())
        columns[10].extend([False] * len(keep))
    ending = np.flatnonzero(last)
    rows = len(ending)
    blank = [None] * rows
    for column, values in zip(columns, ([name[t] for t in final[ending].tolist()], blank, blank, blank, conv[ending].tolist(), blank, blank, blank, blank, blank, [True] * rows)):
        column.extend(values)
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in _NODE.split(", ")])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    column = {c: table.column(c).chunk(0) for c in table.column_names}
    lists = column["keys"]
    counts = np.diff(lists.offsets.to_numpy())
    yield shard_nodes(
        column["seg"].to_numpy(), column["root_key"].to_pylist(), column["next_key"].to_pylist(), column["last"].to_numpy(zero_copy_only=False),
        column["conv_id"].to_numpy(), lists.flatten(), column["words"].flatten().to_numpy(zero_copy_only=False), counts,
    )


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the lists of each key, which come in a row; a list is a block of ids in text."""
    key, digest, n = None, None, 0
    for batch in batches:
        done: list[tuple] = []
        for own, ids, size in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), batch.column("n_ends").to_pylist()):
            if own != key:
                if digest is not None:
                    done.append((key, n, digest.hexdigest()))
                key, digest, n = own, hashlib.sha256(ids.encode()), size
            else:
                digest.update(b"," + ids.encode())
                n += size
        yield _ends_batch(done)
    if digest is not None:
        yield _ends_batch([(key, n, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["key", "n_ends", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, n_ends, ends_sha256`` of (``key, conv``): sha256 of the ids, ascending and joined by commas.

    Ids are sorted and joined in blocks of at most 2**BLOCK_BITS ids; blocks, one row each, are hashed in their order, without being held. A
    digest is sequential, so the blocks of one node meet in one task.
    """
    blocks = ends.groupBy("key", F.shiftright("conv", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
    joined = blocks.select("key", "block", F.array_join(F.col("convs").cast("array<string>"), ",").alias("ids"), F.size("convs").cast("long").alias("n_ends"))
    return joined.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_hash_ends, "key binary, n_ends long, ends_sha256 string")


def _lift(shared: DataFrame) -> DataFrame:
    """``key, leaves, saved`` summed over all shared nodes at and below each: after k steps, over those less than 2**k below.

    ``shared``: ``key, parent_key, depth, leaves, saved`` of nodes whose parents are shared too.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    now = shared.select("key", F.col("parent_key").alias("jump"), "leaves", "saved")
    for _ in range(int(deepest).bit_length()):
        below = now.where("jump is not null").groupBy("jump").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = now.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        stepped = now.join(below.withColumnRenamed("jump", "key"), "key", "left").join(far, "jump", "left")
        now = materialize(stepped.select(
            "key", F.col("next").alias("jump"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ), "trie-lift")
    return now.select("key", "leaves", "saved")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie of conversations.

    ``turns``: ``conv_id long, turn long, role string, text string``; ``conversations``: ``conv_id`` of conversations that may have no
    turns. A conversation is its turns by number, a null number first; turns of one number are ordered by a hash of role and text, repeated rows are
    turns of their own. A null role or text is empty. Rows without ``conv_id`` take no part, other columns are ignored. No conversations give no rows.

    Columns: ``key`` (16 bytes, equal prefixes have equal keys), ``parent_key`` (root: null), ``depth``, ``conv_id`` (smallest
    member; the node's last turn is that conversation's turn ``depth``), ``parent_conv_id``, ``n_convs``, ``n_words`` (of the last text),
    ``n_children``, ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (over its subtree, (n_convs - 1) * n_words),
    ``n_ends`` (conversations that end here) and ``ends_sha256`` (of their ids, ascending, joined by commas). Equal turns are told by md5.
    """
    given = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    others = given if conversations is None else conversations
    paths = materialize(segments(given, others.select(F.col("conv_id").cast("long").alias("conv_id")), SEGMENT), "trie-paths")
    n_turns, n_rows = paths.agg(F.sum(F.size("keys")), F.count("*")).first()
    n_shards = 1 + ((n_turns or 0) + n_rows) // SHARD_TURNS
    first = [F.get("keys", F.lit(i)) for i in range(4)]
    laid = paths.repartitionByRange(n_shards, "seg", "root_key", *first, "conv_id").sortWithinPartitions("seg", "root_key", *first, "conv_id")
    made = materialize(laid.mapInArrow(_build, _NODE), "trie-shards")

    facts = made.where("not ends").groupBy("key").agg(
        F.any_value("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"),
        F.any_value("words").alias("n_words"), F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), ((F.count("*") > 1) | F.max("open_")).alias("shared"),
    )
    nodes = materialize(facts, "trie-nodes")
    upper = nodes.where("shared")
    # Children are added up by parent before the join, so that a node of very many children is a row per task.
    below = nodes.where("parent_key is not null").groupBy("parent_key").agg(
        F.count("*").alias("n_children"), F.sum(F.when(~F.col("shared"), F.col("leaves"))).alias("leaves"),
        F.sum(F.when(~F.col("shared"), F.col("saved"))).alias("saved"),
    )
    joined = upper.drop("n_children", "leaves", "saved").join(below.withColumnRenamed("parent_key", "key"), "key", "left")
    own_leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0)
    own_saved = (F.col("n_convs") - 1) * F.col("n_words")
    ready = materialize(joined.select(
        "key", "parent_key", "depth", "n_convs", "conv_id", "n_words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + own_leaf).alias("leaves"), (F.coalesce("saved", F.lit(0)) + own_saved).alias("saved"),
    ), "trie-shared")
    lifted = ready.drop("leaves", "saved").join(_lift(ready), "key")
    whole = nodes.where("not shared").drop("shared").unionByName(lifted)
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(made.where("ends").select("key", "conv"))
    out = whole.join(parents, "parent_key", "left").join(ends, "key", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_words", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
