"""Prefix trie of conversations against brute force, with small segments and shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from supportlake.llm import queries, trie
from tests.llm.common import WORD

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_nodes(paths):
    """Rows of the contract for {conv_id: [(role, text), ...]}, by prefix."""
    members, kids, ends = {}, {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(path[: d - 1]), set()).add(tuple(path[:d]))
        ends.setdefault(tuple(path), []).append(c)
    sums = {p: [0, 0] for p in members}
    for p, m in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += p not in kids
            sums[p[:d]][1] += (len(m) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), *sums[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def as_rows(nodes):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def talk(rng, n_convs, n_turns, longest=9):
    paths = {}
    for c in range(n_convs):
        path = list(rng.choice(list(paths.values()) or [[]]))[: rng.randint(0, longest)] if rng.random() < 0.7 else []
        path += [(rng.choice(["user", "assistant"]), " ".join("w" * rng.randint(0, 4) + str(rng.randrange(n_turns)))) for _ in range(rng.randint(0, longest - len(path)))]
        paths[c * 7 % 10007] = path
    return paths


def turns_of(paths, step=1):
    return [(c, i * step, role, text) for c, path in paths.items() for i, (role, text) in enumerate(path)]


@pytest.mark.parametrize(("segment", "shard"), [(256, 1 << 16), (3, 40), (1, 25)])
def test_nodes_equal_brute_force(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    paths = talk(random.Random(segment), 130, 4)
    copies = list(paths.values())[50]
    paths |= {20000 + i: copies for i in range(60)}  # one conversation many times, over several shards
    ids = spark.createDataFrame([(c,) for c in paths], "conv_id long")
    assert as_rows(trie.prefix_trie(frame(spark, turns_of(paths)), ids)) == brute_nodes(paths)


def test_long_conversations_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 16)
    monkeypatch.setattr(trie, "SHARD_TURNS", 64)
    rng = random.Random(5)
    base = [("user", f"t {rng.randrange(3)}") for _ in range(300)]
    paths = {1: base, 2: base, 3: base[:160] + [("user", "else")] * 90, 9: base[:160], 4: base[:161], 8: base[:16], 5: [("assistant", "x")]}
    assert as_rows(trie.prefix_trie(frame(spark, turns_of(paths)))) == brute_nodes(paths)


def test_numbering_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rows = [(1, t, "r", str(t)) for t in (None, -9, -1, 0, 3, 4, 5, 21, 22)] + [(2, 7, "r", "b"), (2, 7, "r", "a"), (2, 7, "r", "a"), (2, 99, "r", "c")]
    got = {}
    for r in trie.number_turns(frame(spark, rows), "role", "text").collect():
        got.setdefault(r.conv_id, {})[r.pos] = r.text
    assert got[1] == {i + 1: str(t) for i, t in enumerate((None, -9, -1, 0, 3, 4, 5, 21, 22))}
    assert got[2] == {1: "a", 2: "a", 3: "b", 4: "c"}


def test_end_digests_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    ends = [(bytes([k]), c) for k in range(3) for c in random.Random(k).sample(range(-50, 900), 300)]
    got = {bytes(r.key): (r.n_ends, r.ends_sha256) for r in trie.end_digests(spark.createDataFrame(ends, "key binary, conv long")).collect()}
    for k in range(3):
        ids = sorted(c for key, c in ends if key == bytes([k]))
        assert got[bytes([k])] == (300, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_double_array_finds_its_edges_only():
    rng = np.random.default_rng(3)
    array, edges, states = trie.DoubleArray(), {}, np.array([0])
    for _ in range(6):
        pairs = sorted({(int(s), int(c)) for s in states for c in rng.integers(0, 500, rng.integers(0, 12))})
        if not pairs:
            break
        above, codes = np.array(pairs).T
        array.add(above, codes)
        states = array.step(above, codes)
        edges |= dict(zip(pairs, states.tolist()))
    assert len(set(edges.values())) == len(edges) > 100
    some = rng.choice(list(edges.values()), 300)
    for s, c in zip(some, rng.integers(0, 500, 300)):
        assert array.step(np.array([s]), np.array([c]))[0] == edges.get((int(s), int(c)), -1)


def test_odd_rows_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0 and trie.prefix_trie(empty, empty).count() == 0
    long = "word " * 40_000
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 5, "user", long), (2, 3, "user", "first"), (2, 4, "", ""),
        (None, 1, "user", "no id"), (3, 1, "user", ""), (3, 1, "user", ""), (-4, 1, "us", "er"), (-5, 1, "user", ""),
    ]
    odd = frame(spark, rows).selectExpr("*", "'old' as key", "'old' as depth", "1 as words", "'x' as seg")
    paths = {1: [("user", "first"), ("", ""), ("", ""), ("user", long)], 2: [("user", "first"), ("", "")], 3: [("user", "")] * 2, -4: [("us", "er")], -5: [("user", "")]}
    assert as_rows(trie.prefix_trie(odd)) == brute_nodes(paths)


def test_query_rebuilds(spark, tmp_path):
    rng = random.Random(8)
    own = {c: talk(rng, 1, 3)[0] for c in rng.sample(range(130), 90)}
    rows = [(c, None if i == 0 else i * 2, r if rng.random() < 0.9 else None, t) for c, path in own.items() for i, (r, t) in enumerate(path)] + [(200, 1, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    table, paths = {}, {}
    for c, turn, role, text in rows:
        table.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    table = {c: [x[1:] for x in sorted(t)] for c, t in table.items()}
    for c, path in table.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = table.get(c - c % 20, [])[:h] + path[h:]
    got = as_rows(queries.QUERIES["op13_double_array_trie"](spark, str(tmp_path)))
    assert got == brute_nodes(paths) and any(not p for p in paths.values())
