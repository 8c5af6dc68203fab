"""Byte-level BPE encoding and decoding with a pair occurrence index.

A text is cut at special tokens, then into pre-tokens; the distinct pre-tokens of a slice of a partition that are not known yet are laid out in one array
of symbols. An index maps each mergeable pair to all its positions in that array. The ranks that occur are applied in
ascending order, each to all its positions at once; a merge updates the lists of the pairs to its left and right. The result equals
merging each pre-token alone, because a merge never makes a pair of a lower rank than its own in a trained vocabulary
(and if a table had such a pair, it is queued and applied next).
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import regex

from supportlake.llm.worker import per_worker

#: The characters that Unicode calls white space, and the pre-token pattern of byte-level vocabularies.
WHITE = "\t-\r \x85\xa0  -     　"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A piece is a run of other characters with the blank before it, or white space as the pattern above cuts it. No
#: pre-token crosses the border of a piece.
#: Latin letters up to a blank, line end or common mark are a piece too, which is one pre-token.
LATIN = "A-Za-zÀ-ÖØ-öø-ˁ"
PIECE = f" ?[{LATIN}]+(?=[ \\n,.]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Encoded pieces that a task remembers; it forgets all when there are more, and at its end.
MEMORY = 600_000
#: Longer pieces are not remembered.
LONG_PIECE = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return out


class PairIndexBpe:
    """A byte-level vocabulary read from the text of a tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the vocabulary is not plain byte-level BPE")
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        ids = model["vocab"]
        self.start = np.array([ids[c] for c in alphabet], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.result = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        names = {i: t for t, i in ids.items()}
        self.bytes = [b""] * (max([*names, *self.special.values()]) + 1)
        for i, name in names.items():
            self.bytes[i] = bytes(to_byte[c] for c in name)
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.pieces = re.compile(PIECE)
        self.pre_tokens = regex.compile(PRE_TOKEN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.known: dict[str, bytes] = {name: np.array([i], "<u4").tobytes() for name, i in self.special.items()}
        self.fixed = len(self.known)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit integers), by the pair occurrence index."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        cuts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(w) for w in words], out=cuts[1:])
        symbol = self.start[raw]
        word = np.repeat(np.arange(len(words)), np.diff(cuts))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        last = np.ones(n, dtype=bool)
        last[:-1] = word[:-1] != word[1:]
        after[last] = n
        begins = np.ones(n, dtype=bool)
        begins[1:] = last[:-1]
        before[begins] = -1
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        inner = np.flatnonzero(~last)
        rank = self.rank(symbol[inner], symbol[inner + 1])
        inner, rank = inner[rank >= 0], rank[rank >= 0]
        by_rank = np.argsort(rank, kind="stable")
        inner, rank = inner[by_rank], rank[by_rank]
        heads = np.flatnonzero(np.diff(rank, prepend=-1)) if len(rank) else []
        lists = {int(rank[h]): [inner[h:z]] for h, z in zip(heads, [*heads[1:], len(rank)])}
        active = sorted(lists)
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at.sort()
            at = at[np.diff(at, prepend=-1) != 0]
            a, b, new = self.left[r], self.right[r], self.result[r]
            ahead = after[at]
            good = alive[at] & (symbol[at] == a) & (ahead < n)
            at, ahead = at[good], ahead[good]
            good = symbol[ahead] == b
            at, ahead = at[good], ahead[good]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # In a run of positions that follow each other, every second one starts with a merged symbol.
                linked = np.zeros(len(at), dtype=bool)
                linked[1:] = ahead[:-1] == at[1:]
                run = np.flatnonzero(~linked)
                offset = np.arange(len(at)) - run[np.cumsum(~linked) - 1]
                at, ahead = at[offset % 2 == 0], ahead[offset % 2 == 0]
            alive[ahead] = False
            symbol[at] = new
            beyond = after[ahead]
            after[at] = beyond
            some = beyond < n
            before[beyond[some]] = at[some]
            behind = before[at]
            begin = np.concatenate([behind[behind >= 0], at[some]])
            if not len(begin):
                continue
            made = self.rank(symbol[begin], symbol[after[begin]])
            begin, made = begin[made >= 0], made[made >= 0]
            if not len(begin):
                continue
            by_rank = np.argsort(made, kind="stable")
            begin, made = begin[by_rank], made[by_rank]
            heads = np.flatnonzero(np.diff(made, prepend=-1))
            for h, z in zip(heads.tolist(), [*heads[1:].tolist(), len(made)]):
                key = int(made[h])
                if key in lists:
                    lists[key].append(begin[h:z])
                else:
                    lists[key] = [begin[h:z]]
                    heapq.heappush(active, key)
        left = np.flatnonzero(alive[:n])
        ids = symbol[left].astype("<u4").tobytes()
        ends = (4 * np.searchsorted(left, cuts)).tolist()
        return [ids[a:z] for a, z in zip(ends, ends[1:])]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known: cut into pre-tokens, merged together."""
        # Letters after at most one blank are one pre-token; most pieces are.
        whole = [p for p in pieces if p.isalpha() or (p[0] == " " and p[1:].isalpha())]
        split = {p: self.pre_tokens.findall(p) for p in pieces.difference(whole)}
        rest = list(set(itertools.chain.from_iterable(split.values())).difference(whole))
        out = dict(zip([*whole, *rest], self.merge([*map(str.encode, whole), *map(str.encode, rest)])))
        get = out.__getitem__
        out.update([(p, b"".join(map(get, tokens))) for p, tokens in split.items()])
        return out

    def forget(self) -> None:
        """Drop what was learnt from texts: a worker also runs tasks of other stages, which need the memory."""
        self.known = dict(itertools.islice(self.known.items(), self.fixed))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is an empty text."""
        cut, find = self.cut, self.pieces.findall
        rows = []
        for text in texts:
            if not text:
                rows.append([])
            elif cut is not None and cut.search(text):
                rows.append([p for i, part in enumerate(cut.split(text)) for p in ([part] if i % 2 else find(part))])
            else:
                rows.append(find(text))
        new = set().union(*rows).difference(self.known)
        fresh = self._learn(new)
        if len(self.known) + len(fresh) > MEMORY:
            self.forget()
            fresh = fresh | self._learn(set().union(*rows).difference(self.known, fresh))
        self.known.update((p, i) for p, i in fresh.items() if len(p) <= LONG_PIECE)
        table = self.known if all(len(p) <= LONG_PIECE for p in fresh) else {**self.known, **fresh}
        get = table.__getitem__
        return [b"".join(map(get, row)) for row in rows]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; bytes that are not UTF-8 become the replacement character."""
        table = self.bytes
        raw = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


def vocabulary(definition: str) -> PairIndexBpe:
    """One vocabulary per worker process."""
    return per_worker(("pair index", definition), lambda: PairIndexBpe(definition))


def parts(texts: list, size: int = 1 << 22) -> Iterator[list]:
    """Consecutive parts of about ``size`` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
