"""Links within buckets: rows that share a key are compared, and a spanning forest of their links comes out.

A bucket's rows stream by in order of its key.  Up to `BLOCK` of them are compared by one
task; a longer bucket is split into blocks by hash, and each pair of blocks is a group of
its own, so no task ever holds a bucket without bound.  Links that join what is already
joined aren't looked for, so a group of near copies costs no quadratic output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import LONG_PAIR, beside, staged

#: Rows of a bucket that one task compares by itself.
BLOCK = 4096
#: Joined ids that a task holds before it sends them on.
HELD = 200_000


class Memo:
    """What a task has learned: which ids are joined; and of the buckets at hand, which pairs aren't linked, and sets of what was seen, up to a bound."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.apart: set[tuple[int, int]] = set()
        self.sets: dict[int, set] = {}

    def find(self, x: int) -> int:
        while (u := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(u, u)
            x = u
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)

    def turn(self) -> None:
        """On to other buckets, whose pairs are others."""
        self.apart.clear()
        self.sets.clear()

    def stars(self) -> tuple[list[int], list[int]]:
        """Each joined id beside the least one of its group; and forget them."""
        ids = list(self.up)
        roots = [self.find(x) for x in ids]
        self.up = {}
        pairs = [(r, x) for r, x in zip(roots, ids) if r != x]
        return [r for r, _ in pairs], [x for _, x in pairs]


class Matcher:
    """Compares the payloads of one bucket."""

    def __init__(self, ids: list[int], loads: list, memo: Memo):
        self.ids, self.loads, self.memo = ids, loads, memo

    def may(self, x: int, others: np.ndarray) -> np.ndarray:
        """False for those of `others` that can't be linked to x."""
        raise NotImplementedError

    def sure(self, x: int, y: int) -> bool:
        """Are two that may be linked?"""
        return True

    def joined(self, x: int, y: int) -> bool:
        """Are two linked, or joined by links found in this group before?"""
        m, a, b = self.memo, self.ids[x], self.ids[y]
        if m.find(a) == m.find(b):
            return True
        pair = (a, b) if a < b else (b, a)
        if pair in m.apart:
            return False
        if self.sure(x, y):
            m.join(a, b)
            return True
        if len(m.apart) < 100_000:
            m.apart.add(pair)
        return False


_SECOND = np.array([1])


def forest(n: int, match: Matcher) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among 0 .. n-1."""
    if n == 2:  # most buckets
        return [(0, 1)] if match.may(0, _SECOND)[0] and match.joined(0, 1) else []
    left, out = np.arange(n), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            ok = match.may(x, left)
            for i in np.flatnonzero(ok):
                y = int(left[i])
                ok[i] = match.joined(x, y)
                if ok[i]:
                    out.append((x, y))
                    front.append(y)
            left = left[~ok]
    return out


def forest_between(n: int, m: int, match: Matcher) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of 0 .. n-1 with n .. n+m-1."""
    label, out = np.arange(n + m), []
    for x in range(n):
        others = n + np.flatnonzero(label[n:] != label[x])
        if not len(others):
            continue
        for y in others[match.may(x, others)]:
            if label[y] != label[x] and match.joined(x, int(y)):
                out.append((x, int(y)))
                label[label == label[y]] = label[x]
    return out


def members(batches, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in order: each once, without keys that have only one id; with `head`, the first id of the key."""
    held, sent, first = None, False, None
    for b in batches:
        key, one = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        if held is not None:
            key, one = np.concatenate([held[0], key]), np.concatenate([held[1], one])
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1])])
        key, one = key[fresh], one[fresh]
        next_too = key[1:] == key[:-1]
        member = np.concatenate([[False], next_too]) | np.concatenate([next_too, [False]])
        starts = np.concatenate([[True], ~next_too])
        head = one[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
        if held is not None:
            head[: np.argmin(np.concatenate([next_too, [False]])) + 1] = first
        now = member.copy()
        if sent:
            now[0] = False
        sent = bool(member[-1]) or (sent and len(member) == 1)
        held, first = (key[-1:], one[-1:]), head[-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[now]) for c in (key, one, head)], names=[*columns, "head"])


def _pairs(a: list[int], b: list[int], long: list[tuple[int, int]]) -> pa.RecordBatch:
    none_a, none_k = [None] * len(long), [None] * len(a)
    cols = [a + none_a, b + none_a, none_k + [k for k, _ in long], none_k + [n for _, n in long]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key", "n"])


def _per_bucket(batches, make: Callable[..., Matcher]) -> Iterator[pa.RecordBatch]:
    """Rows (head, key, id, payload), grouped by (head, key).  What a task joins comes out as stars, each id once."""
    key, ids, loads, n, memo, long = None, [], [], 0, Memo(), []

    def done():
        if n > BLOCK:
            long.append((key[1], n))
        elif n > 1:
            forest(n, make(ids, loads, memo))

    for batch in batches:
        hs, ks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(ks):
            continue
        mine, what = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], (ks[1:] != ks[:-1]) | (hs[1:] != hs[:-1])])).tolist() + [len(ks)]
        for s, e in zip(cuts, cuts[1:]):
            here = (int(hs[s]), int(ks[s]))
            if here != key:
                done()
                if key is None or here[0] != key[0]:
                    memo.turn()
                key, ids, loads, n = here, [], [], 0
            n += e - s
            if n <= BLOCK:
                ids += mine[s:e]
                loads += what[s:e]
            else:
                ids, loads = [], []  # counted, not kept
        if len(memo.up) > HELD:
            yield _pairs(*memo.stars(), long)
            long = []
    done()
    yield _pairs(*memo.stars(), long)


def _per_block_pair(batches, make: Callable[..., Matcher]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, id, payload), grouped by (key, i, j), side 0 before side 1."""
    group, ids, loads, first = None, [], [], 0

    def links():
        match = make(ids, loads, Memo())
        found = forest(len(ids), match) if group[1] == group[2] else forest_between(first, len(ids) - first, match)
        return _pairs([ids[x] for x, _ in found], [ids[y] for _, y in found], [])

    for batch in batches:
        for k, i, j, side, one, load in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if (k, i, j) != group:
                if group is not None:
                    yield links()
                group, ids, loads, first = (k, i, j), [], [], 0
            ids.append(one)
            loads.append(load)
            first += side == 0
    if group is not None:
        yield links()


def links_in_buckets(rows: DataFrame, make: Callable[..., Matcher], name: str) -> DataFrame:
    """Pairs (a, b) that join what is linked among rows (head, key, id, payload) that share a key; each row once a key, and staged or cheap to read again.

    Keys of one head, which all have one `head` and are few, are looked at by one task in
    a row: near copies share most of their keys, and then are compared once, not for
    each key.
    """
    found = staged(rows.select("head", "key", "id", "payload").repartition("head").sortWithinPartitions("head", "key", "id").mapInArrow(lambda b: _per_bucket(b, make), LONG_PAIR), name)
    edges = found.where("a is not null").select("a", "b")
    long = found.where("key is not null").groupBy("key").agg(F.max("n").alias("n"))
    if long.isEmpty():
        return edges
    return edges.union(staged(_long_links(rows, long, make), f"{name}-blocks"))


def _long_links(rows: DataFrame, long: DataFrame, make: Callable[..., Matcher]) -> DataFrame:
    mine = rows.select("key", "id", "payload").join(beside(long), "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK * 2).cast("int"))
    mine = mine.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = mine.select("key", "id", "payload", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("i") <= F.col("other"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), side.alias("side"), "id", "payload")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(lambda b: _per_block_pair(b, make), LONG_PAIR).select("a", "b")
