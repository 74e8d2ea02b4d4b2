"""Near-duplicate documents by SimHash fingerprints (64 bits over 4-word shingles).

Method: a byte-position inverted index with count filtering.  A fingerprint is eight
(position, byte) postings.  Two fingerprints that differ in at most four bits differ
in at most four bytes, so they share at least four postings: the guaranteed minimum.
Lists of a single posting hold 1/256 of all rows, and their pairs would grow with the
square of the input; the index keeps the intersections of three postings instead, for
20 of the 56 triples of positions, chosen so that any four positions hold one of them
(the smallest such choice).  Pairs that meet in a list share three postings at least;
their shared postings are tallied over all eight positions, pairs below four dropped,
and the rest verified by Hamming distance.

Exact copies collapse to one fingerprint first.  Within a list only the edges of a
spanning forest come out, so groups of near copies cost no quadratic output; lists
longer than `BLOCK` are compared in pairs of blocks dealt over all tasks.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.buckets import Matcher, Memo, _long_links, forest
from lantern.llm.tables import LONG_PAIR, beside, connected_components, id_text, join_hot, row_key, staged, unused

SHINGLE = 4
MAX_BITS = 4
#: Shared positional bytes that a pair within MAX_BITS has at least.
MIN_SHARED = 8 - MAX_BITS
#: Rows of a posting list that one task compares by itself.
BLOCK = 4096
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every k-word shingle, repeats included; fewer words: of the whole sequence; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() is A-Z only, split() is \x20 \x09-\x0D only
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is 1 if more than half of the hashes have it; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    lanes = (h[None, :] >> _SHIFTS) & _LANES  # row s, byte lane j: bit 8j+s
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=1)  # 255 ones fit a byte
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)
    bits = (2 * counts > n).T.reshape(64)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches):
    for batch in batches:
        marks = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document."""
    return id_text(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _masks() -> list[int]:
    """Bytes at three positions: within a group of positions, or two of one group and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [t for g in groups for t in combinations(g, 3)]
    triples += [(*two, one) for k, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    out = []
    for keep in triples:
        m = sum(0xFF << (8 * p) for p in keep)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def linked(x: np.ndarray, y) -> np.ndarray:
    """Count filter, then verification: shared positional bytes, then differing bits."""
    d = x ^ y
    shared = (d.view(np.uint8).reshape(*d.shape, 8) == 0).sum(axis=-1)
    ok = shared >= MIN_SHARED
    ok &= np.bitwise_count(d) <= MAX_BITS
    return ok


class PrintMatcher(Matcher):
    def __init__(self, ids, fps, memo):
        super().__init__(ids, fps, memo)
        self.fps = np.array(fps, np.int64).view(np.uint64)

    def joined(self, x: int, y: int) -> bool:
        if self.ids:
            self.memo.join(self.ids[x], self.ids[y])
        return True  # `may` has verified it

    def may(self, x: int, others: np.ndarray) -> np.ndarray:
        return linked(self.fps[others], self.fps[x])


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    pairs = np.array(forest(len(fps), PrintMatcher([], fps.view(np.int64), Memo())), np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def _edges(key: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
    """Links within the runs of equal keys; runs of up to 16 side by side, longer ones one by one."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16]):
        x, y = _forest(fp[s : s + n])
        a.append(x)
        b.append(y)
    short = np.repeat(sizes <= 16, sizes) & np.repeat(sizes > 1, sizes)
    key, fp = key[short], fp[short]
    for step in range(1, 16):
        same = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else []
        if not len(same):
            break
        x, y = fp[same], fp[same + step]
        ok = linked(x, y)
        a.append(x[ok])
        b.append(y[ok])
    return a, b


def _rows(a: list, b: list, long: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.concatenate(a).view(np.int64) if a else np.empty(0, np.int64)
    b = np.concatenate(b).view(np.int64) if b else np.empty(0, np.int64)
    none = [None] * len(a)
    keys, counts = [k for k, _ in long], [n for _, n in long]
    cols = [
        pa.concat_arrays([pa.array(a), pa.nulls(len(long), pa.int64())]),
        pa.concat_arrays([pa.array(b), pa.nulls(len(long), pa.int64())]),
        pa.array(none + keys, pa.int64()),
        pa.array(none + counts, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "n"])


def _list_batches(batches):
    """Posting lists, sorted by key.  Lists longer than BLOCK are counted, not kept: they come out as (key, n)."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    dropped = 0  # rows of the list at the end that were counted but not kept
    for batch in batches:
        key = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
        a, b, long = _split_long(key[:cut], fp[:cut], dropped)
        dropped = dropped if cut == 0 else 0
        rest_k, rest_f = key[cut:], fp[cut:]
        if len(rest_k) > BLOCK:
            dropped += len(rest_k) - 1
            rest_k, rest_f = rest_k[-1:], rest_f[-1:]
        yield _rows(a, b, long)
    if len(rest_k):
        yield _rows(*_split_long(rest_k, rest_f, dropped))


def _split_long(key: np.ndarray, fp: np.ndarray, dropped: int) -> tuple[list, list, list]:
    if not len(key):
        return [], [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    true = sizes.copy()
    true[0] += dropped
    long = [(int(key[s]), int(n)) for s, n in zip(starts[true > BLOCK], true[true > BLOCK])]
    keep = np.repeat(true <= BLOCK, sizes)
    key, fp = key[keep], fp[keep]
    return (*(_edges(key, fp) if len(key) else ([], [])), long)


def links(reps: DataFrame) -> DataFrame:
    """Links among distinct fingerprints (column fp): a, b; every component of links stays connected."""
    keys = reps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_masks())])).alias("l"), "fp").select(F.xxhash64("l.i", "l.v").alias("key"), "fp")
    found = staged(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_list_batches, LONG_PAIR), "simhash-links")
    edges = found.where("key is null").select("a", "b")
    long = found.where("key is not null").groupBy("key").agg(F.max("n").alias("n"))
    if not long.isEmpty():
        rows = keys.select("key", F.col("fp").alias("id"), F.col("fp").alias("payload"))
        edges = edges.union(staged(_long_links(rows, long, PrintMatcher), "simhash-blocks"))
    return edges


def components(fps: DataFrame, first: DataFrame) -> DataFrame:
    """fp and first of every fingerprint: the least `first` of its component.  `first` has fp, once each, and first."""
    parts = connected_components(links(first).select(F.col("a").alias("src"), F.col("b").alias("dst")), "simhash-cc")
    named = first.join(parts.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    grouped = named.join(least, "component").select("fp", "least")
    return first.join(grouped, "fp", "left").withColumn("first", F.coalesce("least", "first")).drop("least")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, fingerprint (hex) and component_id.

    component_id is the least doc_id reachable over links of at most four differing
    bits, the document itself included.  Null and empty texts have fingerprint zero
    and are linked like any other; repeated doc_ids stay as rows; null doc_ids stay
    but never name a component; other columns of `docs` are not read.
    """
    fps = staged(fingerprints(docs), "simhash-fp")
    reps = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "simhash-reps")
    by_fp = staged(components(fps, reps), "simhash-by-fp")
    out = join_hot(fps, by_fp.withColumnRenamed("first", "component_id"), ["fp"], fps.count())
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_batches(batches):
    from lantern.llm.similar import keys_of

    for b in batches:
        texts = b.column(3).to_pylist()
        marks = np.array([fingerprint(shingle_hashes(t)) for t in texts], dtype=np.uint64)
        keys = pa.array([keys_of(t) for t in texts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(marks.view(np.int64)), keys], names=["doc_id", "k", "h", "fp", "keys"])


def near_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each SimHash group, and of those one of each group of similar texts (`similar`).

    The one with the least doc_id stays, of rows that share it the one with the least
    hash of its text, and rows without doc_id only where no other is in the group.
    Rows that repeat doc_id and text become one.
    """
    from lantern.llm.similar import similar_groups

    k, h = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), h.alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fps = staged(rows.mapInArrow(_row_batches, "doc_id long, k long, h long, fp long, keys array<long>"), "simhash-fp")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h", "k")
    reps = staged(fps.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")), "simhash-reps")
    kept = components(fps, reps).select("first.*").distinct()
    # Numbers in that order, fixed by being written: similar texts need one column.
    kept = staged(kept.sort("absent", "doc_id", "h").select("k", "h", F.monotonically_increasing_id().alias("id")), "simhash-kept")
    again = not fps.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    once = (lambda df: df.dropDuplicates(["id"])) if again else (lambda df: df)

    def texts(asked: DataFrame) -> DataFrame:
        who = staged(kept.join(asked, "id"), "simhash-asked")
        return once(rows.join(beside(who), ["k", "h"]).select("id", "text"))

    similar = similar_groups(once(fps.select("k", "h", "keys").join(kept, ["k", "h"]).select("id", "keys")), texts)
    copies = similar.where("node <> component").select(F.col("node").alias("id"))
    x, y, number = unused(docs, "k", "h", "number")
    final = staged(kept.join(copies, "id", "left_anti").select(F.col("k").alias(x), F.col("h").alias(y), F.col("id").alias(number)), "simhash-final")
    out = docs.join(final.hint("shuffle_hash"), (k == F.col(x)) & (h == F.col(y)))
    if again:
        out = out.dropDuplicates([number])
    return out.select(*[out[c] for c in docs.columns])
