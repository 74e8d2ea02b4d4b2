"""Fuzzy line dedup by MinHash: one line of each component stays.

Lines are sets of 8-character shingles (a shorter line is its own only shingle).  Equal
lines meet by a 128-bit hash.  Different lines of 8 characters or more get a MinHash
signature of BANDS x ROWS values; lines that agree on all rows of a band are candidates,
verified by exact Jaccard similarity (0.8 or more), and joined by distributed connected
components.  The first occurrence in order of (doc_id, hash of the text, line number)
stays.

Bands carry hashes alone.  Only lines that share a bucket with a different line have
their texts looked up, once each, and are then compared bucket by bucket (`buckets`).
Before shingles are compared, an upper bound of the similarity is: every line has a
bitmap of its shingles' hashes, and a bit that only one of two lines has is a shingle
that only it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.buckets import Matcher, links_in_buckets, members
from lantern.llm.tables import connected_components, join_hot, staged, unused
from lantern.llm.token_count import slices

SHINGLE, SIMILARITY = 8, 0.8
#: At a similarity of 0.8 a pair meets in some band with probability 0.995, at 0.9 with 0.99998.
BANDS, ROWS = 10, 4
#: Lines whose bands a task remembers having sent, so that a common line isn't sent again and again.
REMEMBERED = 300_000
BITS = 1024
REMEMBERED_SETS = 512
_draw = np.random.default_rng(20_240_607)
_XOR = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MASK = (1 << 64) - 1
_TRUE = np.array([True])
_TRUE.flags.writeable = False


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that aren't blank; lines end at \\n."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]


def line_key(line: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    hi, lo = d >> 64, d & _MASK
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


def shingles(line: str) -> set[str]:
    n = len(line)
    return {line} if n < SHINGLE else {line[i : i + SHINGLE] for i in range(n - SHINGLE + 1)}


def packed_shingles(line: str) -> np.ndarray | None:
    """The set of shingles of a Latin-1 line as sorted numbers of eight bytes, one a character; None for other lines."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    a = np.sort(np.ndarray((len(raw) - SHINGLE + 1,), np.uint64, raw, strides=(1,)))
    return a[np.concatenate([_TRUE, a[1:] != a[:-1]])]


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def packed_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    c = np.sort(np.concatenate([a, b]))
    both = int(np.count_nonzero(c[1:] == c[:-1]))
    return both / (len(c) - both)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of lines of SHINGLE characters or more, in a row, and where each line starts."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = chars * _STEP[0]
    h ^= h >> np.uint64(29)
    for k, width in enumerate((1, 2, 4)):  # hashes of 2, 4 and 8 characters
        h = h[:-width] * _STEP[k + 1] + h[width:]
        h ^= h >> np.uint64(31)
    h *= _STEP[0]
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = sizes - SHINGLE + 1
    # Windows that cross into the next line are left out.
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return h32[at], np.cumsum(n) - n


def bitmaps(lines: list[str]) -> np.ndarray:
    """(lines, BITS / 64): which values the hashes of a line's shingles take."""
    h, cuts = shingle_hashes(lines)
    bits = np.zeros((len(lines), BITS), np.uint8)
    bits[np.repeat(np.arange(len(lines)), np.diff(np.r_[cuts, len(h)])), h % BITS] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


class LineMatcher(Matcher):
    """Jaccard similarity of SIMILARITY or more between lines of SHINGLE characters or more."""

    def __init__(self, ids, lines, memo):
        super().__init__(ids, lines, memo)
        if len(lines) > 4:
            self.bits = np.concatenate([bitmaps(lines[at : at + 256]) for at in range(0, len(lines), 256)])
            self.sizes = np.array([len(self.of(i)) for i in range(len(lines))], np.int64)

    def of(self, i: int) -> np.ndarray | set[str]:
        sets, one = self.memo.sets, self.ids[i]
        if one not in sets:
            if len(sets) > REMEMBERED_SETS:
                sets.clear()
            packed = packed_shingles(self.loads[i])
            sets[one] = shingles(self.loads[i]) if packed is None else packed
        return sets[one]

    def may(self, x: int, others: np.ndarray) -> np.ndarray:
        if len(self.loads) <= 4:
            return np.ones(len(others), bool)  # the caller writes into it
        n, m, a, b = self.sizes[x], self.sizes[others], self.bits[x], self.bits[others]
        most = np.minimum(n - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        return most >= SIMILARITY * (n + m - most) - 1e-6

    def sure(self, x: int, y: int) -> bool:
        a, b = self.of(x), self.of(y)
        if isinstance(a, np.ndarray) and isinstance(b, np.ndarray):
            return packed_jaccard(a, b) >= SIMILARITY
        return jaccard(shingles(self.loads[x]), shingles(self.loads[y])) >= SIMILARITY


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) of 64-bit keys, for lines of SHINGLE characters or more."""
    h32, cuts = shingle_hashes(lines)
    out, v = np.empty((len(lines), BANDS), np.uint64), np.empty_like(h32)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            np.bitwise_xor(h32, _XOR[r], out=v)
            np.multiply(v, _MUL[r], out=v)
            key = (key ^ np.minimum.reduceat(v, cuts)) * _STEP[1]
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def _line_batches(batches):
    for whole in batches:
        for b in slices(whole, 1024):
            ids, hs, nos, totals, his, los = [], [], [], [], [], []
            for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = lines_of(t)
                for no, x in own:
                    hi, lo = line_key(x)
                    nos.append(no)
                    his.append(hi)
                    los.append(lo)
                ids += [i] * len(own)
                hs += [h] * len(own)
                totals += [len(own)] * len(own)
            cols = zip((ids, hs, nos, totals, his, los), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], names=["doc_id", "h", "line_no", "total", "hi", "lo"])


def _band_batches(batches):
    sent: set[int] = set()
    for whole in batches:
        for b in slices(whole, 256):
            fresh = {}
            for t in b.column(2).to_pylist():
                for x in t.split("\n"):
                    if len(x) >= SHINGLE and not x.isspace():
                        hi, lo = line_key(x)
                        if hi ^ lo not in sent:
                            fresh[x] = lo
                            sent.add(hi ^ lo)
            if len(sent) > REMEMBERED:
                sent = set()
            los, lines = np.array(list(fresh.values()), np.int64), list(fresh)
            at = 0
            while at < len(lines):  # about 100,000 characters at a time stay in the cache
                end, size = at, 0
                while end < len(lines) and (end == at or size + len(lines[end]) < 100_000):
                    size += len(lines[end])
                    end += 1
                keys = band_keys(lines[at:end]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(los[at:end], BANDS))], names=["key", "lo"])
                at = end


def _pick_batches(batches):
    """Of (text, line numbers): hi, lo and the line of each."""
    for b in batches:
        his, los, lines = [], [], []
        for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            every = t.split("\n")
            for no in set(want):
                hi, lo = line_key(every[no])
                his.append(hi)
                los.append(lo)
                lines.append(every[no])
        yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(lines, pa.string())], names=["hi", "lo", "line"])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and text; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all lines that aren't blank: doc_id, h, line_no, total, hi, lo; lines that occur twice or are similar to others: hi, lo, rows, first).

    `total` is the number of the row's lines that aren't blank, `rows` the occurrences
    of the line, `first` (doc_id, h, line_no) the first occurrence in its component.
    """
    base = keyed_texts(docs)
    lines = staged(base.mapInArrow(_line_batches, "doc_id long, h long, line_no int, total int, hi long, lo long"), "line-all")
    unique = staged(lines.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("pos"), F.count(F.lit(1)).alias("rows")), "line-unique")
    # Half of a line's hash will do to find buckets: lines that share it are both looked up, and told apart then.
    bands = base.mapInArrow(_band_batches, "key long, lo long")
    met = staged(bands.repartition("key").sortWithinPartitions("key", "lo").mapInArrow(lambda b: members(b, ["key", "lo"]), "key long, lo long, head long"), "line-buckets")
    asked = unique.join(met.select("lo").distinct(), "lo", "left_semi").groupBy("pos.doc_id", "pos.h").agg(F.collect_list("pos.line_no").alias("want"))
    wanted = asked.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "want")
    rows = base.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))).select("text", "want")
    found = rows.mapInArrow(_pick_batches, "hi long, lo long, line string").dropDuplicates(["hi", "lo"])
    # Numbers for lines, fixed by being written: links and components need one column.
    texts = staged(found.withColumn("id", F.monotonically_increasing_id()), "line-texts", "lz4")
    edges = links_in_buckets(met.join(texts, "lo").select("head", "key", "id", F.col("line").alias("payload")), LineMatcher, "line-links")
    parts = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), "line-cc")
    named = texts.select("id", "hi", "lo").join(parts.withColumnRenamed("node", "id"), "id").join(unique, ["hi", "lo"])
    named = staged(named.select("hi", "lo", "component", "pos", "rows"), "line-named")
    least = named.groupBy("component").agg(F.min("pos").alias("first"))
    grouped = named.join(least, "component").select("hi", "lo", "rows", "first")
    alone = unique.where("rows > 1").join(named.select("hi", "lo"), ["hi", "lo"], "left_anti").select("hi", "lo", "rows", F.col("pos").alias("first"))
    return lines, staged(grouped.union(alone), "line-first")


def dropped_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h and n, the lines that aren't blank, of rows that have any; doc_id, h and gone, the numbers of the lines that go, of rows that lose some)."""
    lines, first = line_groups(docs)
    size = first.agg(F.sum("rows")).first()[0] or 0
    here = F.struct("doc_id", "h", "line_no")
    marked = join_hot(lines.select("doc_id", "h", "line_no", "hi", "lo"), first, ["hi", "lo"], size).where(~here.eqNullSafe(F.col("first")))
    gone = marked.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    return lines.groupBy("doc_id", "h").agg(F.max("total").cast("long").alias("n")), staged(gone, "line-gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines and n_kept (lines that aren't blank), dropped (numbers of the lines that go, comma-joined).

    Blank lines are never duplicates and always stay.  Null and empty texts have no
    lines; rows are told apart by doc_id and text, so rows that repeat both are one
    occurrence and come out alike; null doc_ids come first in order.
    """
    n, gone = dropped_lines(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    per = staged(n.join(gone, (n["doc_id"].eqNullSafe(gone["doc_id"])) & (n["h"] == gone["h"]), "left").select(n["doc_id"].alias("id"), n["h"].alias("g"), "n", "gone"), "line-counts")
    out = ids.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("doc_id", n.alias("n_lines"), (n - F.size(gone)).alias("n_kept"), F.array_join(gone, ",").alias("dropped"))


def apply_dedup(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that go; other columns as they are."""
    i, g, lost = unused(docs, "id", "g", "gone")
    gone = dropped_lines(docs)[1].select(F.col("doc_id").alias(i), F.col("h").alias(g), F.col("gone").alias(lost))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(g))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, at: ~F.array_contains(lost, at)), "\n")
    return docs.join(gone.hint("shuffle_hash"), same, "left").withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
