"""Similar texts by MinHash: sets of 5-word shingles with a Jaccard similarity of 0.8 or more.

SimHash within four bits finds few pairs of that similarity, and byte positions tell
nothing beyond seven bits (eight may touch every byte).  Here texts that agree on all
rows of a MinHash band are candidates, verified by exact Jaccard similarity of their
shingle sets, bucket by bucket (`buckets`), and joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import simhash
from lantern.llm.buckets import Matcher, links_in_buckets, members
from lantern.llm.tables import connected_components, staged

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair meets in some band with probability 0.998, at 0.9 with more than 0.99999.
BANDS, ROWS = 20, 6
_draw = np.random.default_rng(20_240_611)
_XOR = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MUL = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles, each once."""
    return np.unique(np.array(simhash.shingle_hashes(text, SHINGLE), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty."""
    least = np.full((BANDS * ROWS, 1), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ _XOR) * _MUL).min(axis=1, keepdims=True))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * _STEP
        key ^= key >> np.uint64(32)
    return key


def keys_of(text: str) -> list[int] | None:
    """BANDS keys of a text as signed longs; None without words."""
    h = shingle_set(text)
    return band_keys(h).view(np.int64).tolist() if len(h) else None


def _set_batches(batches):
    for b in batches:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["id", "payload"])


class SetMatcher(Matcher):
    """Jaccard similarity of SIMILARITY or more between sets given as sorted hashes."""

    def __init__(self, ids, sets, memo):
        super().__init__(ids, sets, memo)
        self.sizes = np.array([len(x) // 8 for x in sets], np.int64)

    def may(self, x: int, others: np.ndarray) -> np.ndarray:
        n, m = self.sizes[x], self.sizes[others]
        return np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-9

    def sure(self, x: int, y: int) -> bool:
        a, b = np.frombuffer(self.loads[x], np.uint64), np.frombuffer(self.loads[y], np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def similar_groups(bands: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and component (the least id) of ids that are similar to another.

    `bands` has id and keys (`keys_of`, null without words); `texts` gives id and text
    for a staged table of ids, those that share a bucket with another.
    """
    rows = bands.select(F.explode("keys").alias("key"), "id")
    met = staged(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda b: members(b, ["key", "id"]), "key long, id long, head long"), "similar-buckets")
    asked = staged(met.select("id").distinct(), "similar-asked")
    sets = staged(texts(asked).select("id", "text").mapInArrow(_set_batches, "id long, payload binary"), "similar-sets", "lz4")
    edges = links_in_buckets(met.join(sets, "id"), SetMatcher, "similar-links")
    return connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar-cc")
