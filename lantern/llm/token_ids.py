"""Token ids in binary shards: frequency-ranked, byte-aligned, control bytes apart.

Ids are replaced by their frequency rank over the whole corpus (ties by id), so most
take one byte.  A value takes one to four bytes, little-endian; its length less one is
two bits of a control byte, four values to a control byte, and all control bytes of a
shard stand before all data bytes.  Decoding looks the four lengths of every control
byte up in a table and gathers the data bytes with numpy.

Shard layout, little-endian:
  magic b"LTI1" | u32 documents | u64 values | u64 data bytes
  documents x (i64 doc_id, u32 values) | control bytes | data bytes

Shards are cut at about `SHARD_VALUES` values, hold documents in ascending doc_id
order and are stored as binary rows of Parquet files in the shared folder: Spark's
committer makes retried tasks harmless, and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.tables import checkpoint_dir, id_text, staged
from lantern.llm.token_count import byte_level, library, slices

END_ID = 1
SHARD_VALUES = 1 << 20
#: Words a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 900_000, 64
#: Class of each Latin-1 character: x letter, number or white space; P full stop or comma; Q other punctuation; ! neither.
_CLASSES = bytes(
    ord("x") if chr(c) in "\t\n\r " or (0x20 < c < 0x7F or c > 0xA0) and regex.match(r"[\p{L}\p{N}]", chr(c)) else ord("P") if chr(c) in ".," else ord("Q") if 0x20 < c < 0x7F or c > 0xA0 else ord("!")
    for c in range(256)
)


def plain_words(text: str) -> list[str] | None:
    """The lower-case words of a Latin-1 text without control characters; None for others.

    Full stops and commas become words, unless one touches other punctuation, with
    which it would make one pre-token.
    """
    try:
        kinds = text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        return None
    if b"!" in kinds:
        return None
    text = text.lower()
    if not (b"PP" in kinds or b"PQ" in kinds or b"QP" in kinds):
        text = text.replace(".", " . ").replace(",", " , ")
    return text.split()


_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_HEAD = struct.Struct("<4sIQQ")
_DOCS = np.dtype([("id", "<i8"), ("n", "<u4")])
#: Of each control byte: the lengths of its four values.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts; one per worker.

    The pattern never crosses white space, so words are encoded once each and
    remembered in a bounded table, which starts anew when full.  A plain text is
    lower-cased first and has its lone full stops and commas set apart, which changes
    no pre-token and leaves fewer different words.  Words are cut into pre-tokens and
    merged by the library's model; odd texts are left to the library word by word.
    Ids lie in one pool; a table entry is its place there times 2**32 plus its length.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.special = tuple(a.content for a in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pool = np.empty(1 << 20, np.uint32)
        self.used = 0

    def put(self, words: list[str], ids: list[list[int]]) -> dict[str, int]:
        sizes = [len(x) for x in ids]
        n = sum(sizes)
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(n, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + n] = [i for x in ids for i in x]
        found, at = {}, self.used
        for w, k in zip(words, sizes):
            found[w] = at << 32 | k
            at += k
        self.used = at
        return found

    def add(self, missing: list[str]) -> dict[str, int]:
        """Entries of lower-case words of plain texts."""
        merge, ids = self.tokenizer.model.tokenize, []
        for w in missing:
            if w.isascii() and w.isalpha():
                ids.append([t.id for t in merge(w)])
            else:
                ids.append([t.id for q in _PATTERN.findall(w) for t in merge(byte_level(q))])
        found = self.put(missing, ids)
        self.words.update((w, k) for w, k in found.items() if len(w) <= LONGEST)
        return found

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by END_ID, and how many each text has."""
        if len(self.words) > REMEMBERED or self.used > 16 * REMEMBERED:
            self.forget()
        words, sizes, odd = [], np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            w = None if "<|" in t else plain_words(t)
            if w is None:
                odd.append(i)
                w = [i]
            sizes[i] = len(w)
            words.extend(w)
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            found = self.add(list({words[k] for k in missing if type(words[k]) is str}))
            if odd:
                parts = [[texts[i]] if any(x in texts[i] for x in self.special) else texts[i].split(" ") for i in odd]
                each = sorted({p for x in parts for p in x})
                ids = dict(zip(each, (e.ids for e in self.tokenizer.encode_batch_fast(each, add_special_tokens=False))))
                found |= self.put(odd, [[i for p in x for i in ids[p]] for x in parts])
            at[missing] = [found[words[k]] for k in missing]
        place, n = at >> 32, at & 0xFFFFFFFF
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(place - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.r_[0, ends][np.cumsum(sizes)]
        return np.insert(ids, stops, END_ID), np.diff(np.r_[0, stops]) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, np.dtype("<u4"))
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    rows = v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), rows[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(ids: list[int], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    docs = np.zeros(len(ids), _DOCS)
    docs["id"], docs["n"] = ids, counts
    return _HEAD.pack(b"LTI1", len(ids), len(ranks), len(data)) + docs.tobytes() + control + data


def read_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, values of each, and all ranks of a shard."""
    magic, n, values, size = _HEAD.unpack_from(blob)
    if magic != b"LTI1":
        raise ValueError("not a token shard")
    at = _HEAD.size
    docs = np.frombuffer(blob, _DOCS, n, at)
    at += docs.nbytes
    control = blob[at : at + -(-values // 4)]
    data = blob[at + len(control) : at + len(control) + size]
    if len(data) != size:
        raise ValueError("a token shard is cut short")
    return docs["id"], docs["n"].astype(np.int64), unpack(control, data, values)


def rank_table(counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """rank of each id, and id of each rank: most frequent first, ties by id."""
    n = np.zeros(size, np.int64)
    for k, v in counts.items():
        n[k] = v
    by_rank = np.argsort(-n, kind="stable").astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    return rank, by_rank


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n and the ids: raw little-endian, 16 bits where the vocabulary allows, else 32."""
    narrow = library(path).get_vocab_size() <= 1 << 16

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, 256):
                ids, counts = enc.batch(b.column(1).to_pylist())
                raw = ids.astype("<u2" if narrow else "<u4").tobytes()
                ends = np.cumsum(counts) * (2 if narrow else 4)
                blobs = [raw[s:e] for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def write_shards(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Writes the shards; returns their table (first_id, part, seq, n_docs, n_ids, shard) and the id of each rank.

    Documents are dealt by ranges of doc_id and sorted inside a range; null doc_ids
    come first, repeated ones side by side.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    narrow = library(path).get_vocab_size() <= 1 << 16
    size = library(path).get_vocab_size()
    tokens = staged(token_table(id_text(docs), path), "token-ids")

    def tally(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(blob, "<u2" if narrow else "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rank, by_rank = rank_table({r["id"]: r["n"] for r in counted.collect()}, size)  # at most the vocabulary
    shared = spark.sparkContext.broadcast(rank)

    def shards(batches):
        ranks, ids, counts, held, seq = [], [], [], 0, 0
        lookup = shared.value

        def out():
            blob = write_shard([-1 if i is None else i for i in ids], counts, np.concatenate(ranks))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([ids[0] is None]), pa.array([blob], pa.binary())],
                names=["first_id", "part", "seq", "n_docs", "n_ids", "nulls", "shard"],
            )

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for i, n, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                if ids and (held + n > SHARD_VALUES or (ids[0] is None) != (i is None)):
                    yield out()
                    ranks, ids, counts, held, seq = [], [], [], 0, seq + 1
                ranks.append(lookup[np.frombuffer(blob, "<u2" if narrow else "<u4")])
                ids.append(i)
                counts.append(n)
                held += n
        if ids:
            yield out()

    # Lengths split ranges of one id, such as null.
    dealt = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first(), "n").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    made = dealt.mapInArrow(shards, "first_id long, part int, seq int, n_docs long, n_ids long, nulls boolean, shard binary")
    out = f"{checkpoint_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    made.write.option("compression", "none").parquet(out)
    return spark.read.schema(made.schema).parquet(out), by_rank


def read_back(shards: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards alone."""
    spark = shards.sparkSession
    # One short row for each shard: where it starts is a sum over partitions, then within one.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = shards.select("part", "seq", "n_ids").select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    base = own.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    shared = spark.sparkContext.broadcast(by_rank)

    def run(batches):
        lookup = shared.value
        for b in batches:
            for part, seq, nulls, blob in zip(*(b.column(k).to_pylist() for k in range(4))):
                ids, counts, ranks = read_shard(blob)
                values = lookup[ranks].astype("<u4")
                ends = np.cumsum(counts)
                raw = values.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - counts).tolist(), ends.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.nulls(n, pa.int64()) if nulls else pa.array(ids), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "seq", "nulls", "shard").mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the whole table as shards and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has END_ID alone; `start` counts the ids of all documents
    before it in ascending doc_id order (null doc_ids first).
    """
    return read_back(*write_shards(docs, path))
