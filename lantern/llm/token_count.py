"""Token counts with a whole-token shortcut (byte-level BPE).

Offline proof: every vocabulary string that is one pre-token is encoded by the
tokenizers library; those that come back as one id are *whole tokens*.  Merging can't
change them, so a pre-token found in that set counts one without any merge.  All
other pre-tokens are merged by the library's model once and remembered in a bounded table.

Pre-tokens here are the stretches between single spaces, each with its leading space:
the byte-level pattern takes a space together with the non-space that follows it, so
it always starts a new match there, and no merge crosses it.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.tables import id_text

LIMIT = 1024
#: Stretches whose count a worker remembers beside the whole tokens, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 64
#: Characters whose classes and case no Unicode version changes, and that composing leaves alone; other text is left to the library.
UNPLAIN = re.compile(r"[^\n\x21-\x7e\xa1-\u024f]")
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: From a byte to the character that stands for it in a byte-level vocabulary: the printed ones are themselves.
_STAND_INS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def byte_level(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_STAND_INS)
_DOUBLE = re.compile(r"\s\s")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that encode, alone, as one token."""
    t = library(path)
    n = t.get_vocab_size(with_added_tokens=False)
    texts = sorted({x for x in t.decode_batch([[i] for i in range(n)], skip_special_tokens=False) if x and "�" not in x})
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    found = lengths(t, texts)
    return frozenset(x for x, k in zip(texts, found) if k == 1 and x not in special)


class Counter:
    """Counts tokens of whole texts; one per worker."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        self.tokenizer = library(path)
        self.special = tuple(a.content for a in self.tokenizer.get_added_tokens_decoder().values())
        whole = whole_tokens(path) if whole is None else whole
        self.whole = whole
        #: Stretches after a space, keyed without it.
        self.known = {x[1:]: 1 for x in whole if x[0] == " " and len(x) > 1 and not re.search(r"\s", x[1:])}
        self.base = dict(self.known)

    def merged(self, parts: list[str]) -> dict[str, int]:
        """Tokens of stretches with their leading space: whole tokens count one, the rest are merged."""
        out, left, whole, merge = {}, [], self.whole, self.tokenizer.model.tokenize
        for p in parts:
            if UNPLAIN.search(p):
                left.append(p)
            else:
                out[p] = sum(1 if q in whole else len(merge(byte_level(q))) for q in _PATTERN.findall(" " + p))
        if left:
            out.update(zip(left, lengths(self.tokenizer, [" " + p for p in left])))
        return out

    def batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        odd, firsts, parts, sizes = [], [], [], []
        for i, t in enumerate(texts):
            if not t or any(s in t for s in self.special):
                odd.append(i)
                sizes.append(0)
                continue
            pieces = _SPACE.split(t) if t[0].isspace() or t[-1].isspace() or _DOUBLE.search(t) else t.split(" ")
            firsts.append((i, pieces[0]))
            sizes.append(len(pieces) - 1)
            parts.extend(pieces[1:])
        known = self.known
        counts = list(map(known.get, parts))
        missing = list({p for p, c in zip(parts, counts) if c is None})
        if missing:
            found = self.merged(missing)
            counts = [found[p] if c is None else c for p, c in zip(parts, counts)]
            if len(known) + len(found) > REMEMBERED + len(self.base):
                known = self.known = dict(self.base)
            known.update((p, c) for p, c in found.items() if len(p) <= LONGEST)
        sizes = np.array(sizes, np.int64)
        total = np.r_[0, np.cumsum(np.array(counts, np.int64))] if counts else np.zeros(1, np.int64)
        ends = np.cumsum(sizes)
        out += total[ends] - total[ends - sizes]
        if firsts:
            out[[i for i, _ in firsts]] += lengths(self.tokenizer, [p for _, p in firsts])
        if odd:  # a special string inside a text: the library's own reading of the whole text
            out[odd] += lengths(self.tokenizer, [texts[i] for i in odd])
        return out


_counters: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def slices(batch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row; a null text is empty and has no tokens.

    Rows stay rows: repeated and null doc_ids come out as they came in.
    """
    path = path or default_vocabulary()
    # Proved once, by the driver; the set is part of a vocabulary, so its size has a bound.
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches):
        count = counter(path, proven.value)
        for whole in batches:
            for b in slices(whole):
                texts = b.column(1).to_pylist()
                n = count.batch(texts)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
