"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

1. A character trigram model is counted over all documents.
2. Spans that look disguised (symbols or digits for letters, letters spaced out, letters
   repeated) become character lattices: what each sign may stand for, with a channel
   cost.  Viterbi finds the cheapest path under channel and character model.
3. Words and word beginnings of restored texts that are much more frequent in toxic than
   in clean labelled documents are the features of a logistic regression.

Labels are learned only from rows with crc32(doc_id as text) % 3 <> 1, from at most
`MAX_TRAIN` of them (those with the smallest hash of their doc_id).
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.tables import id_text, staged, unused
from lantern.llm.token_count import slices

THRESHOLD = 0.7
#: Labelled rows that are learned from at most.
MAX_TRAIN = 20_000
PREFIXES = (4, 5, 6, 7)
#: Toxic documents that a feature needs, and how many times likelier it has to be there.
MIN_TOXIC, MIN_RATIO = 3, 8.0
SYMBOLS = 28  # 0 boundary, 1-26 a-z without marks, 27 other letters
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Channel costs in nats: a sign for a letter, the sign itself, a run cut to one or to two letters, a gap closed or kept.
SWAP, KEEP, ONE, TWO, CLOSE, OPEN = 1.0, 7.0, 0.4, 1.2, 0.2, 1.0
_RUN, _SIGN, _LETTER = re.compile(r"\S+"), re.compile(r"[0-9@$!|+]"), re.compile(r"[^\W\d_]")
#: Within a run without white space: starts and ends of matches never overlap, so every run costs linear time.
_LEET_TOKEN = re.compile(r"(?<![^\"'(\[])(?:[^\W_]|[@$|+]|!(?=\w))+(?![^.,;:!?\"')\]])")
_SPACED = re.compile(r"(?<![^\s\"'(\[])(?:[^\W_]|[@$|+!])(?:([ .\-_*])(?:[^\W_]|[@$|+!]))(?:\1(?:[^\W_]|[@$|+!])){2,}(?![^\s.,;:!?\"')\]])")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")


def _fold() -> np.ndarray:
    import unicodedata

    out = np.zeros(0x300, np.uint8)
    for c in range(0x300):
        s = unicodedata.normalize("NFD", chr(c).lower())[:1]
        out[c] = ord(s) - 96 if "a" <= s <= "z" else 27 if chr(c).isalpha() else 0
    return out


_FOLD = _fold()
#: Of Latin-1: a letter, L digit or sign for a letter, E exclamation mark, space for white space and gaps, else x.
_KINDS = bytes(ord("a" if chr(c).isalpha() else "E" if chr(c) == "!" else "L" if chr(c) in LEET else " " if chr(c).isspace() or chr(c) in ".-_*" else "x") for c in range(256))


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _FOLD[np.minimum(c, 0x2FF)]


def _trigrams(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for whole in batches:
        for b in slices(whole, 256):
            s = symbols("\n\n" + "\n\n".join(b.column(1).to_pylist()) + "\n\n").astype(np.int32)
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (nats) of a symbol after two others, counted over every text; SYMBOLS**3 numbers whatever the input."""
    counts = np.zeros(SYMBOLS**3)
    for r in id_text(docs).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return model_of(counts)


def model_of(counts: np.ndarray) -> np.ndarray:
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return -np.log(p3)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """What each sign of a disguised span may stand for, with its cost."""
    spaced = bool(_SPACED.fullmatch(span))
    out = []
    for c, run in groupby(span):
        n = len(list(run))
        low = c.lower()
        if spaced and c in " .-_*":
            out.append([("", CLOSE), (" ", OPEN)])
        elif low.isalpha():
            if n >= 3:
                out.append([(low, ONE), (low * 2, TWO)])
            else:
                out += [[(low, 0.0)]] * n
        elif c in LEET:
            options = [(x, SWAP) for x in LEET[c]] + [(c, KEEP)]
            out += [options] * (n if n < 3 else 1)
        else:
            out += [[(c, 0.0)]] * n
    return out


def viterbi(span: str, cost: np.ndarray) -> str:
    """The cheapest reading of a span, between two boundaries; ties go to the first listed."""
    code = lambda ch: int(_FOLD[ord(ch)]) if ord(ch) < 0x300 else 27
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, path) in states.items():
            for text, price in options:
                x, y, t = a, b, total + price
                for ch in text:
                    s = code(ch)
                    t += cost[x, y, s]
                    x, y = y, s
                if (x, y) not in new or t < new[x, y][0]:
                    new[x, y] = (t, (path, text))
        states = new
    _, path = min(((t + cost[a, b, 0], path) for (a, b), (t, path) in states.items()), key=lambda r: r[0])
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def suspicious(text: str) -> bool:
    """False only if no pattern of a disguise can match."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    k = raw.translate(_KINDS)
    if b"aL" in k or b"La" in k or b"Ea" in k:
        return True
    tight = k.replace(b"E", b"a").replace(b"L", b"a")
    if b"a a a a" in tight:
        return True
    v = np.frombuffer(raw.lower(), np.uint8)
    same = (v[2:] == v[1:-1]) & (v[1:-1] == v[:-2])
    return bool(same.any()) and _TRIPLE.search(text.lower()) is not None


def leet_spans(text: str):
    """(start, end) of tokens with a digit or sign that may stand for a letter, and a letter, in the rest of their run."""
    for m in _RUN.finditer(text):
        run = m[0]
        if run.isalpha() or not _SIGN.search(run):
            continue
        back = run[::-1]
        letter = _LETTER.search(back)
        if letter:
            last = len(run) - 1 - max(letter.start(), _SIGN.search(back).start())
            for t in _LEET_TOKEN.finditer(run):
                if t.start() > last:
                    break
                yield m.start() + t.start(), m.start() + t.end()


def repeat_spans(text: str):
    """(start, end) of words that have a letter three times in a row."""
    done = 0
    for m in _TRIPLE.finditer(text):
        if m.start() >= done:
            start = m.start()
            while start > done and _LETTER.match(text, start - 1):
                start -= 1
            rest = _WORD.match(text, m.end())
            done = rest.end() if rest else m.end()
            yield start, done


class Restorer:
    """Restored texts; spans of up to 64 characters that came before are remembered, up to a bound.

    Time is linear in the text: every pattern visits a character a bounded number of times.
    """

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.remembered = functools.lru_cache(maxsize=50_000)(lambda span: viterbi(span, cost))

    def read(self, span: str) -> str:
        return self.remembered(span) if len(span) <= 64 else viterbi(span, self.cost)

    def replaced(self, text: str, spans) -> str:
        out, at = [], 0
        for s, e in spans:
            out += [text[at:s], self.read(text[s:e])]
            at = e
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        if not suspicious(text):
            return text
        text = _SPACED.sub(lambda m: self.read(m[0]), text)
        text = self.replaced(text, leet_spans(text)).lower()
        return self.replaced(text, repeat_spans(text))


def features(restored: str) -> set[str]:
    words = set(_WORD.findall(restored.lower()))
    out = set(words)
    for k in PREFIXES:
        out.update(w[:k] + "*" for w in words if len(w) >= k)
    return out


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of at most `max_train` labelled documents that may be learned from, copies once."""
    mine = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    mine = mine.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = mine.orderBy(F.xxhash64("id"), "id").limit(max_train)  # the bound
    rows = id_text(docs).join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text", "toxic")
    return rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(rows: list[tuple[int, list[int]]], n: int, ridge: float = 0.005, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on 0/1 features (gradient steps scaled by their past)."""
    y = np.array([r[0] for r in rows], float)
    col = np.array([c for r in rows for c in r[1]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    w, b = np.zeros(n), 0.0
    if not len(rows) or y.min() == y.max():
        return w, (-3.0 if not len(rows) or y.max() == 0 else 3.0)
    g2, gb2 = np.zeros(n), 0.0
    for _ in range(steps):
        z = b + np.bincount(row, w[col], minlength=len(rows))
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, d[row], minlength=n) + ridge * w
        gb = d.sum()
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w = w - 0.5 * g / (np.sqrt(g2) + 1e-9)
        b = b - 0.5 * gb / (math.sqrt(gb2) + 1e-9)
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, cost: np.ndarray, max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """(weight of each feature, intercept)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(cost)

    def extract(batches):
        restore = Restorer(shared.value)
        for whole in batches:
            for b in slices(whole, 512):
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(features(restore(t))) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["toxic", "has"])

    rows = staged(train_rows(docs, labels, max_train).mapInArrow(extract, "toxic int, has array<string>"), "tox-train")
    size = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = size["t"] or 0, size["n"] or 0
    counts = rows.select("toxic", F.explode("has").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    p, q = F.col("t") / F.lit(toxic + 1.0), (F.col("c") + 0.5) / F.lit(n - toxic + 1.0)
    # Of MAX_TRAIN rows at most, as are the rows below: what comes to the driver doesn't grow with the corpus.
    names = [r["feature"] for r in counts.where((F.col("t") >= MIN_TOXIC) & (p >= MIN_RATIO * q)).withColumn("gain", F.col("t") * F.log(p / q)).orderBy(F.desc("gain"), "feature").select("feature").collect()]
    index = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def design(batches):
        at = index.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(at[x] for x in has if x in at) for has in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "cols"])

    got = sorted((r["toxic"], list(r["cols"])) for r in rows.mapInArrow(design, "toxic int, cols array<int>").collect())
    w, b = fit(got, len(names))
    return {x: float(v) for x, v in zip(names, w) if abs(v) > 1e-4}, b


class Scorer:
    """Scores of texts under a learned model."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], bias: float):
        self.restore, self.bias = Restorer(cost), bias
        self.words = {x: v for x, v in weights.items() if x[-1] != "*"}
        self.starts = {k: {x[:-1]: v for x, v in weights.items() if x[-1] == "*" and len(x) == k + 1} for k in PREFIXES}

    def __call__(self, text: str) -> float:
        words = set(_WORD.findall(self.restore(text).lower()))
        z = self.bias + math.fsum(self.words[w] for w in words & self.words.keys())
        for k, table in self.starts.items():
            if table:
                z += math.fsum(table[x] for x in {w[:k] for w in words if len(w) >= k} & table.keys())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _model(docs: DataFrame, labels: DataFrame, max_train: int):
    cost = character_model(docs)
    return docs.sparkSession.sparkContext.broadcast((cost, *learn(docs, labels, cost, max_train)))


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Every row: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Null and empty texts get the score of a text without features; null doc_ids count
    as not held out; repeated rows stay; without labels everything scores low.
    """
    shared = _model(docs, labels, max_train)

    def run(batches):
        score = Scorer(*shared.value)
        for whole in batches:
            for b in slices(whole, 512):
                scores = [score(t) for t in b.column(1).to_pylist()]
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([i is not None and held_out(i) for i in ids]), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
                )

    return id_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of `docs` whose text isn't predicted toxic, with all their columns.

    Every row is judged by itself where it is read, so there is no join: null and
    repeated doc_ids need no care, and no row moves.
    """
    shared = _model(docs, labels, max_train)
    if isinstance(docs.schema["text"].dataType, T.StringType):
        rows, at = docs, docs.columns.index("text")
    else:
        rows, at = docs.withColumn(unused(docs, "judged")[0], F.col("text").cast("string")), len(docs.columns)
    width = len(docs.columns)

    def run(batches):
        score = Scorer(*shared.value)
        for whole in batches:
            for b in slices(whole, 512):
                fine = [score(t or "") < THRESHOLD for t in b.column(at).to_pylist()]
                yield b.select(range(width)).filter(pa.array(fine, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
