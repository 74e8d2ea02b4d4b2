"""BM25 as tables: postings, document and term statistics, impacts, ranked retrieval.

Two ways to the same scores.  `bm25_scores` reads texts once and keeps only the query's
terms.  `postings` is the index: a row per document and term, split by a hash of the
term, so that a query over it (`indexed_scores`) reads a few of its parts and no text.
"""

from __future__ import annotations

import functools
import re
import sys
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import IDENTIFIER, split_identifier, tokens_of

cloudpickle.register_pickle_by_value(sys.modules[tokens_of.__module__])  # tasks need not see this package

K1, B = 1.5, 0.75
#: Parts of the postings, unless said otherwise; a query reads as many as it has terms.
BUCKETS = 64
#: Postings that a task holds at once, about.
PIECE = 200_000
_PLAIN = r"^[A-Za-z][a-z]*$"


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term): a row for each token, identifiers with their parts.  Null texts have none."""
    raw = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IDENTIFIER), F.lit(0))).alias("raw"))
    return raw.select("id", F.explode(F.when(F.col("raw").rlike(_PLAIN), F.array(F.lower("raw"))).otherwise(split_identifier(F.col("raw")))).alias("term"))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    """The part of the postings that a term is in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def buckets_for(chunks: int) -> int:
    """How many parts the postings of so many chunks have: some 20,000 chunks each, 1,024 at most."""
    n = 1
    while n < 1024 and chunks > 20_000 * n:
        n *= 2
    return n


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl) of every row by itself, counted where it is read; nothing moves.

    Rows come in pieces of some PIECE, in order of term, so that they compress well
    wherever they are sent.
    """
    words = re.compile(IDENTIFIER, re.ASCII)

    def run(batches):
        split = functools.lru_cache(maxsize=1 << 16)(tokens_of)
        for b in batches:
            ids, at, terms_, tf, dl = b.column(0), [], [], [], []

            def piece():
                t = pa.table({"id": ids.take(pa.array(at, pa.int64())), "term": pa.array(terms_, pa.string()), "tf": pa.array(tf, pa.int64()), "dl": pa.array(dl, pa.int64())})
                for column in (at, terms_, tf, dl):
                    column.clear()
                return t.take(pc.sort_indices(t, sort_keys=[("term", "ascending")])).combine_chunks().to_batches()

            for i, text in enumerate(b.column(1)):
                counts: Counter[str] = Counter()
                for raw, n in Counter(words.findall(text.as_py() or "")).items():
                    for term in split(raw):
                        counts[term] += n
                at += [i] * len(counts)
                terms_ += counts.keys()
                tf += counts.values()
                dl += [counts.total()] * len(counts)
                if len(at) >= PIECE:
                    yield from piece()
            if at:
                yield from piece()

    rows = _texts(docs, id_col, text_col).where("id is not null")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, term string, tf long, dl long")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """(id, term, tf, dl); repeated ids count as one document.

    Documents are counted where they are read.  Only where ids repeat, of which the ids
    alone are asked unless `unique` says that they don't, counts are brought together.
    """
    rows = counted(docs, id_col, text_col)
    if unique or docs.groupBy(F.col(id_col).alias("id")).count().where("id is not null and count > 1").isEmpty():
        return rows
    tf = rows.groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    dl = tf.groupBy("id").agg(F.sum("tf").alias("dl"))
    return tf.join(dl, "id").select("id", "term", "tf", "dl")


def term_stats(p: DataFrame) -> DataFrame:
    """(term, df, cf) of postings."""
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl) of every row, zero for texts without tokens."""
    words = re.compile(IDENTIFIER, re.ASCII)

    def run(batches):
        split = functools.lru_cache(maxsize=1 << 16)(tokens_of)
        for b in batches:
            n = [sum(len(split(raw)) for raw in words.findall(text.as_py() or "")) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "dl"])

    rows = _texts(docs, id_col, text_col)
    own = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, dl long")
    total = F.sum("dl").over(Window.partitionBy("id"))
    return own.select("id", F.when(F.col("id").isNull(), 0).otherwise(total).alias("dl"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n documents and their mean length in tokens, null for none."""
    tokens = terms(docs, id_col, text_col).agg(F.count(F.lit(1)).alias("t"))
    return docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(tokens)).select("n", (F.col("t") / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))  # one row each


def _impact(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def _none(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score > 0), read from the texts.

    A document's tokens are counted where they are read: its length, and the query's
    terms.  What is shuffled is one short row a document.
    """
    want = Counter(tokens_of(query))
    if not want:
        return _none(docs, id_col)
    names = sorted(want)
    tf = [F.count(F.when(F.col("term") == w, 1)).alias(f"tf{i}") for i, w in enumerate(names)]
    base = terms(docs, id_col, text_col).groupBy("id").agg(F.count(F.lit(1)).alias("dl"), *tf)
    rows = docs.agg(F.count(F.lit(1)).alias("n"))  # texts without tokens count for the mean
    stats = base.agg(F.sum("dl").alias("total"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(names))]).crossJoin(rows)
    hit = base.where(" OR ".join(f"tf{i} > 0" for i in range(len(names)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, w in enumerate(names):
        score = score + want[w] * _impact(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("dl"), F.col("total") / F.col("n"), k1, b)
    return hit.select("id", score.alias("score")).where("score > 0")


def indexed_scores(index: DataFrame, query: str, n: int, avgdl: float, only: DataFrame | None = None, k1: float = K1, b: float = B, buckets: int = BUCKETS) -> DataFrame:
    """(id, score > 0), read from stored postings (id, term, tf, dl, bucket).

    Only the parts of the query's terms are read, of `buckets` that were written.  `only` (column id) restricts the
    result, not the statistics.
    """
    want = Counter(tokens_of(query))
    if not want or not n:
        return _none(index, "id")
    spark = index.sparkSession
    asked = spark.createDataFrame(sorted(want.items()), "term string, mult int")
    parts = [r[0] for r in asked.select(bucket_of(F.col("term"), buckets)).distinct().collect()]
    mine = index.where(F.col("bucket").isin(*parts) & F.col("term").isin(*sorted(want)))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term of the query
    hit = mine.join(F.broadcast(df.join(asked, "term")), "term")
    if only is not None:
        hit = hit.join(only.select("id"), "id", "left_semi")
    score = F.col("mult") * _impact(F.col("tf"), F.col("df"), F.lit(float(n)), F.col("dl"), F.lit(avgdl), k1, b)
    return hit.groupBy("id").agg(F.sum(score).alias("score")).where("score > 0")


def top(scores: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best, ties to the lesser id."""
    return scores.orderBy(F.desc(score), tie).limit(k)
