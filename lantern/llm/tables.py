"""Shared plumbing: staged tables, source tables and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session, which all executors and the driver see.

    It is what `spark.checkpoint.dir` names.  Only a session without that setting
    (tests on one machine) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.lantern.checkpoint.dir", None)
    if not own:
        own = f"/tmp/checkpoints/lantern-{uuid.uuid4().hex}"
        spark.conf.set("spark.lantern.checkpoint.dir", own)
    return own


#: Bytes of a batch that goes to a Python worker; Spark's default is 64 MB, of which a task holds several copies.
BATCH_BYTES, _BATCHES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of long texts at once.  Sets the session's option where it has the default; any other choice stays."""
    if spark.conf.get(_BATCHES, None) == "67108864b":
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The result has no lineage beyond its files, so losing an executor costs at most
    the tasks that were running.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that are broadcast at most: two longs each, some 10 MB as a hash table.
BROADCAST_ROWS = 100_000


def beside(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of ids, as one side of a join: broadcast if it has `most` rows or fewer, else hashed after a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells rows apart by id and text, null ids included: (the id, or a hash of the text; a hash of the text).

    Rows of one id with different texts differ, and rows that agree in both are one
    row repeated, on which every decision is the same.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), h), h


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int, count: str = "rows") -> DataFrame:
    """Inner join on `keys`, unique in `right`, where a single key may hold any part of `left`.

    `right` has a column `count`, the rows of `left` with its key, which isn't returned;
    `rows` is their sum.  Keys with a thousandth of all rows or more are a thousand at
    most, so they are broadcast; only rows of other keys are shuffled by them.
    """
    hot = F.col(count) * 1000 >= rows
    few = staged(right.where(hot).drop(count), "hot-keys")
    if few.isEmpty():
        return left.join(right.drop(count), keys)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~hot).drop(count), keys)
    return left.join(F.broadcast(few), keys).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the folder's tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    `edges` has columns `src` and `dst` of one orderable type.  Returns `node` and
    `component`, the least node that `node` can reach, for nodes that have an edge to
    another node; self-loops and nulls carry no information and vanish.  Each round is
    aggregations and joins on node ids alone and is staged; neither a task nor the
    driver keeps a component in memory.  Edges of a hub stream through the joins of one
    key, which adaptive execution splits where they are many.  The number of rounds
    grows with the logarithm of the largest component.  A graph that hasn't settled after `max_rounds` raises.
    """
    e = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), name)
    kind = e.schema["src"].dataType
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before or not now[0]:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select("dst", "dst").distinct())
        before = now
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("src"), F.col("m").alias("dst")).union(low.select("a", "m"))
        e = staged(small.where("src <> dst").distinct(), name)
    raise RuntimeError(f"components of {kind.simpleString()} nodes have not settled after {max_rounds} rounds")


LONG_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
