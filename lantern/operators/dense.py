"""Exact vector retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions.columns import unused
from lantern.functions.vectors import as_double, bucket, cosine, dot, let, norm
from lantern.operators.lexical import terms

#: Rows of a block of vectors, and products that a task holds at once.
BLOCK, PIECE = 1_024, 65_536


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", only: DataFrame | None = None) -> DataFrame:
    """(id, distance, score) of the k nearest by cosine distance; `only` (column id) restricts the candidates first.

    Vectors that are null, hold a null or have another length than the query aren't
    compared; a zero vector scores zero; ties go to the lesser id.
    """
    v = vectors.select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v")).where(F.size("v") == len(query))
    if only is not None:
        v = v.join(only.select("id"), "id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = v.select("id", cosine(F.col("v"), q).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.withColumn("distance", 1 - F.col("score")).orderBy("distance", "id").limit(k)


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """(ids, dim, data): up to `rows` vectors of one length as the bytes of a matrix, a dimension after the other; dim is -1 where a vector is null or holds a null."""
    base = vectors.select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v"))

    def run(batches):
        for b in batches:
            ids, v = b.column(0), b.column(1)
            dims = np.array([-1 if x is None else x for x in pc.list_value_length(v).to_pylist()], dtype=np.int64)
            parents, values = pc.list_parent_indices(v), pc.list_flatten(v)
            if values.null_count:
                dims[parents.filter(pc.is_null(values)).to_numpy(zero_copy_only=False)] = -1
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), rows):
                    some = pa.array(at[i : i + rows])
                    flat = pc.list_flatten(v.take(some)).to_numpy(zero_copy_only=False) if dim > 0 else np.zeros(0)
                    data = np.ascontiguousarray(flat.reshape(len(some), max(dim, 0)).T).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(some)), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], names=["ids", "dim", "data"])

    return base.mapInArrow(run, f"ids array<{dict(base.dtypes)['id']}>, dim int, data binary")


def similarity(left: DataFrame, right: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Raw products of a stated set of queries with all rows: (left, right, similarity); null where a vector is null or lengths differ.

    Both sides are packed in blocks of BLOCK rows, and the pairs of blocks are dealt over
    all tasks: a task holds two blocks and a piece of their products, however many rows
    there are.  A product is summed in order of dimension, as `dot` does.
    """
    spark = right.sparkSession
    a = _blocks(left.repartition(4), id_col, vec_col, BLOCK).select(F.col("ids").alias("left"), F.col("dim").alias("m"), F.col("data").alias("a"))
    b = _blocks(right, id_col, vec_col, BLOCK).select(F.col("ids").alias("right"), F.col("dim").alias("n"), F.col("data").alias("b"))
    pairs = b.repartition(4 * spark.sparkContext.defaultParallelism).crossJoin(a)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries, ids = batch["left"][i].values, batch["right"][i].values
                m, n = batch["m"][i].as_py(), batch["n"][i].as_py()
                same = m == n >= 0
                x = np.frombuffer(batch["a"][i].as_buffer(), np.float64).reshape(max(m, 0), len(queries))
                y = np.frombuffer(batch["b"][i].as_buffer(), np.float64).reshape(max(n, 0), len(ids))
                step = max(1, PIECE // len(ids))
                for j in range(0, len(queries), step):
                    some = queries[j : j + step]
                    sums = np.zeros((len(some), len(ids)))
                    part = np.empty_like(sums)
                    for d in range(m if same else 0):
                        sums += np.multiply(x[d, j : j + step, None], y[d], out=part)
                    out = pa.array(sums.ravel()) if same else pa.nulls(sums.size, pa.float64())
                    lefts = some.take(pa.array(np.repeat(np.arange(len(some)), len(ids))))
                    yield pa.RecordBatch.from_arrays([lefts, pa.concat_arrays([ids] * len(some)), out], names=["left", "right", "similarity"])

    kinds = dict(left.dtypes)[id_col], dict(right.dtypes)[id_col]
    return pairs.mapInArrow(run, f"left {kinds[0]}, right {kinds[1]}, similarity double")


def put(vectors: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """`vectors` with those of `new` added, in place of theirs where an id is in both."""
    return vectors.join(new.select(id_col), id_col, "left_anti").unionByName(new.select(*vectors.columns))


def drop(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """`vectors` without those of `ids`."""
    return vectors.join(ids.select(id_col), id_col, "left_anti")


def vector_of(vectors: DataFrame, key, id_col: str = "id", vec_col: str = "vector") -> list[float] | None:
    """The vector of an id, or None."""
    row = vectors.where(F.col(id_col) == key).select(vec_col).first()
    return None if row is None else row[0]


def hash_vectors(docs: DataFrame, dim: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v): the hash embedding of every document, counted by aggregation; zeros for texts without tokens.

    The same as the column `hash_embedding` gives, without a function of each token and
    dimension.  Ids must not repeat; null ids give zeros.
    """
    at = terms(docs, id_col, text_col).select("id", bucket(F.col("term"), dim).alias("b"))
    counts = at.groupBy("id").agg(F.array(*[F.count(F.when(F.col("b") == i, 1)).cast("double") for i in range(dim)]).alias("c"))
    rows = docs.select(F.col(id_col).alias("id")).join(counts, "id", "left")
    scaled = let(norm(F.col("c")), lambda n: F.transform("c", lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return rows.select("id", F.coalesce(scaled, F.array(*[F.lit(0.0)] * dim)).alias("v"))


def ranked(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(rank, id, score, and other columns) of the k best by raw product, ties to the lesser id."""
    from pyspark.sql import Window

    (mark,) = unused(vectors, "product")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn(mark, dot(as_double(F.col(vec_col)), q)).where((F.size(vec_col) == len(query)) & F.col(mark).isNotNull())
    best = scored.orderBy(F.desc(mark), id_col).limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(mark), id_col)  # k rows
    return best.withColumn("rank", F.row_number().over(order)).drop(vec_col).withColumnRenamed(mark, "score")
