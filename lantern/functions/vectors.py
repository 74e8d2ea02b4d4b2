"""Vectors as array columns: products, cosine distance and an offline hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    """The vector in double precision, in which all products are summed."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Product of two vectors, summed in order; null if a value is missing on either side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-10 added to both lengths, so zero vectors give zero."""
    return dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10))


def bucket(token: Column, dim: int) -> Column:
    """Bucket of a token by the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_embedding(tokens: Column, dim: int) -> Column:
    """L2-normalised counts of token buckets; zeros for no tokens."""

    def counts(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda k: k == i)).cast("double"))

    def scaled(c: Column) -> Column:
        return let(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return let(let(F.transform(tokens, lambda t: bucket(t, dim)), counts), scaled)
