"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """Cosine similarity; 0 for unequal lengths or a zero vector."""
    n = norm(a) * norm(b)
    value = F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) if clamp else value


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def sigmoid(x: Column, limit: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def feature_hash(tokens: Column, width: int = 1024) -> Column:
    """Bag of tokens hashed into `width` counts, at unit length."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)).cast("double"))
    return unit(counts)
