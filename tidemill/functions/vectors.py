"""Vector arithmetic on array<float> columns: Column to Column, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(a: Column, b: Column, result: Column) -> Column:
    return F.when(F.size(a) == F.size(b), result).otherwise(F.raise_error(F.lit("vectors differ in length")))


def add(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def mul(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _same_length(a, b, F.aggregate(products, F.lit(0.0), lambda s, p: s + p))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite between vectors of different lengths."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, p: s + p)))


def show(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))


def pad(a: Column, width: int = 8) -> Column:
    """Zeros appended up to a multiple of width."""
    return F.concat(a, F.array_repeat(F.lit(0).cast("float"), F.pmod(-F.size(a), F.lit(width)).cast("int")))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("float"), n)


def uniform(n: int, low: float, high: float, seed: Column) -> Column:
    """n values in [low, high), the same for the same seed."""
    span = (1 << 24) - 1
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (low + (high - low) * F.xxhash64(seed, i).bitwiseAND(span) / (span + 1)).cast("float"))


def score(distance: Column) -> Column:
    """1 for equal vectors, falling to 0."""
    return 1 / (1 + distance)


def similarity(distance: Column) -> Column:
    return 1 - distance
