"""Column expressions over array<double> feature vectors. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, factor: Column | float) -> Column:
    return F.transform(v, lambda x: x * factor)


def add(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return out


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps)."""
    return let(norm(v) + eps, lambda n: F.transform(v, lambda x: x / n))


def finite(v: Column) -> Column:
    """NaN and infinite components become 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def tiled(v: Column, channels: int) -> Column:
    """The first `channels` components of v repeated as often as needed."""
    repeats = F.ceil(F.lit(channels) / F.size(v)).cast("int")
    return F.slice(F.flatten(F.array_repeat(v, repeats)), 1, channels)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance3(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_column(low)), as_column(high))
