"""Vector functions over array columns, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _products(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_products(a, a))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _products(a, b)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for different lengths, empty vectors and zero norms."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), _products(a, b) / length).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; 0 for different lengths and zero norms."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), (_products(a, b) / length + 1) / 2).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; the largest float for different lengths."""
    squares = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.sqrt(squares)).otherwise(F.lit(3.4028234663852886e38))


def normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def mean_of_two(a: Column, b: Column) -> Column:
    """The normalized mean of two vectors."""
    return normalize(F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: element-wise means, aggregated by dimension, so no group is collected."""
    dims = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = dims.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("all"))
    return ordered.select(group, F.transform("all", lambda s: s["x"]).alias("centroid"))
