"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine, 0 when a norm is 0 or the lengths differ."""
    a, b = _c(a), _c(b)
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def mean_vectors(df, by: str, vec: str):
    """Mean vector per group: sums per (group, position) are combined before the shuffle."""
    flat = df.select(by, F.posexplode(vec).alias("_p", "_x"))
    means = flat.groupBy(by, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    # one row per vector position, so the list is as long as the vector
    lists = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_l"))
    return lists.select(by, F.transform("_l", lambda s: s["_m"]).alias(vec))
