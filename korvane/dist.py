"""Skew-safe building blocks used by the operators.

Top-k and keep-first are written as ``row_number`` cuts: Spark then plans a partial
``WindowGroupLimit`` before the shuffle, so a key that owns a third of the rows sends at
most k rows per task. Numbering that has no cut goes over Spark's ranges of the sort key instead
of one window per group, so neither a global order nor a hot group ends in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import materialize


def bounded_rows(df: DataFrame, max_rows: int):
    """The rows of ``df`` if there are at most ``max_rows``, else ``None``.

    The driver never holds more than ``max_rows + 1`` rows.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def _cols(names) -> list[Column]:
    names = [names] if isinstance(names, (str, Column)) else list(names)
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_per(df: DataFrame, by, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per ``by`` in ``order``, with their 1-based rank."""
    w = W.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per(df: DataFrame, by, order) -> DataFrame:
    """The first row per ``by`` in ``order``."""
    return top_per(df, by, order, 1, "_first").drop("_first")


# ---- positions ----------------------------------------------------------------------

def _placed(df: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """``df`` with ``_i``, its consecutive number from 0 in key order.

    Spark's range partitioning deals the rows out; equal keys are told apart by a hash of the
    whole row, so a repeated key is spread as well. The sorted ranges are written once: what a row
    found as its place there stays its place, and one count per range gives the offsets.
    """
    tie = F.xxhash64(*[c for c in df.columns])
    ranged = (df.withColumn("_tie", tie).repartitionByRange(*([parts] if parts else []), *keys, "_tie")
              .sortWithinPartitions(*keys, "_tie").drop("_tie"))
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    # one row per range
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn("_i", row + F.col("_off")).drop("_p", "_at", "_off"))


def number_rows(df: DataFrame, keys, name: str = "id", start: int = 1,
                parts: int | None = None) -> DataFrame:
    """Consecutive numbers over the whole table in key order, without a global window."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _placed(df, keys, parts).withColumn(name, (F.col("_i") + start).cast("long")).drop("_i")


def position_within(df: DataFrame, group, order, name: str = "pos", start: int = 0,
                    parts: int | None = None) -> DataFrame:
    """Running number inside each group; a hot group is spread over many ranges.

    A group is contiguous in (group, order), so a row's position is its number in the table less
    the smallest number of its group.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, str) else list(order)
    rows = materialize(_placed(df, group + order, parts), "numbered")
    first = materialize(rows.groupBy(*group).agg(F.min("_i").alias("_first")), "group-starts") \
        .select(*[F.col(g).alias(f"_o_{g}") for g in group], "_first")
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(first[f"_o_{g}"]) for g in group])
    return (rows.join(first, same)
            .withColumn(name, (F.col("_i") - F.col("_first") + start).cast("long"))
            .drop("_i", "_first", *[f"_o_{g}" for g in group]))
