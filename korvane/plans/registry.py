"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as long and floats as double, so results compare by value."""
    casts = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint",
             T.FloatType: "double"}
    todo = {f.name: F.col(f.name).cast(casts[type(f.dataType)]) for f in df.schema.fields
            if type(f.dataType) in casts}
    return df.withColumns(todo) if todo else df


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: _wide(fn(prepare(spark), sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register
