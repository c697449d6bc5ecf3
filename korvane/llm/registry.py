"""The named queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Bounds what one Arrow batch holds, so that very long texts do not add up in a worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
           "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def bounded(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(bounded(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register
