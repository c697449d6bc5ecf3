"""Sinks for ranked lists and metric tables. Every writer writes its partitions in
parallel; none gathers rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

TEXT_CHARS = 500


def results_rows(df: DataFrame, chars: int | None = TEXT_CHARS) -> DataFrame:
    """The exported columns, the body cut to ``chars`` characters."""
    return df.select("query", F.col("id").alias("offset"), "score", "strategy", "ten",
                     tx.head("noidung", chars).alias("noidung"))


# texts keep their line breaks, quotes and outer blanks
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False}


def write_results_csv(df: DataFrame, path: str, chars: int | None = TEXT_CHARS) -> None:
    results_rows(df, chars).write.mode("overwrite").options(**CSV).csv(path)


def write_by_category(df: DataFrame, path: str, category="category") -> None:
    """One folder per category; ``/`` in the name becomes ``-``.

    Rows are spread by category and a hash, so a large category is several files written by
    several tasks.
    """
    spread = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(16))
    (df.withColumn(category, F.regexp_replace(category, "/", "-"))
     .repartition(category, spread).write.mode("overwrite").partitionBy(category)
     .options(**CSV).csv(path))


def write_results_json(df: DataFrame, path: str) -> None:
    """One line per query with its ranked list (bounded by the candidate cut)."""
    rows = F.struct("rank", F.col("id").alias("offset"), "score", "strategy", "ten", "noidung")
    (df.groupBy("query").agg(F.array_sort(F.collect_list(rows)).alias("results"))
     .write.mode("overwrite").json(path))


def metric_table(averages: DataFrame, k: int, metrics) -> DataFrame:
    """Flat table of one cut-off: a column per metric."""
    return (averages.filter(F.col("k") == k).groupBy("strategy")
            .pivot("metric", list(metrics)).agg(F.first("value")))


def write_metric_table(averages: DataFrame, k: int, retrieval, response, path: str) -> None:
    wide = metric_table(averages, k, [*retrieval, *response])
    names = {m: f"Retrieval_{m}" for m in retrieval} | {m: f"Response_{m}" for m in response}
    wide.withColumnsRenamed(names).write.mode("overwrite").option("header", True).csv(path)


def write_load(good: DataFrame, bad: DataFrame, target: str, errors: str,
               resume: bool = True) -> None:
    """Append (or start over) the good rows; bad rows go to the error table."""
    good.write.mode("append" if resume else "overwrite").parquet(target)
    bad.write.mode("append" if resume else "overwrite").parquet(errors)
