"""Readers for the file and table shapes the corpus comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import EVAL_SCHEMA, MESSAGE


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_tables(spark: SparkSession, src: str, names, jdbc: dict | None = None) -> dict[str, DataFrame]:
    """Tables by name, from parquet or over JDBC.

    ``jdbc`` holds the connection options and, per table, ``partitionColumn`` with its bounds
    under ``partitions`` so that the read is split.
    """
    if jdbc is None:
        return {n: read_table(spark, src, n) for n in names}
    options = {k: v for k, v in jdbc.items() if k != "partitions"}
    parts = jdbc.get("partitions", {})
    return {n: spark.read.format("jdbc").options(url=src, dbtable=n, **options,
                                                 **parts.get(n, {})).load() for n in names}


# JSON inputs are one array per file, or one object per line (``lines``), which splits.

def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Topic or subtopic catalog: objects with Value, Text, STT and maybe ChuDe."""
    raw = spark.read.schema("Value string, Text string, STT string, ChuDe string") \
        .option("multiLine", not lines).json(path)
    return raw.select(F.col("Value").alias("id"), F.col("Text").alias("ten"),
                      F.col("STT").try_cast("int").alias("stt"), F.col("ChuDe").alias("chude_id"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Page tree nodes."""
    raw = spark.read.schema("MAPC string, TEN string, ChiMuc string, DeMucID string, "
                            "ChuDeID string").option("multiLine", True).json(path)
    return raw.select(F.col("MAPC").alias("mapc"), F.col("TEN").alias("ten"),
                      F.col("ChiMuc").alias("chimuc"), F.col("DeMucID").alias("demuc_id"),
                      F.col("ChuDeID").alias("chude_id"))


def shape_pages(raw: DataFrame, page_id: Column | None = None) -> DataFrame:
    """(page_id, file_name, html) of whole-text rows; id = file stem unless given, byte-order
    mark gone."""
    name = F.col("_metadata.file_name")
    stem = F.split_part(name, F.lit("."), F.lit(1)) if page_id is None else page_id
    return raw.select(stem.alias("page_id"), name.alias("file_name"),
                      F.regexp_replace("value", "^﻿", "").alias("html"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per HTML file."""
    return shape_pages(spark.read.text(path, wholetext=True).select("value", "_metadata"))


def pages_after(pages: DataFrame, checkpoint: str | None, name="file_name") -> DataFrame:
    """Files from the checkpoint file on, in name order."""
    return pages if not checkpoint else pages.filter(F.col(name) >= checkpoint)


def read_docs(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Search documents."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_eval(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", not lines).json(path)


CHAT_JSON = ("struct<title:string,pinned:boolean,created_at:string,updated_at:string,messages:"
             f"{MESSAGE.simpleString()}>").replace("messages:struct", "messages:array<struct") + ">"


def parse_chats_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Chats of a JSON text that is an object by chat id or a list (keyed by index)."""
    as_map = F.from_json(col, f"map<string,{CHAT_JSON}>")
    as_list = F.from_json(col, f"array<{CHAT_JSON}>")
    is_list = F.ltrim(F.col(col)).startswith("[")
    keyed = F.when(is_list, F.transform(as_list, lambda c, i: F.struct(
        i.cast("string").alias("key"), c.alias("value")))).otherwise(F.map_entries(as_map))
    flat = df.select(F.explode(keyed).alias("e"))
    return flat.select(F.col("e.key").alias("chat_id"), "e.value.*")


def read_chats_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_chats_json(spark.read.text(path, wholetext=True))
