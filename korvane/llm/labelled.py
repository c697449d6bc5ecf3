"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_col: Column) -> Column:
    """Rows whose id no training sees: a third by checksum; a null id is never trained on."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled documents outside the held-out third.

    The sample is the documents with the smallest hash of their id, so it does not depend on the
    order of the rows. Labels without an id or a value are left out; of an id with several labels
    the largest counts, and of one with several texts all are used.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))) \
        .groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most ``most`` rows of two numbers
    return texts.join(F.broadcast(known), "id")
