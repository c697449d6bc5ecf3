"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from korvane.llm import jaccard, line_dedup, quality_rules, sentencepiece_sa, winnowing
from korvane.llm.registry import bounded, table
from korvane.session import materialize

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
NEAR = jaccard.Scheme(n=5, p=80, q=100)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents outside the compression bands go."""
    bounded(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that repeat an earlier line go; what is left is counted anew."""
    bounded(spark)
    left = line_dedup.drop_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words and 0.8: the first document of each group stays."""
    bounded(spark)
    return jaccard.keep_one(docs, scheme=NEAR)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go."""
    return winnowing.drop_contaminated(docs, table(bounded(spark), sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    bounded(spark)
    model = sentencepiece_sa.Model.read(PIECES)
    both = sentencepiece_sa.decode(sentencepiece_sa.encode(docs.select("doc_id", "text"), model),
                                   model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near),
          ("benchmark decontamination", clean), ("SentencePiece encoding and decoding", tokens)]

#: The compression bands are not SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(bounded(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
