"""Inputs the named queries share, in Spark and in SQL.

Stand-ins: the mean vector of each embedding label is a query whose text is the benchmark
item of the same number and whose gold documents are the vectors of that label; documents
are articles (source = topic, lang = subtopic, both = chapter, first line = title).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import mean_vectors
from ..operators.fusion import attach
from ..operators.vector import semantic_search
from ..sources.readers import read_table

# SQL fragments -------------------------------------------------------------------------
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = "[^" + WS[1:]
WCLS = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WCLS}+')"


def s_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def s_passage(p: str = "") -> str:
    parts = ", ".join(f"nullif({p}{c}, '')" for c in
                      ("tenchude", "tendemuc", "tenchuong", "ten", "noidung"))
    return f"concat_ws(chr(10), {parts})"


VECTORS_SQL = """
comp AS (SELECT label, i, avg(x) AS m FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i
    FROM embeddings) GROUP BY label, i),
qv AS (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS query_vec FROM comp GROUP BY label),
ev AS (SELECT vec_id AS id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT query_id, id, label, round(list_inner_product(query_vec, e) /
    (sqrt(list_inner_product(query_vec, query_vec)) * sqrt(list_inner_product(e, e))), 12) AS score
    FROM qv, ev),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM sims)"""

DOCS_SQL = """
docs AS (SELECT doc_id AS id, doc_id::VARCHAR AS mapc, split_part(text, chr(10), 1) AS ten,
    text AS noidung, lang || '-' || source AS tenchuong, lang AS tendemuc, source AS tenchude,
    source AS vbqppl FROM documents),
qt AS (SELECT item_id AS query_id, text AS q_text FROM benchmark)"""

HITS_SQL = VECTORS_SQL + "," + DOCS_SQL + """,
hits AS (SELECT r.query_id, r.id, r.label, r.score, r.rank, q.q_text, r.id::VARCHAR AS mapc,
    coalesce(d.ten, '') AS ten, coalesce(d.noidung, '') AS noidung, coalesce(d.tenchuong, '') AS tenchuong,
    coalesce(d.tendemuc, '') AS tendemuc, coalesce(d.tenchude, '') AS tenchude,
    coalesce(d.vbqppl, '') AS vbqppl
    FROM ranked r JOIN qt q USING (query_id) LEFT JOIN docs d USING (id))"""


# Spark inputs --------------------------------------------------------------------------

def table(spark, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def with_vector(spark, d, rows: DataFrame, id_col: str) -> DataFrame:
    """Every row with the vector whose number is its id modulo the number of vectors."""
    e = table(spark, d, "embeddings")
    return rows.join(e, F.pmod(F.col(id_col), F.lit(e.count())) == F.col("vec_id"))


def query_vectors(spark, d) -> DataFrame:
    means = mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return means.select(F.col("label").cast("long").alias("query_id"),
                        F.col("embedding").alias("query_vec"))


def query_rows(spark, d) -> DataFrame:
    """(query_id, q_text, query_vec)."""
    text = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"),
                                               F.col("text").alias("q_text"))
    return query_vectors(spark, d).join(text, "query_id")


def gold(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("query_id"),
                                                F.col("vec_id").alias("id"))


def docs(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("mapc"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("ten"), F.col("text").alias("noidung"),
        F.concat("lang", F.lit("-"), "source").alias("tenchuong"), F.col("lang").alias("tendemuc"),
        F.col("source").alias("tenchude"), F.col("source").alias("vbqppl"))


def hits(spark, d, k: int) -> DataFrame:
    """Top-k hits of every query."""
    return semantic_search(query_vectors(spark, d), vectors(spark, d), k)


def rich_hits(spark, d, k: int) -> DataFrame:
    """Hits with the query's text and the document's columns, empty where there is none."""
    q, d0 = query_rows(spark, d), docs(spark, d).drop("mapc")
    found = attach(semantic_search(q, vectors(spark, d), k), d0, ["id"])
    return (found.fillna("", subset=[c for c in d0.columns if c != "id"])
            .withColumn("mapc", F.col("id").cast("string"))
            .join(q.select("query_id", "q_text"), "query_id"))
