"""Nodes, edges, code trees and bounded expansion over the reference graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..dist import first_per, top_per
from ..functions import text as tx
from ..session import materialize


def build_nodes(tables: dict[str, DataFrame], key="key", version="version") -> DataFrame:
    """One row per (kind, key); the latest version of a repeated key stays."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in tables.items()]
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return first_per(allrows, ["kind", key], [F.desc(version)]).drop(version)


def _existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends present."""
    keys = nodes.select("key")
    return (edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi")
            .join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi"))


def _two_way(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every edge in both directions, from one read of the edges."""
    src, dst = F.col("src"), F.col("dst")
    pair = F.array(F.struct(src.alias("a"), dst.alias("b")), F.struct(dst.alias("a"), src.alias("b")))
    return edges.select(F.explode(pair).alias("_e")).select(
        F.col("_e.a").alias(a), F.col("_e.b").alias(b))


def hierarchy_edges(children: DataFrame, parents: DataFrame, rel: str, parent_col: str,
                    child_key="key", parent_key="key") -> DataFrame:
    """Parent → child edges, only when both ends exist."""
    pairs = children.select(F.col(parent_col).alias("src"), F.col(child_key).alias("dst"))
    known = parents.select(F.col(parent_key).alias("src"))
    return (pairs.dropna().join(known, "src", "left_semi").distinct()
            .withColumn("rel", F.lit(rel)))


def related_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Related pairs in both directions, distinct, both ends known."""
    return _existing(_two_way(pairs, "src", "dst").distinct(), nodes).withColumn("rel", F.lit(fixed.RELATED))


def citation_edges(articles: DataFrame, key="mapc", code="mapc", body="noidung",
                   pattern: str = fixed.CITATION_PATTERN) -> DataFrame:
    """Article → article edges from codes named in the body.

    ``code`` is the column a cited code must match; it may differ from the key. The whole
    table is scanned.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(tx.U + pattern), F.lit(1)))
    cited = articles.select(F.col(key).alias("src"), F.explode(found).alias("_code"))
    targets = articles.select(F.col(code).alias("_code"), F.col(key).alias("dst")).dropna()
    return (cited.join(targets, "_code").filter("src <> dst").select("src", "dst").distinct()
            .withColumn("rel", F.lit(fixed.CITES)))


def graph_expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int | None = 40,
                 query="query_id", key="key") -> DataFrame:
    """Nodes within ``hops`` undirected steps of each query's seeds, seeds included.

    Order: seeds first (base 1.0, others 0.5), then hop, then key; ``limit`` rows per query.
    With a limit the walk is exact and small at once: a query that already has ``limit`` rows
    needs no further hop, and any other query has a frontier below ``limit`` nodes, so no
    query's whole neighbourhood is ever shuffled.
    """
    both = _two_way(edges, "_a", "_b")
    seen = frontier = materialize(seeds.select(query, key).distinct()
                                  .withColumns({"base": F.lit(1.0), "hop": F.lit(0)}), "hop")
    for hop in range(1, hops + 1):
        if limit is not None:
            full = seen.groupBy(query).agg(F.count(F.lit(1)).alias("_n")).filter(
                F.col("_n") >= limit)
            frontier = frontier.join(full, query, "left_anti")
        near = both.join(frontier.select(F.col(key).alias("_a")).distinct(), "_a", "left_semi")
        if limit is not None:
            # fewer than ``limit`` neighbours can be taken already, so the first 2 * limit of
            # a node hold every row this hop can add: a hub costs no more than that
            near = top_per(near.distinct(), "_a", ["_b"], 2 * limit).drop("rank")
        step = (frontier.select(query, F.col(key).alias("_a")).join(near, "_a")
                .select(query, F.col("_b").alias(key)).distinct()
                .join(seen, [query, key], "left_anti"))
        if limit is not None:
            step = top_per(step, query, [key], limit).drop("rank")
        # every hop reads its predecessors more than once, so each is written out
        frontier = materialize(step.withColumns({"base": F.lit(0.5), "hop": F.lit(hop)}), "hop")
        seen = seen.unionByName(frontier)
    if limit is None:
        return seen
    return top_per(seen, query, [F.desc("base"), "hop", key], limit)


def tree_children(df: DataFrame, step: int = 12, code="mapc") -> DataFrame:
    """(parent, child) pairs of a code tree; top-level codes have no parent."""
    kids = df.select(F.col(code).alias("child"),
                     F.substring(code, F.lit(1), F.length(code) - step).alias("_p"))
    known = df.select(F.col(code).alias("parent")).distinct()
    return (kids.join(known, F.col("_p") == F.col("parent"), "left")
            .filter(F.col("parent").isNotNull() | (F.length("child") == step))
            .select("parent", "child"))


def child_counts(df: DataFrame, step: int = 12, code="mapc") -> DataFrame:
    """Every code with its number of direct children."""
    pairs = tree_children(df, step, code).filter("parent IS NOT NULL")
    counts = pairs.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    return (df.select(code).join(counts, F.col(code) == F.col("parent"), "left")
            .select(code, F.coalesce("n", F.lit(0)).alias("children")))
