"""Strategies by name, for many queries in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import text as tx
from . import fusion as fu
from ..session import materialize
from .graph import graph_expand
from .trust import trust_filter
from .vector import semantic_search

MULTIPLIER = 2
TEXT_CAP = 12_000         # characters of a body that overlap is counted in
POOL = 40                 # candidates of one tool call
EXPANDED = 40             # articles of one graph expansion


def _pool(queries: DataFrame, vectors: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    # the hits meet the documents first and alone, so that the small side can be broadcast
    pool = fu.attach(semantic_search(queries, vectors, n), docs, ["id"])
    pool = pool.fillna("", subset=[c for c in docs.columns if c != "id"])
    return pool.join(queries.select("query_id", "q_text", "query_vec"), "query_id")


def candidates(queries: DataFrame, vectors: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Top-n hits with the query's text and vector and the document's columns.

    A hit without a document stays, with empty texts. The pool, n rows per query, is written
    out because the rankers read it several times.
    """
    return materialize(_pool(queries, vectors, docs, n), "pool")


def block_overlap() -> Column:
    return tx.word_overlap("q_text", tx.labelled_block(
        "tenchude", "tendemuc", "tenchuong", "ten", "noidung", "vbqppl"))


# Rankers of a candidate list; ``by`` names the list, ``kw`` the supplied side tables.

def _semantic(c, k, by, **kw):
    return c.filter(F.col("rank") <= k)


def _hybrid(c, k, by, alpha=0.6, **kw):
    return fu.hybrid_rank(c, k, alpha, by=by)


def _two_stage(c, k, by, **kw):
    overlap = F.col("block_overlap") if "block_overlap" in c.columns else block_overlap()
    return fu.two_stage_rank(c, k, overlap, by=by)


def _two_stage_v2(c, k, by, contexts=None, **kw):
    return fu.two_stage_v2_rank(c, contexts, k, by=by)


def _score(c, k, by, scores=None, **kw):
    return fu.score_rerank(c, scores, k, by=by)


STRATEGIES = {"semantic_search": _semantic, "hybrid_search": _hybrid,
              "two_stage_search": _two_stage, "two_stage_search_v2": _two_stage_v2,
              "hybrid_rerank": _score}


def _ranker(strategy: str):
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy]


def retrieve(queries: DataFrame, vectors: DataFrame, docs: DataFrame, strategy: str, k: int = 20,
             **kw) -> DataFrame:
    """``queries`` = (query_id, q_text, query_vec), ``vectors`` = (id, embedding), ``docs`` =
    (id, ten, noidung, ...)."""
    rank = _ranker(strategy)
    pool = k if strategy == "semantic_search" else MULTIPLIER * k
    return rank(candidates(queries, vectors, docs, pool), k, ["query_id"], **kw).withColumn(
        "strategy", F.lit(strategy))


def sweep(queries, vectors, docs, strategies, ks, **kw) -> DataFrame:
    """(strategy, k, query_id, id, rank) for every strategy and cut-off.

    The pool of k is the first 2k of one candidate list, so one search and one reading of the
    texts serve all of them; the ranking itself is done per (query, k), because scaling and
    reranking depend on the pool.
    """
    ks = list(ks)
    pool = _pool(queries, vectors, docs, MULTIPLIER * max(ks))
    slim = materialize(pool.select(
        "query_id", "id", "score", "rank", "query_vec",
        tx.word_overlap("q_text", "noidung").alias("lexical_score"),
        block_overlap().alias("block_overlap")), "pool")
    lists = (slim.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
             .filter(F.col("rank") <= MULTIPLIER * F.col("k")))
    parts = []
    for s in strategies:
        ranked = _ranker(s)(lists, max(ks), ["query_id", "k"], **kw).filter(F.col("rank") <= F.col("k"))
        parts.append(ranked.select(F.lit(s).alias("strategy"), "k", "query_id", "id", "rank"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def vector_tool(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int = 10,
                most: int | None = POOL) -> DataFrame:
    """Pool of 3k, ``most`` at most, hydrated at base score 0.8, overlap-reranked, first k."""
    pool = 3 * k if most is None else min(3 * k, most)
    hits = docs.join(semantic_search(queries, vectors, pool).drop("score"), "id").join(
        queries.select("query_id", "q_text"), "query_id")
    return rerank_tool(hits.withColumn("base_score", F.lit(0.8)), k)


def rerank_tool(hits: DataFrame, k: int, pos="rank", chars: int | None = TEXT_CAP) -> DataFrame:
    """Overlap rerank on capped texts, the stored text kept whole in the result."""
    cands = hits.withColumns({"_n": F.col("noidung"), "noidung": tx.head("noidung", chars),
                              "passage": tx.passage_text("tenchude", "tendemuc", "tenchuong", "ten",
                                                         "noidung")}).withColumnRenamed(pos, "pos")
    return fu.overlap_rerank(cands, k).drop("noidung", "pos", "base_score") \
        .withColumnRenamed("_n", "noidung")


def graph_tool(seeds: DataFrame, edges: DataFrame, docs: DataFrame, queries: DataFrame,
               hops: int = 2, keep: int = 20, limit: int = EXPANDED) -> DataFrame:
    """At most ``limit`` expanded articles per call, overlap-reranked, first ``keep``.

    ``seeds`` = (query_id, mapc, pos); a call without text uses its first five codes.
    """
    grown = graph_expand(seeds.select("query_id", F.col("mapc").alias("key")), edges,
                         max(1, hops), limit)
    codes = seeds.filter(F.col("pos") < 5).groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "mapc"))), lambda s: s["mapc"]), " ").alias("_codes"))
    text = seeds.select("query_id").distinct().join(queries.select("query_id", "q_text"), "query_id",
                                                    "left").join(codes, "query_id", "left")
    text = text.select("query_id", F.coalesce(tx.nonblank(tx.strip("q_text")), "_codes").alias("q_text"))
    hits = grown.select("query_id", F.col("key").alias("mapc"), F.col("base").alias("base_score"),
                        "rank").join(docs, "mapc").join(text, "query_id")
    return rerank_tool(hits, keep)


def graph_rag(queries: DataFrame, vectors: DataFrame, edges: DataFrame, docs: DataFrame,
              web: DataFrame, realtime: DataFrame | None = None, hints: DataFrame | None = None,
              *, seed_k: int = 5, hops: int = 2, k: int = 20, limit: int = EXPANDED, recent=tuple(fixed.RECENT_KEYWORDS),
              **trust) -> DataFrame:
    """Whole flow: seeds, expansion, overlap rerank; web rows where that is not enough,
    realtime rows in front, the calculation hint first. Web and realtime rows come by trust and
    keep their trust score, level and label.

    ``web`` and ``realtime`` are supplied results in hit shape, ``hints`` = (query_id, hint).
    """
    seeds = semantic_search(queries, vectors, seed_k).join(docs.select("id", "mapc"), "id")
    grown = graph_expand(seeds.select("query_id", F.col("mapc").alias("key")), edges, hops, limit)
    cands = (grown.select("query_id", F.col("key").alias("mapc"), F.col("base").alias("base_score"),
                          F.col("rank").alias("pos")).join(docs, "mapc")
             .join(queries.select("query_id", "q_text"), "query_id")
             .withColumn("passage", tx.passage_text("tenchude", "tendemuc", "tenchuong", "ten",
                                                    "noidung")))
    labels = ["trust_score", "trust_level", "source_label"]
    cols = ["query_id", "block", "rank", "mapc", "ten", "noidung", "passage", "score", "source", "url"]

    def unlabelled(df):
        return df.select(*cols, F.lit(None).cast("double").alias(labels[0]),
                         *[F.lit(None).cast("string").alias(c) for c in labels[1:]])

    # at most k rows per query, read by the verdict and by the result
    corpus = materialize(fu.overlap_rerank(cands, k).withColumns(
        {"block": F.lit(2), "source": F.lit("phapdien"), "url": F.lit("")}), "corpus")
    verdict = fu.is_sufficient(queries, corpus, recent=recent)
    short = verdict.filter("NOT sufficient").select("query_id")
    parts = [unlabelled(corpus)]

    def web_rows(df, block):
        return trust_filter(df, by="query_id", **trust).withColumn("block", F.lit(block)) \
            .select(*cols, *labels)

    parts.append(web_rows(web.join(short, "query_id", "left_semi"), 3))
    if realtime is not None:
        parts.append(web_rows(realtime, 1))
    if hints is not None:
        parts.append(unlabelled(hints.filter(tx.nonblank("hint").isNotNull()).select(
            "query_id", F.lit(0).alias("block"), F.lit(1).alias("rank"),
            F.lit(None).cast("string").alias("mapc"), F.lit("Yêu cầu tính toán").alias("ten"),
            F.col("hint").alias("noidung"),
            F.concat(F.lit("[Hướng dẫn tính toán]\n"), "hint").alias("passage"),
            F.lit(1.0).alias("score"), F.lit("system").alias("source"), F.lit("").alias("url"))))
    return reduce(lambda a, b: a.unionByName(b), parts)
