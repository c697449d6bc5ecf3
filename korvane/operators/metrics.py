"""Ranking metrics over many queries, strategies and cut-offs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..dist import first_per

METRICS = ["precision", "recall", "hit", "mrr", "ndcg"]


def at_cutoffs(ranked: DataFrame, ks, rank="rank") -> DataFrame:
    """One copy of the list head per cut-off, for lists whose shorter forms are prefixes."""
    return (ranked.filter(F.col(rank) <= max(ks))
            .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
            .filter(F.col(rank) <= F.col("k")))


def evaluate_queries(ranked: DataFrame, gold: DataFrame, by=("strategy", "k"),
                     query_id="query_id", id="id") -> DataFrame:
    """precision, recall, hit, MRR and NDCG per list.

    ``ranked`` holds ``(*by, query_id, id, rank)``. Repeated ids count each time; precision
    divides by k even for short lists; ids that are no integers never match.
    """
    by = list(by)
    ids = F.expr(f"try_cast({id} AS BIGINT)")
    wanted = gold.select(query_id, ids.alias("_gid")).filter("_gid IS NOT NULL").distinct()
    sizes = wanted.groupBy(query_id).agg(F.count(F.lit(1)).alias("_gold"))
    marked = (ranked.withColumn("_id", ids).filter(F.col("rank") <= F.col("k"))
              .join(wanted.withColumn("_rel", F.lit(1)),
                    (ranked[query_id] == wanted[query_id]) & (F.col("_id") == F.col("_gid")),
                    "left")
              .select(*[ranked[c] for c in by], ranked[query_id], "rank",
                      F.coalesce("_rel", F.lit(0)).alias("_rel")))
    gain = F.col("_rel") / F.log2(F.col("rank") + 1)
    sums = marked.groupBy(*by, query_id).agg(
        F.sum("_rel").alias("_hits"), F.sum(gain).alias("_dcg"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"))
    n = F.coalesce("_gold", F.lit(0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.col("k")), F.lit(1)).cast("int")),
        F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    zero = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return (sums.join(sizes, query_id, "left").select(
        *by, query_id,
        (F.col("_hits") / F.col("k")).alias("precision"),
        zero(F.col("_hits") / n).alias("recall"),
        (F.col("_hits") > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        zero(F.col("_dcg") / ideal).alias("ndcg")))


def with_missing(per_query: DataFrame, lists: DataFrame, by=("strategy", "k"),
                 query_id="query_id", metrics=tuple(METRICS)) -> DataFrame:
    """Zero rows for the lists that returned nothing (``lists`` = expected keys)."""
    return (lists.join(per_query, [*by, query_id], "left")
            .fillna(0.0, subset=list(metrics)))


def average_metrics(per_query: DataFrame, by=("strategy", "k"),
                    metrics=tuple(METRICS)) -> DataFrame:
    """Long form ``(strategy, k, num_queries, metric, value)``."""
    wide = per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("num_queries"),
                                      *[F.avg(m).alias(m) for m in metrics])
    return wide.unpivot([*by, "num_queries"], list(metrics), "metric", "value")


def comparison_table(averages: DataFrame, ks) -> DataFrame:
    """One row per metric and strategy, one column ``k_N`` per cut-off."""
    wide = averages.groupBy("metric", "strategy").pivot("k", list(ks)).agg(F.first("value"))
    return wide.select("metric", "strategy", *[F.col(str(k)).alias(f"k_{k}") for k in ks])


def best_per_metric(averages: DataFrame, strategies, ks) -> DataFrame:
    """Best (strategy, k) per metric; the earlier strategy, then the earlier k, wins ties."""
    pos = lambda items, col: F.array_position(
        F.array(*[F.lit(i) for i in items]), F.col(col))
    return first_per(averages.withColumn("_s", pos(strategies, "strategy"))
                     .withColumn("_k", pos(ks, "k")),
                     "metric", [F.desc("value"), F.asc("_s"), F.asc("_k")]).drop("_s", "_k")


def run_summary(hits: DataFrame, queries: DataFrame, strategies) -> DataFrame:
    """Per strategy: queries, documents, mean top score (0 for an empty list), mean list
    length."""
    keys = queries.select("query_id").distinct().withColumn(
        "strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    lists = hits.groupBy("strategy", "query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_t"))
    return (keys.join(lists, ["strategy", "query_id"], "left").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum(F.coalesce("_n", F.lit(0))).alias("total_documents"),
        F.avg(F.coalesce("_t", F.lit(0.0))).alias("avg_top_score"),
        F.avg(F.coalesce("_n", F.lit(0))).alias("avg_documents")))


RESULT_TYPE = ("map<string,map<string,struct<strategy:string,top_k:int,num_queries:int,"
               "average_metrics:map<string,map<string,double>>>>>")


def flatten_results(df: DataFrame, col: str = "value") -> DataFrame:
    """Nested result text to ``(strategy, k, metric, value)``; k comes from ``k=N``."""
    level = df.select(F.explode(F.from_json(col, RESULT_TYPE)).alias("strategy", "_ks"))
    level = level.select("strategy", F.explode("_ks").alias("_k", "_v"))
    level = level.select(
        "strategy", F.regexp_extract("_k", r"k=(\d+)", 1).try_cast("int").alias("k"),
        F.explode("_v.average_metrics").alias("_group", "_m"))
    return level.select("strategy", "k", F.explode("_m").alias("metric", "value"))


def pack_results(averages: DataFrame) -> DataFrame:
    """The inverse: one nested JSON text per strategy (metrics × cut-offs, both bounded)."""
    per_k = averages.groupBy("strategy", "k", "num_queries").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_m"))
    block = F.struct("strategy", F.col("k").alias("top_k"), "num_queries",
                     F.create_map(F.lit("retrieval_metrics"), F.col("_m")).alias("average_metrics"))
    per_s = per_k.groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("k="), F.col("k").cast("string")).alias("key"), block.alias("b")))).alias("_ks"))
    return per_s.select(F.to_json(F.create_map("strategy", "_ks")).alias("value"))


def ids_to_keys(table: DataFrame, ids: DataFrame, key: str = "mapc", id: str = "id") -> DataFrame:
    """Number the table by its key and return the keys of the wanted numbers."""
    from ..dist import number_rows
    return number_rows(table.select(key), key, id).join(ids.select(id).distinct(), id, "left_semi")


def remap_gold_rows(gold: DataFrame, old_ids: DataFrame, new_ids: DataFrame,
                    key: str = "mapc") -> DataFrame:
    """(query_id, pos, old_id, id): gold ids through their key to new ids, null if unmapped.

    Gold lists stay rows, so the length of a list does not matter.
    """
    flat = gold.select("query_id", "pos", F.col("id").alias("old_id"))
    return (flat.join(old_ids.select(F.col("id").alias("old_id"), key), "old_id", "left")
            .join(new_ids.select(key, "id"), key, "left").drop(key))


def remap_summary(rows: DataFrame) -> DataFrame:
    """Mapped and total gold ids per query."""
    return rows.groupBy("query_id").agg(F.count("id").alias("mapped"),
                                        F.count(F.lit(1)).alias("total"))


def remap_gold(evals: DataFrame, old_ids: DataFrame, new_ids: DataFrame,
               key: str = "mapc") -> DataFrame:
    """The same for evaluation items (query_id, gold_docs): new list, old list and counts.

    An item's list is rebuilt next to the item, so it is as long as the item already is.
    """
    rows = remap_gold_rows(evals.select("query_id", F.posexplode("gold_docs").alias("pos", "id")),
                           old_ids, new_ids, key)
    lists = rows.filter("id IS NOT NULL").groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("_docs"))
    docs = F.coalesce("_docs", F.array().cast("array<bigint>"))
    return evals.join(lists, "query_id", "left").select(
        "query_id", docs.alias("gold_docs"), F.col("gold_docs").alias("gold_docs_old"),
        F.size(docs).alias("mapped"), F.size("gold_docs").alias("total"))
