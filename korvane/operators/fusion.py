"""Score fusion, reranking, merging and the quality gates over ranked lists.

Lists are rows ``(query_id, rank, ...)``. They are bounded per query by the candidate cut of
the search before them, so per-list windows stay small; cuts and keep-first use partial
limits and need no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..dist import first_per, top_per
from ..functions import text as tx
from ..functions.vectors import cosine
from ..schemas import SITUATION

WEB = ["web", "web_realtime"]


def is_web(col="source") -> Column:
    return F.coalesce(F.col(col).isin(WEB), F.lit(False))


def hit_key(chars: int | None, *names: str) -> Column:
    """First non-empty of the key columns, else the head of the passage (all of it for ``None``)."""
    return F.coalesce(*[tx.nonblank(n) for n in names],
                      tx.head(F.coalesce(F.col("passage"), F.lit("")), chars))


def attach(cands: DataFrame, table: DataFrame, on) -> DataFrame:
    """Left join of a bounded candidate list with a large table.

    The table is cut to the candidates' keys first, which the planner can do with a broadcast
    of those keys; a plain left join would shuffle the whole table.
    """
    on = list(on)
    near = table.join(cands.select(*on).distinct(), on, "left_semi")
    return cands.join(near, on, "left")


def minmax(df: DataFrame, col: str, out: str, by=("query_id",)) -> DataFrame:
    """Scale to 0..1 per list; a flat list becomes all ones."""
    w = W.partitionBy(*by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(hi - lo < 1e-9, F.lit(1.0))
                         .otherwise((F.col(col) - lo) / (hi - lo)))


def hybrid_rank(cands: DataFrame, k: int, alpha: float = 0.6, q_text="q_text",
                body="noidung", by=("query_id",)) -> DataFrame:
    """alpha * scaled vector score + (1 - alpha) * scaled word overlap with the body."""
    if "lexical_score" not in cands.columns:
        cands = cands.withColumn("lexical_score", tx.word_overlap(q_text, body))
    scored = minmax(minmax(cands, "score", "_v", by), "lexical_score", "_l", by)
    mixed = F.round(alpha * F.col("_v") + (1.0 - alpha) * F.col("_l"), 12)
    scored = scored.withColumnsRenamed({"score": "vector_score", "rank": "_pos"}).withColumn(
        "score", mixed)
    return top_per(scored, by, [F.desc("score"), F.asc("_pos")], k).drop("_v", "_l", "_pos")


def two_stage_rank(cands: DataFrame, k: int, overlap: Column, by=("query_id",)) -> DataFrame:
    """Order the candidates by their overlap with the labelled block."""
    scored = cands.withColumnsRenamed({"score": "vector_score", "rank": "_pos"}).withColumn(
        "score", overlap)
    return top_per(scored, by, [F.desc("score"), F.asc("_pos")], k).drop("_pos")


def two_stage_v2_rank(cands: DataFrame, contexts: DataFrame, k: int, id="id",
                      query_vec="query_vec", vec="context_vec", by=("query_id",)) -> DataFrame:
    """Order the candidates by cosine with a supplied full-context vector."""
    scored = (attach(cands.withColumnsRenamed({"score": "vector_score", "rank": "_pos"}),
                     contexts.select(id, vec), [id])
              .withColumn("score", F.round(F.coalesce(cosine(query_vec, vec), F.lit(0.0)), 12)))
    return top_per(scored, by, [F.desc("score"), F.asc("_pos")], k).drop("_pos", vec)


def score_rerank(cands: DataFrame, scores: DataFrame, k: int = 10, on=("query_id", "id"),
                 raw="raw_score", by=("query_id",)) -> DataFrame:
    """Order the candidates by a supplied relevance text; none counts as 0."""
    scored = (attach(cands.withColumnsRenamed({"score": "vector_score", "rank": "_pos"}),
                     scores.select(*on, raw), on)
              .withColumn("score", tx.parse_score(raw)))
    return top_per(scored, by, [F.desc("score"), F.asc("_pos")], k).drop("_pos", raw)


def head_rerank(ranked: DataFrame, scores: DataFrame, n: int = 12, on=("query_id", "id"),
                raw="raw_score") -> DataFrame:
    """Only the first n rows take the supplied score and are re-sorted; the tail keeps its
    ranks, so it never enters the sort."""
    head = ranked.filter(F.col("rank") <= n).withColumnRenamed("rank", "_pos").drop("score")
    head = (attach(head, scores.select(*on, raw), on)
            .withColumn("score", tx.parse_score(raw)))
    head = top_per(head, "query_id", [F.desc("score"), F.asc("_pos")], n).drop("_pos", raw)
    return head.unionByName(ranked.filter(F.col("rank") > n))


def overlap_rerank(cands: DataFrame, k: int, q_text="q_text", base="base_score", pos="pos",
                   weight: float = 0.05, key_chars: int | None = 80) -> DataFrame:
    """Drop repeated keys, then base score plus a bonus per query token found in the text."""
    unique = first_per(cands.withColumn("_key", hit_key(key_chars, "mapc")), ["query_id", "_key"], [pos])
    body = F.concat(F.coalesce("ten", F.lit("")), F.lit(" "), F.coalesce("noidung", F.lit("")))
    scored = unique.withColumn("score", F.col(base) + tx.substring_overlap(q_text, body) * weight)
    return top_per(scored, "query_id", [F.desc("score"), F.asc(pos)], k).drop("_key")


def hydrate(keys: DataFrame, primary: DataFrame, fallback: DataFrame, key="mapc") -> DataFrame:
    """Rows for keys in their given order; repeated keys stay, unknown keys drop out.

    Keys found in the primary store never reach the fallback store.
    """
    cols = [c for c in primary.columns if c != key]
    wanted = keys.filter(tx.nonblank(key).isNotNull()).withColumn(key, tx.strip(key))
    first = wanted.join(primary, key, "inner")
    missing = wanted.join(first.select(key).distinct(), key, "left_anti")
    second = missing.join(fallback.select(key, *cols), key, "inner")
    return first.unionByName(second)


def get_article(articles: DataFrame, key_value: str, key="mapc") -> DataFrame:
    """Point lookup; the equality reaches the scan."""
    return articles.filter(F.col(key) == key_value.strip())


def merge_queries(hits: DataFrame, max_queries: int = 6, each: int = 8, turn="turn_id",
                  qpos="query_pos", key_chars: int | None = 80) -> DataFrame:
    """Lists of several queries of one turn, concatenated; first occurrence of a key stays."""
    kept = (hits.filter((F.col(qpos) < max_queries) & (F.col("rank") <= each))
            .withColumn("_key", hit_key(key_chars, "mapc", "url")))
    unique = first_per(kept, [turn, "_key"], [qpos, "rank"])
    return top_per(unique.withColumnRenamed("rank", "_r"), turn, [qpos, "_r"],
                   max_queries * each).drop("_key", "_r")


def final_dedup(hits: DataFrame, n: int = 20, by="query_id", pos="pos",
                key_chars: int | None = 100) -> DataFrame:
    """One row per key, web rows before corpus rows, first n."""
    unique = first_per(hits.withColumn("_key", hit_key(key_chars, "mapc", "url")), [by, "_key"], [pos])
    return top_per(unique, by, [F.desc(is_web()), F.asc(pos)], n).drop("_key")


def bucket_merge(steps: DataFrame, max_extend: int = 12, by="turn_id", step="step",
                 rank="rank", key_chars: int | None = 80) -> DataFrame:
    """Append each step's first rows, skipping keys the bucket already holds.

    A row known only by its passage is compared within its own step, as the bucket keeps no
    passage keys.
    """
    named = F.coalesce(tx.nonblank("mapc"), tx.nonblank("url"))
    kept = (steps.filter(F.col(rank) <= max_extend)
            .withColumn("_key", hit_key(key_chars, "mapc", "url")).filter("_key <> ''")
            .withColumn("_scope", F.when(named.isNotNull(), F.lit(-1)).otherwise(F.col(step))))
    return first_per(kept, [by, "_scope", "_key"], [step, rank]).drop("_key", "_scope")


def confidence(hits: DataFrame, queries: DataFrame, by="query_id",
               iterations="iterations") -> DataFrame:
    """Confidence and warning per query; ``queries`` = (query_id, iterations)."""
    top = F.col("rank") <= 5
    stats = hits.groupBy(by).agg(
        F.sum(F.when(top, F.coalesce("score", F.lit(0.5)))).alias("_s"),
        F.count(F.when(top, F.lit(1))).alias("_t"), F.count(F.lit(1)).alias("_n"),
        F.count(F.when(~is_web(), F.lit(1))).alias("_corpus"))
    joined = queries.select(by, iterations).join(stats, by, "left")
    raw = F.col("_s") / F.col("_t")
    raw = raw * F.when(F.col("_corpus") == 0, 0.70).otherwise(1.0)
    raw = raw * F.when(F.col("_n") < 2, 0.80).otherwise(1.0)
    raw = raw * F.when(F.col(iterations) >= 6, 0.90).otherwise(1.0)
    conf = F.coalesce(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3), F.lit(0.0))
    out = joined.withColumn("confidence", conf)
    return out.select(by, "confidence",
                      ((F.col("confidence") < 0.40) | (F.coalesce("_corpus", F.lit(0)) == 0))
                      .alias("warning"))


def is_sufficient(queries: DataFrame, hits: DataFrame, threshold: float = 0.6, by="query_id",
                  q_text="q_text", recent=tuple(fixed.RECENT_KEYWORDS)) -> DataFrame:
    """Is the retrieved context good enough: no recency wish, three or more rows, a high
    mean of the first three scores and one of the first five rows on topic."""
    text = F.concat(F.coalesce("ten", F.lit("")), F.lit(" "), F.coalesce("noidung", F.lit("")))
    head = (hits.filter(F.col("rank") <= 5)
            .join(queries.select(by, F.col(q_text).alias("_q")), by)
            .groupBy(by).agg(
                F.avg(F.when(F.col("rank") <= 3, F.coalesce("score", F.lit(0.0)))).alias("_avg"),
                F.count(F.lit(1)).alias("_n"),
                F.max(tx.shared_tokens("_q", text) >= 2).alias("_topic")))
    good = (~tx.needs_recent(q_text, recent) & (F.coalesce("_n", F.lit(0)) >= 3)
            & (F.coalesce("_avg", F.lit(0.0)) >= threshold) & F.coalesce("_topic", F.lit(False)))
    return queries.select(by, q_text).join(head, by, "left").select(by, good.alias("sufficient"))


def fan_out(situations: DataFrame, turn="turn_id", prompt="prompt", raw="analysis") -> DataFrame:
    """Query rows of a supplied situation analysis; the prompt alone where there are none."""
    parsed = F.from_json(tx.strip_json_fence(raw), SITUATION)
    lists = F.transform(F.coalesce(parsed["cac_vi_pham"], F.array()),
                        lambda v: F.coalesce(v["queries"], F.array()))
    queries = F.flatten(lists)
    return situations.withColumn("_q", queries).select(
        turn, F.posexplode(F.when(F.size("_q") > 0, F.col("_q")).otherwise(F.array(prompt)))
        .alias("query_pos", "query"))


def issue_lines(situations: DataFrame, turn="turn_id", raw="analysis") -> DataFrame:
    """One formatted line per issue of the analysis."""
    parsed = situations.select(turn, F.posexplode(
        F.from_json(tx.strip_json_fence(raw), SITUATION)["cac_vi_pham"]).alias("issue_pos", "v"))
    val = lambda c: F.coalesce(F.col(f"v.{c}").cast("string"), F.lit(""))
    return parsed.select(turn, "issue_pos", F.concat(
        F.lit("- Vi phạm "), val("id"), F.lit(": "), val("chu_the"), F.lit(" — "),
        val("hanh_vi"), F.lit(" ["), val("nhom_luat"), F.lit("] mức độ: "), val("muc_do"))
        .alias("line"))


# ---- projections of hits --------------------------------------------------------------

def to_full_hit(df: DataFrame, score: Column, source: str = "phapdien") -> DataFrame:
    body = F.coalesce("noidung", F.lit(""))
    return df.withColumns({
        "passage": tx.passage_text("tenchude", "tendemuc", "tenchuong", "ten", "noidung"),
        "score": score, "source": F.lit(source)}).withColumn("noidung", body)


def to_short_hit(df: DataFrame, body_chars: int, passage_chars: int) -> DataFrame:
    body = F.coalesce("noidung", F.lit(""))
    short = tx.truncate_marked(body, body_chars)
    passage = tx.passage_text("tenchude", "tendemuc", "tenchuong", "ten", "noidung")
    return df.withColumns({"_p": tx.truncate_marked(passage, passage_chars), "_s": short,
                           "noidung_truncated": F.length(body) > F.length(short)}) \
        .drop("noidung", "passage").withColumnsRenamed({"_p": "passage", "_s": "noidung"})


def to_passages(df: DataFrame, by=("query_id", "rank")) -> DataFrame:
    """Passage rows for the answer, with defaults for absent fields."""
    have = lambda c, d: (F.coalesce(F.col(c), F.lit(d)) if c in df.columns
                         else F.lit(d))
    body = F.coalesce(tx.nonblank(have("noidung", "")), have("passage", ""))
    return df.select(
        *by, *[have(c, "").alias(c) for c in ("mapc", "ten", "tenchuong", "tendemuc", "tenchude")],
        body.alias("noidung"), F.round(have("score", 0.0).cast("double"), 4).alias("score"),
        have("source", "phapdien").alias("source"), have("url", "").alias("url"),
        have("trust_level", "medium").alias("trust_level"),
        have("source_label", fixed.WEB_LABEL).alias("source_label"))


PRODUCER_SCORE = {"vector_search": 0.8, "graph_traverse": 0.85, "web_search": 0.7,
                  "get_full_article": 1.0}


def harmonize_hits(df: DataFrame, producer: str) -> DataFrame:
    """Rows of one producer in the common hit shape; a row with a url counts as web."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    keep = [c for c in ("query_id", "turn_id", "step", "rank") if c in df.columns]
    two = lambda *c: F.concat_ws("\n", *[tx.nonblank(x) for x in c])
    url, body = F.coalesce(have("url"), F.lit("")), have("noidung")
    web = (F.lit(True) if producer == "web_search"
           else F.lit(False) if producer == "get_full_article" else url != "")
    web_title = F.coalesce(tx.nonblank(have("ten")), have("title"), F.lit(""))
    web_body = F.coalesce(tx.nonblank(body), have("content"), F.lit(""))
    web_passage = F.coalesce(tx.nonblank(have("passage")), two(have("title"), have("content"), body))
    if producer == "graph_traverse":
        own_body = F.coalesce(tx.nonblank(body), have("passage"), F.lit(""))
        own_passage = F.coalesce(tx.nonblank(have("passage")), body, F.lit(""))
    else:
        own_body, own_passage = F.coalesce(body, F.lit("")), two(have("ten"), body)
    given = have("score").try_cast("double")
    pick = lambda a, b: F.when(web, a).otherwise(b)
    graph = producer == "graph_traverse"
    return df.select(
        *keep, F.coalesce(have("mapc"), F.lit("")).alias("mapc"),
        pick(web_title, F.coalesce(have("ten"), F.lit(""))).alias("ten"),
        *[(pick(F.lit(None).cast("string"), have(c)) if graph
           else F.lit(None).cast("string")).alias(c)
          for c in ("tenchuong", "tendemuc", "tenchude")],
        pick(web_body, own_body).alias("noidung"), pick(web_passage, own_passage).alias("passage"),
        pick(F.coalesce(given, F.lit(0.7)), F.lit(PRODUCER_SCORE[producer])).alias("score"),
        pick(F.lit("web"), F.lit("phapdien")).alias("source"),
        pick(url, F.lit(None).cast("string")).alias("url"),
        pick(F.coalesce(have("trust_level"), F.lit("medium")),
             F.lit(None).cast("string")).alias("trust_level"),
        pick(F.coalesce(have("source_label"), F.lit(fixed.WEB_LABEL)),
             F.lit(None).cast("string")).alias("source_label"))


def pack_context(hits: DataFrame, n: int = 20, by="query_id") -> DataFrame:
    """Label and passage of the first n rows as one text per query."""
    label = F.when(is_web(), F.coalesce("source_label", F.lit(fixed.WEB_LABEL))) \
        .otherwise(F.lit(fixed.CORPUS_LABEL))
    part = F.concat(label, F.lit("\n"), F.coalesce("passage", F.lit("")))
    rows = hits.filter(F.col("rank") <= n).select(by, "rank", part.alias("_t"))
    return rows.groupBy(by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda s: s["_t"]),
        "\n\n---\n\n").alias("context"))


def web_sources(passages: DataFrame, by="query_id") -> DataFrame:
    """Web rows that carry a url."""
    return passages.filter(is_web() & tx.nonblank("url").isNotNull()).select(
        by, "rank", F.coalesce("ten", F.lit("")).alias("title"), "url",
        F.coalesce("trust_level", F.lit("medium")).alias("level"),
        F.coalesce("source_label", F.lit(fixed.WEB_LABEL)).alias("label"))


def sources_markdown(sources: DataFrame, by="query_id") -> DataFrame:
    """Footer text per query; the list is bounded by the passage cut."""
    icon = F.when(F.col("level") == "high", F.lit("✅")).otherwise(F.lit("⚠️"))
    line = F.concat(icon, F.lit(" "), "label", F.lit(" ["), "title", F.lit("]("), "url", F.lit(")"))
    return sources.withColumn("_l", line).groupBy(by).agg(F.concat(
        F.lit(fixed.SOURCES_HEADER + "\n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))),
                                 lambda s: s["_l"]), "\n")).alias("footer"))
