"""Trust of web rows: host weight, keyword share, class and shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..functions import text as tx


def host(url="url") -> Column:
    """Network location as written, without ``www.``; empty for missing or bad urls."""
    return F.coalesce(F.replace(F.try_parse_url(F.col(url), F.lit("AUTHORITY")),
                                F.lit("www."), F.lit("")), F.lit(""))


def domain_score(h: Column, trusted: dict[str, float], untrusted: list[str],
                 default: float = 0.4) -> Column:
    """Weight of the first listed domain inside the host; any untrusted part overrides."""
    def weigh(h):
        bad = F.lit(False)
        for p in untrusted:
            bad = bad | F.contains(h, F.lit(p))
        score = F.when(bad, F.lit(0.1))
        for domain, weight in trusted.items():
            score = score.when(F.contains(h, F.lit(domain)), F.lit(weight))
        return score.otherwise(F.lit(default))

    return tx.let(h, weigh)


def keyword_hits(keywords, *texts) -> Column:
    """Number of keywords found in any of the texts; each text is lowered once."""
    def count(lows):
        total = F.lit(0)
        for kw in keywords:
            found = F.lit(False)
            for name in texts:
                found = found | F.contains(lows[name], F.lit(kw))
            total = total + found.cast("int")
        return total

    low = F.struct(*[F.lower(F.coalesce(F.col(t), F.lit(""))).alias(t) for t in texts])
    return tx.let(low, count)


def trust_score(df: DataFrame, trusted=fixed.TRUSTED_DOMAINS, untrusted=fixed.UNTRUSTED_PATTERNS,
                keywords=fixed.LEGAL_KEYWORDS) -> DataFrame:
    """0.7 · host weight + 0.3 · keyword share (five keywords are full marks)."""
    content = F.least(keyword_hits(keywords, "noidung", "ten") / 5, F.lit(1.0))
    return df.withColumn("trust_score", F.round(
        domain_score(host(), trusted, untrusted) * 0.7 + content * 0.3, 3))


def trust_class(df: DataFrame) -> DataFrame:
    level = (F.when(F.col("trust_score") >= 0.7, "high")
             .when(F.col("trust_score") >= 0.4, "medium").otherwise("low"))
    label = F.create_map(*[x for kv in fixed.TRUST_LABELS.items() for x in map(F.lit, kv)])
    return df.withColumn("trust_level", level).withColumn(
        "source_label", F.element_at(label, F.col("trust_level")))


def trust_filter(df: DataFrame, by=None, order=("pos",), rank: str = "rank", **lists) -> DataFrame:
    """Score, class, drop the low class; ``source`` becomes web.

    With ``by`` (the query) the rows of each query get their ``rank``: the more trusted first,
    equally trusted ones in their given ``order``.
    """
    kept = trust_class(trust_score(df, **lists)).filter("trust_level <> 'low'") \
        .withColumn("source", F.lit("web"))
    if by is None:
        return kept
    by = [by] if isinstance(by, str) else list(by)
    best_first = W.partitionBy(*by).orderBy(F.desc("trust_score"), *order)
    return kept.withColumn(rank, F.row_number().over(best_first))


def shape_web(results: DataFrame, chars: int = 800, answers: DataFrame | None = None,
              realtime: bool = False, by="query_id") -> DataFrame:
    """Supplied web results as hit rows, a supplied answer row first."""
    body = F.substring(F.coalesce("content", F.lit("")), 1, chars)
    empty = F.lit(None).cast("string")
    rows = results.select(
        by, F.col("pos").cast("int").alias("pos"), empty.alias("mapc"), F.coalesce("title", F.lit("")).alias("ten"),
        body.alias("noidung"),
        F.concat_ws("\n", tx.nonblank("title"), tx.nonblank(body)).alias("passage"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.5)).alias("score"),
        F.coalesce("url", F.lit("")).alias("url"))
    if answers is None:
        return rows
    title = (F.concat(F.lit("Dữ liệu thực tế: "), "query") if realtime
             else F.lit("Tổng hợp từ web"))
    passage = F.concat(F.lit("[Dữ liệu thực tế]\n"), "answer") if realtime else F.col("answer")
    top = answers.filter(tx.nonblank("answer").isNotNull()).select(
        by, F.lit(-1).alias("pos"), empty.alias("mapc"), title.alias("ten"),
        F.col("answer").alias("noidung"), passage.alias("passage"),
        F.lit(0.95 if realtime else 0.9).alias("score"), F.lit("").alias("url"))
    return top.unionByName(rows)
