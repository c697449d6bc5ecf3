"""Corpus tables: denormalised articles, ids, integrity rules, loads and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..dist import number_rows
from ..functions import text as tx
from ..session import materialize

METADATA_BYTES = 64_000


def denormalize(articles: DataFrame, chapters: DataFrame, subtopics: DataFrame,
                topics: DataFrame, chain: bool = False, blanks: bool = False) -> DataFrame:
    """Article ⟕ chapter ⟕ subtopic ⟕ topic.

    By default names come over the article's own keys; ``chain`` follows chapter → subtopic →
    topic instead. Small sides are broadcast by the planner when their size allows it.
    """
    ch = chapters.select(F.col("mapc").alias("_ch"), F.col("ten").alias("tenchuong"),
                         F.col("demuc_id").alias("_ch_dm"))
    dm = subtopics.select(F.col("id").alias("_dm"), F.col("ten").alias("tendemuc"),
                          F.col("chude_id").alias("_dm_cd"))
    cd = topics.select(F.col("id").alias("_cd"), F.col("ten").alias("tenchude"))
    out = articles.join(ch, articles.chuong_id == F.col("_ch"), "left")
    out = out.join(dm, F.col("_ch_dm" if chain else "demuc_id") == F.col("_dm"), "left")
    out = out.join(cd, F.col("_dm_cd" if chain else "chude_id") == F.col("_cd"), "left")
    out = out.drop("_ch", "_ch_dm", "_dm", "_dm_cd", "_cd")
    return out.fillna("", subset=["tenchuong", "tendemuc", "tenchude"]) if blanks else out


METADATA_FIELDS = ("mapc", "tenchude", "tendemuc", "tenchuong", "tendieu")


def _metadata_json(df: DataFrame, body: Column) -> Column:
    names = [tx.nonblank(c).alias(c) for c in METADATA_FIELDS]
    return F.to_json(F.struct(*names, body.alias("noidung")), {"ignoreNullFields": "false"})


def cap_metadata(df: DataFrame, max_bytes: int = METADATA_BYTES, out="metadata") -> DataFrame:
    """Metadata JSON with the body shortened from its tail until the text fits.

    The size rule counts the blank the usual writers put after ``,`` and ``:`` (11 here).
    """
    body = tx.capped_body(tx.strip(F.coalesce("noidung", F.lit(""))),
                          lambda t: _metadata_json(df, t), max_bytes,
                          slack=2 * len(METADATA_FIELDS) + 1)
    capped = df.withColumn("noidung", body)
    return capped.withColumn(out, _metadata_json(capped, F.col("noidung")))


METADATA_TYPE = ", ".join(f"{c} string" for c in (*METADATA_FIELDS, "noidung"))


def parse_metadata(df: DataFrame, col: str = "metadata") -> DataFrame:
    """Metadata text to columns; the key falls back to the title up to its first dot."""
    m = df.withColumn("_m", F.from_json(col, METADATA_TYPE))
    fallback = tx.nonblank(tx.strip(F.split_part(F.col("_m.tendieu"), F.lit("."), F.lit(1))))
    out = m.withColumns({c: F.col(f"_m.{c}") for c in METADATA_FIELDS[1:]} | {
        "noidung": F.col("_m.noidung"),
        "article_key": F.coalesce(tx.nonblank("_m.mapc"), fallback)})
    return out.drop("_m", col)


def assign_ids(df: DataFrame, key, name="id") -> DataFrame:
    """Ids 1..n in key order; numbered range by range, not in one window."""
    return number_rows(df, key, name)


def fetch_by_id(ids: DataFrame, table: DataFrame, id="id") -> DataFrame:
    """Rows for ids (one join instead of one query per id)."""
    return ids.join(table, id)


def reject_invalid(df: DataFrame, pk: list[str], fks: dict[str, DataFrame],
                   order) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects with reason): missing keys, later rows of a key and dangling references.

    Every row is in one of the two outputs. The first row of a key by ``order`` stays, rows that
    tie there are told apart by a hash of all columns, and of equal rows one stays; a repeated key
    is combined before the shuffle, and the join with its first row is one that Spark can split.
    """
    order = [order] if isinstance(order, str) else list(order)
    whole = F.xxhash64(*df.columns)
    rank = F.struct(*order, whole.alias("_h"), F.monotonically_increasing_id().alias("_u"))
    rows = materialize(df.withColumn("_rank", rank), "ranked")
    known_key = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk])
    firsts = materialize(rows.filter(known_key).groupBy(*pk).agg(F.min("_rank").alias("_first")),
                         "first-of-key")
    tagged = rows.join(firsts, pk, "left")
    reason = F.when(~known_key, F.lit("missing key")).when(
        F.col("_rank") != F.col("_first"), F.lit("duplicate key"))
    for col, ref in fks.items():
        known = ref.select(F.col(ref.columns[0]).alias(f"_k_{col}")).distinct()
        tagged = tagged.join(known, tagged[col] == F.col(f"_k_{col}"), "left")
        reason = reason.when(F.col(col).isNotNull() & F.col(f"_k_{col}").isNull(),
                             F.lit(f"missing {col}"))
    tagged = tagged.withColumn("reason", reason).select(*df.columns, "reason")
    return (tagged.filter("reason IS NULL").drop("reason"),
            tagged.filter("reason IS NOT NULL"))


def load_with_rejects(df: DataFrame, rules: dict[str, Column],
                      unknown: str = "unknown: ") -> tuple[DataFrame, DataFrame]:
    """(good, bad): ``rules`` maps an error text to the condition that raises it.

    Bad rows keep their id, names, text length and the first error that applies; a rule that is
    null for a row (a value is missing) rejects it as well, with ``unknown`` before its text.
    """
    error = reduce(lambda acc, kv: F.coalesce(acc, F.when(kv[1], F.lit(kv[0])).when(
        kv[1].isNull(), F.lit(unknown + kv[0]))), rules.items(), F.lit(None).cast("string"))
    tagged = df.withColumn("error", error)
    return (tagged.filter("error IS NULL").drop("error"), tagged.filter("error IS NOT NULL"))


def load_increment(df: DataFrame, target: DataFrame | None, key="id",
                   resume: bool = True) -> DataFrame:
    """Rows still to load: those whose key the target lacks, or all of them when fresh."""
    if target is None or not resume:
        return df
    return df.join(target.select(key), key, "left_anti")


def first_nonempty(*dfs: DataFrame) -> DataFrame:
    """All rows of the first store that has any; a one-row probe each decides, then one is read."""
    return next((df for df in dfs if not df.isEmpty()), dfs[-1])
