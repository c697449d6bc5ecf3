"""Per-user memory facts: parsing, lookup, decisions and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..dist import first_per, top_per
from ..functions import text as tx
from ..schemas import FACT_ARRAY
from ..session import materialize
from .vector import user_search

FACT_CHARS = 1800


def parse_facts(df: DataFrame, raw="raw", keep=("turn_id",), types=tuple(fixed.MEMORY_TYPES),
                sensitive=tuple(fixed.SENSITIVE_PATTERNS), chars: int | None = FACT_CHARS) -> DataFrame:
    """Facts of supplied extraction texts, cut to ``chars``; broken JSON gives none."""
    items = F.from_json(tx.strip_json_fence(raw), FACT_ARRAY)
    flat = df.select(*keep, F.posexplode(items).alias("pos", "_i"))
    fact = tx.strip(F.coalesce("_i.fact", F.lit("")))
    kind = F.lower(tx.strip(F.coalesce("_i.type", F.lit(""))))
    flat = flat.select(*keep, "pos", fact.alias("fact"), kind.alias("type"))
    good = (F.col("fact") != "") & F.col("type").isin(*types) & ~tx.has_sensitive("fact", sensitive)
    return flat.filter(good).withColumn("fact", tx.head("fact", chars))


def active(mem: DataFrame) -> DataFrame:
    """The memories that are not deleted; a table without the mark has none that are."""
    if "deleted" not in mem.columns:
        return mem
    return mem.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def retrieve_memories(queries: DataFrame, mem: DataFrame, k: int = 5, core: int = 8) -> DataFrame:
    """Top-k memories of the user by cosine, then up to ``core`` core rows with score 1.

    ``queries`` = (query_id, user_id, query_vec); ``mem`` = (mem_id, user_id, mem_type, fact,
    embedding, maybe deleted). A row found both ways keeps its cosine; deleted rows are not found.
    """
    mem = active(mem)
    near = user_search(queries, mem, k, id="mem_id").select(
        "query_id", "mem_id", F.round("score", 4).alias("score"), "rank", F.lit(0).alias("_src"))
    cores = top_per(mem.filter("mem_type = 'core'").select("user_id", "mem_id"), "user_id",
                    ["mem_id"], core)
    always = queries.select("query_id", "user_id").join(cores, "user_id").select(
        "query_id", "mem_id", F.lit(1.0).alias("score"), (F.col("rank") + k).alias("rank"),
        F.lit(1).alias("_src"))
    # at most k + core rows per query; written out so that the facts are not shuffled for them
    found = materialize(first_per(near.unionByName(always), ["query_id", "mem_id"], ["_src"]), "found")
    return found.drop("_src").join(mem.select("mem_id", "user_id", "mem_type", "fact"), "mem_id")


def memory_context(found: DataFrame, by="query_id", order=("rank", "mem_id")) -> DataFrame:
    """Header and ``- (type) fact`` lines by type; at most k + core rows per query."""
    kinds = F.array(*[F.lit(t) for t in fixed.MEMORY_TYPES])
    rows = found.withColumn("_k", F.array_position(kinds, F.lower("mem_type"))).filter(
        (F.col("_k") > 0) & (tx.nonblank("fact").isNotNull()))
    line = F.concat(F.lit("- ("), F.lower("mem_type"), F.lit(") "), "fact")
    return rows.groupBy(by).agg(F.concat(F.lit(fixed.MEMORY_HEADER + "\n"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", *order, line.alias("_l")))),
                    lambda s: s["_l"]), "\n")).alias("context"))


def similar_memories(cands: DataFrame, mem: DataFrame, k: int = 5) -> DataFrame:
    """Nearest existing memories per candidate; candidates without any get action ADD.

    Deleted memories are no neighbours.
    """
    near = user_search(cands, active(mem), k, id="mem_id")
    return cands.select("query_id").join(near, "query_id", "left").withColumn(
        "action", F.when(F.col("mem_id").isNull(), F.lit("ADD")))


def guard_decisions(df: DataFrame, types=tuple(fixed.MEMORY_TYPES),
                    hint: str = fixed.REPLACEMENT_PATTERN) -> DataFrame:
    """Clean supplied decisions ``(action, fact, mem_type, target_id, merged_fact)``.

    Unknown actions add; a delete whose fact names a replacement updates; rows without a
    usable fact or target get status SKIP or NOOP.
    """
    fact = tx.strip(F.coalesce("fact", F.lit("")))
    given = F.upper(tx.strip(F.coalesce("action", F.lit(""))))
    known = F.when(given.isin("ADD", "UPDATE", "DELETE", "NOOP"), given).otherwise(F.lit("ADD"))
    swap = (known == "DELETE") & tx.is_replacement(fact, hint) & (F.length(fact) >= 25)
    action = F.when(swap, F.lit("UPDATE")).otherwise(known)
    target = F.col("target_id").cast("string").try_cast("bigint")
    merged = F.coalesce(tx.nonblank(tx.strip(F.col("merged_fact"))), fact)
    usable = (fact != "") & F.lower(tx.strip("mem_type")).isin(*types)
    status = (F.when(~F.coalesce(usable, F.lit(False)), "SKIP")
              .when((action == "UPDATE") & target.isNull(), "SKIP")
              .when((action == "DELETE") & target.isNull(), "NOOP").otherwise(action))
    return df.withColumns({"_status": status, "_target": target, "_merged": merged,
                           "_fact": fact, "_type": F.lower(tx.strip("mem_type"))}) \
        .drop("action", "target_id", "merged_fact", "fact", "mem_type") \
        .withColumnsRenamed({"_status": "action", "_target": "target_id",
                             "_merged": "merged_fact", "_fact": "fact", "_type": "mem_type"})


def _resolve_chains(links: DataFrame) -> DataFrame:
    """Root and depth of every link by pointer doubling: rounds grow with the logarithm of
    the longest chain. ``links`` = (user_id, node, ptr, depth, done)."""
    state = links
    while not state.filter("NOT done").isEmpty():
        up = state.select("user_id", F.col("node").alias("ptr"), F.col("ptr").alias("_p"),
                          F.col("depth").alias("_d"), F.col("done").alias("_ok"))
        open_, closed = state.filter("NOT done"), state.filter("done")
        state = materialize(closed.unionByName(open_.join(up, ["user_id", "ptr"]).select(
            "user_id", "node", F.col("_p").alias("ptr"),
            (F.col("depth") + F.col("_d")).alias("depth"), F.col("_ok").alias("done"))), "chains")
    return state


def apply_decisions(mem: DataFrame, decisions: DataFrame, *, upsert: bool = False,
                    begin: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, history, report) after a batch of decisions.

    ``decisions`` = (user_id, seq, action, fact, mem_type, target_id, merged_fact, reason, at,
    new_id) with a new id per decision. Within a user, decisions act in ``seq`` order: the
    first update or delete after a memory's creation consumes its id and an update goes on
    under its new id, so later decisions on the old id do nothing. That makes every memory a
    chain of decisions; chains are followed by joins, so no user is folded in one task.

    ``embedding`` and ``source_chat_id`` are kept where the memories have them: an added memory takes
    both from its decision, an update takes the new fact's embedding and keeps the chat. With
    ``upsert``, an update whose target is unknown or consumed begins a memory of its own, at version
    2 as it replaces one. ``begin`` gives further columns of ``mem`` for memories that begin here.
    """
    begin = begin or {}
    kept = [c for c in ("source_chat_id", "embedding") if c in mem.columns]
    d = materialize(guard_decisions(decisions), "decisions")
    adds = d.filter("action = 'ADD'")
    tries = d.filter("action IN ('UPDATE', 'DELETE')")
    alive = active(mem)
    born = (alive.select("user_id", F.col("mem_id").alias("target_id"),
                         F.lit(None).cast("bigint").alias("_born"), F.lit(True).alias("_base"))
            .unionByName(adds.select("user_id", F.col("new_id").alias("target_id"),
                                     F.col("seq").cast("bigint").alias("_born"),
                                     F.lit(True).alias("_base")))
            .unionByName(tries.filter("action = 'UPDATE'").select(
                "user_id", F.col("new_id").alias("target_id"),
                F.col("seq").cast("bigint").alias("_born"), F.lit(False).alias("_base"))))
    hits = tries.join(born, ["user_id", "target_id"]).filter(
        F.col("_born").isNull() | (F.col("seq") > F.col("_born")))
    # read by the chain rounds and for what they lead to
    first = materialize(first_per(hits, ["user_id", "target_id"], ["seq"]), "attempts")
    fresh = adds.withColumn("_version", F.lit(1))
    if upsert:
        stray = tries.filter("action = 'UPDATE'").join(first.select("user_id", "new_id"),
                                                       ["user_id", "new_id"], "left_anti")
        stray = materialize(stray.withColumn("fact", F.col("merged_fact")), "upserts")
        fresh = fresh.unionByName(stray.withColumn("_version", F.lit(2)))
        starts = stray.select("user_id", F.col("new_id").alias("target_id"), F.lit(True).alias("_new"))
        first = first.join(starts, ["user_id", "target_id"], "left").withColumn(
            "_base", F.col("_base") | F.coalesce("_new", F.lit(False))).drop("_new")
    roots = _resolve_chains(first.select(
        "user_id", F.col("new_id").alias("node"), F.col("target_id").alias("ptr"),
        F.lit(1).alias("depth"), F.col("_base").alias("done")))
    # read by the end states, the history and the report
    applied = materialize(first.join(roots.select("user_id", F.col("node").alias("new_id"),
                                                  F.col("ptr").alias("root"), "depth"), ["user_id", "new_id"]),
                          "applied")
    upd = F.col("action") == "UPDATE"
    at_update = lambda c: F.max_by(c, F.when(upd, F.col("depth")))
    ends = applied.groupBy("user_id", "root").agg(
        at_update("new_id").alias("_id"), at_update("merged_fact").alias("_fact"),
        at_update("mem_type").alias("_type"), at_update("at").alias("_at"),
        F.count(F.when(upd, F.lit(1))).cast("int").alias("_ups"),
        F.max(F.when(~upd, F.col("at"))).alias("_gone"), F.max(~upd).alias("_deleted"),
        *[at_update(c).alias("_embedding") for c in kept if c == "embedding" and c in d.columns])
    start = mem.select("user_id", "mem_id", "fact", "mem_type", "timestamp", "version",
                       F.coalesce("deleted", F.lit(False)).alias("deleted"), "deleted_at", *kept, *begin)
    given = {c: F.col(c) if c in d.columns else F.lit(None).cast(mem.schema[c].dataType) for c in kept}
    start = start.unionByName(fresh.select(
        "user_id", F.col("new_id").alias("mem_id"), "fact", "mem_type",
        F.col("at").alias("timestamp"), F.col("_version").alias("version"),
        F.lit(False).alias("deleted"),
        F.lit(None).cast(mem.schema["deleted_at"].dataType).alias("deleted_at"),
        *[v.alias(c) for c, v in given.items()])
        .withColumns({c: v.cast(mem.schema[c].dataType) for c, v in begin.items()}))
    out = start.join(ends.withColumnRenamed("root", "mem_id"), ["user_id", "mem_id"], "left").select(
        "user_id", F.coalesce("_id", "mem_id").alias("mem_id"),
        F.coalesce("_fact", "fact").alias("fact"), F.coalesce("_type", "mem_type").alias("mem_type"),
        F.coalesce("_at", "timestamp").alias("timestamp"),
        (F.col("version") + F.coalesce("_ups", F.lit(0))).alias("version"),
        (F.col("deleted") | F.coalesce("_deleted", F.lit(False))).alias("deleted"),
        F.coalesce("_gone", "deleted_at").alias("deleted_at"),
        *[F.coalesce("_embedding", c).alias(c) if c == "embedding" and c in d.columns else F.col(c)
          for c in kept], *begin)
    none = F.lit(None).cast("string")
    history = fresh.select(
        "user_id", F.col("new_id").alias("root"), F.lit(0).alias("depth"),
        F.col("new_id").alias("mem_id"), "action", "fact", "at",
        F.when(F.col("_version") > 1, F.col("reason")).alias("reason"),
        none.alias("negated_by")).unionByName(applied.select(
            "user_id", "root", "depth", F.when(upd, F.col("new_id")).otherwise(
                F.col("target_id")).alias("mem_id"), "action",
            F.when(upd, F.col("merged_fact")).alias("fact"), "at", "reason",
            F.when(~upd, F.col("fact")).alias("negated_by")))
    done = applied.select("user_id", "new_id", F.lit(True).alias("_done"))
    if upsert:
        done = done.unionByName(stray.select("user_id", "new_id", F.lit(True).alias("_done")))
    report = d.join(done, ["user_id", "new_id"], "left").select(
        "user_id", "seq", F.substring("fact", 1, 80).alias("fact"),
        F.when(F.col("action").isin("UPDATE", "DELETE") & F.col("_done").isNull(), F.lit("SKIP"))
        .otherwise(F.col("action")).alias("action"))
    return out, history, report


def list_memories(mem: DataFrame, user_id=None) -> DataFrame:
    """Active rows, newest first, without history."""
    out = active(mem)
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    return out.orderBy(F.desc("timestamp"), F.asc("mem_id"))


def delete_memories(mem: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, deleted count per user); a request without ``mem_id`` takes all of a user."""
    one = requests.filter("mem_id IS NOT NULL").select("user_id", "mem_id")
    whole = requests.filter("mem_id IS NULL").select("user_id").distinct()
    hit = mem.join(one, ["user_id", "mem_id"], "left_semi").select("user_id", "mem_id").unionByName(
        mem.join(whole, "user_id", "left_semi").select("user_id", "mem_id")).distinct()
    return (mem.join(hit, ["user_id", "mem_id"], "left_anti"),
            hit.groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted")))


def turn_report(facts: DataFrame, by="turn_id") -> DataFrame:
    """Number of extracted facts per turn and one row per (fact head, action)."""
    counts = facts.groupBy(by).agg(F.count(F.lit(1)).alias("extracted"))
    return facts.select(by, F.substring("fact", 1, 80).alias("fact"), "action").join(counts, by)
