"""Chats and messages: assembly, upserts, commands, marks and history windows.

Messages are kept as rows; nested chats are built page by page, so one very long chat is
many bounded rows rather than one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..dist import first_per, position_within, top_per
from ..functions import text as tx
from ..schemas import MESSAGE

PAGE = 1000


def assemble_chats(sessions: DataFrame, messages: DataFrame, page_size: int = PAGE,
                   id="id") -> DataFrame:
    """Chats with their messages in id order, ``page_size`` messages per row (``page`` 0 is
    the whole chat unless it is longer). Chats without messages keep one empty page."""
    placed = position_within(messages, "session_id", id, "_pos")
    pages = (placed.withColumn("page", F.floor(F.col("_pos") / page_size).cast("int"))
             .groupBy("session_id", "page").agg(F.transform(
                 F.array_sort(F.collect_list(F.struct("_pos", "role", "content"))),
                 lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
                 .alias("messages")))
    s = sessions.withColumnRenamed("id", "session_id")
    created = F.coalesce("created_at", F.lit(""))
    return (s.join(pages, "session_id", "left").select(
        F.col("session_id").alias("chat_id"), F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce(tx.nonblank("title"), F.lit(fixed.EMPTY_TITLE)).alias("title"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"), created.alias("created_at"),
        F.coalesce("updated_at", created).alias("updated_at"),
        F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>"))
        .alias("messages")))


def flatten_chats(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) rows of nested chats."""
    sessions = chats.select("chat_id", "title", "pinned", "created_at", "updated_at")
    messages = chats.select("chat_id", F.posexplode("messages").alias("pos", "m")).select(
        "chat_id", "pos", "m.*")
    return sessions, messages


def upsert_chats(base: DataFrame, updates: DataFrame, seq="seq") -> DataFrame:
    """Whole-chat upsert: the last update replaces everything but ``created_at``."""
    last = first_per(updates, "chat_id", [F.desc(seq)]).drop(seq)
    cols = [c for c in base.columns if c != "chat_id"]
    old = base.select("chat_id", F.lit(True).alias("_has"),
                      *[F.col(c).alias(f"_o_{c}") for c in cols])
    new = last.select("chat_id", F.lit(True).alias("_upd"), *cols)
    both = new.join(old, "chat_id", "full")

    def pick(c):
        if c == "created_at":
            return F.coalesce("_o_created_at", "created_at").alias(c)
        return F.when(F.col("_upd"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c)

    return both.select("chat_id", *[pick(c) for c in cols])


def merge_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """New messages by position; an audio url of the old message stays if the new has none.

    Both sides are message rows ``(chat_id, pos, role, content, tts_url)``, so the merge is a
    join on (chat, position).
    """
    prev = old.select("chat_id", "pos", F.col("tts_url").alias("_old_url"))
    joined = new.join(prev, ["chat_id", "pos"], "left")
    return joined.withColumn("tts_url", F.coalesce(tx.nonblank("tts_url"), tx.nonblank("_old_url"))) \
        .drop("_old_url")


def merge_message_arrays(old_messages, new_messages) -> Column:
    """The same rule on nested arrays."""
    old_messages, new_messages = tx._c(old_messages), tx._c(new_messages)
    names = [f.name for f in MESSAGE.fields]

    def merged(m, i):
        kept = F.get(old_messages, i)["tts_url"]
        return F.struct(*[(F.coalesce(tx.nonblank(m["tts_url"]), tx.nonblank(kept))
                           if n == "tts_url" else m[n]).alias(n) for n in names])

    return F.transform(new_messages, merged)


def drop_empty(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions that have at least one message."""
    return sessions.join(messages.select(F.col("session_id").alias("id")), "id", "left_semi")


def apply_chat_commands(chats: DataFrame, cmds: DataFrame) -> DataFrame:
    """Create / rename / pin / toggle / delete commands in ``seq`` order.

    ``cmds`` = (chat_id, seq, op, value). Only commands after the last create or delete of a
    chat count; all of it is partial aggregation, so a busy chat is no problem.
    """
    op = F.col("op")
    life = cmds.groupBy("chat_id").agg(
        F.max(F.when(op == "create", F.col("seq"))).alias("_c"),
        F.max(F.when(op == "delete", F.col("seq"))).alias("_d"),
        F.max_by(F.when(op == "create", F.col("value")), F.when(op == "create", F.col("seq")))
        .alias("_title"))
    start = F.coalesce(F.greatest("_c", "_d"), F.lit(-1))
    live = cmds.join(life.select("chat_id", start.alias("_s")), "chat_id").filter("seq > _s")
    sets = live.groupBy("chat_id").agg(
        F.max_by("value", F.when(op == "rename", F.col("seq"))).alias("_name"),
        F.max(F.when(op == "pin", F.col("seq"))).alias("_ps"),
        F.max_by("value", F.when(op == "pin", F.col("seq"))).alias("_pin"))
    flips = (live.filter(op == "toggle").join(sets.select("chat_id", "_ps"), "chat_id")
             .filter(F.col("_ps").isNull() | (F.col("seq") > F.col("_ps")))
             .groupBy("chat_id").agg(F.count(F.lit(1)).alias("_flips")))
    base = chats.select("chat_id", "title", "pinned", F.lit(True).alias("_has"))
    out = (base.join(life, "chat_id", "full").join(sets, "chat_id", "left")
           .join(flips, "chat_id", "left"))
    created = F.col("_c").isNotNull() & (F.coalesce("_d", F.lit(-1)) < F.col("_c"))
    removed = F.col("_d").isNotNull() & ~created
    title = F.coalesce("_name", F.when(created, F.coalesce("_title", F.lit(fixed.EMPTY_TITLE)))
                       .otherwise(F.col("title")))
    pin0 = (F.when(F.col("_ps").isNotNull(), F.col("_pin") == "true")
            .when(created, F.lit(False)).otherwise(F.coalesce("pinned", F.lit(False))))
    odd = F.coalesce("_flips", F.lit(0)) % 2 == 1
    return (out.filter((F.col("_has").isNotNull() & ~removed) | created)
            .select("chat_id", title.alias("title"),
                    F.when(odd, ~pin0).otherwise(pin0).alias("pinned")))


def last_updated(df: DataFrame) -> Column:
    """First present of the update and creation stamps in either spelling."""
    names = [c for c in ("updated_at", "updatedAt", "created_at", "createdAt") if c in df.columns]
    return F.coalesce(*[tx.nonblank(F.col(c).cast("string")) for c in names], F.lit(""))


def order_chats(df: DataFrame) -> DataFrame:
    """Pinned first, then the latest update."""
    return df.orderBy(F.desc(F.coalesce("pinned", F.lit(False))), F.desc(last_updated(df)),
                      F.asc("chat_id"))


def search_chats(df: DataFrame, user_id, term: str | None = None,
                 pinned: bool | None = None) -> DataFrame:
    out = df.filter(F.col("user_id") == user_id)
    if term:
        out = out.filter(F.contains(F.lower("title"), F.lit(term.strip().lower())))
    if pinned is not None:
        out = out.filter(F.coalesce("pinned", F.lit(False)) == pinned)
    return out


def apply_message_marks(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Last feedback or audio url per (chat, position) set on the message rows.

    ``marks`` = (chat_id, pos, field, value, seq) with field ``feedback`` or ``tts_url``.
    """
    seq = lambda f: F.when(F.col("field") == f, F.col("seq"))
    last = marks.groupBy("chat_id", "pos").agg(
        *[F.max_by("value", seq(f)).alias(f"_{f}") for f in ("feedback", "tts_url")],
        *[F.max(seq(f)).alias(f"_s_{f}") for f in ("feedback", "tts_url")])
    out = messages.join(last, ["chat_id", "pos"], "left")
    for f in ("feedback", "tts_url"):
        had = F.col(f) if f in messages.columns else F.lit(None).cast("string")
        out = out.withColumn(f, F.when(F.col(f"_s_{f}").isNotNull(), F.col(f"_{f}")).otherwise(had))
    return out.drop(*[f"{p}{f}" for p in ("_", "_s_") for f in ("feedback", "tts_url")])


def title_inputs(messages: DataFrame, n: int = 3, chat="chat_id", pos="pos",
                 content="content") -> DataFrame:
    """First n non-blank user messages of each chat as ``- …`` lines."""
    text = tx.strip(F.coalesce(content, F.lit("")))
    users = messages.filter("role = 'user'").withColumn("_t", text).filter("_t <> ''")
    first = top_per(users.select(chat, pos, "_t"), chat, [pos], n)
    return first.groupBy(chat).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_t"))),
        lambda s: F.concat(F.lit("- "), s["_t"])), "\n").alias("title_input"))


def auto_title(chats: DataFrame, messages: DataFrame, chat="chat_id", pos="pos",
               content="content", chars: int = 40) -> DataFrame:
    """Title from the first user message while the chat still has a default title."""
    first = first_per(messages.filter("role = 'user'").select(
        chat, pos, tx.strip(F.coalesce(content, F.lit(""))).alias("_t")), chat, [pos])
    cut = F.when(F.length("_t") > chars, F.concat(F.substring("_t", 1, chars), F.lit("..."))) \
        .otherwise(F.col("_t"))
    keep = (~F.coalesce(F.col("title"), F.lit("")).startswith(fixed.DEFAULT_TITLE)
            | tx.nonblank("_t").isNull())
    return chats.join(first.drop(pos), chat, "left").withColumn(
        "title", F.when(keep, F.col("title")).otherwise(cut)).drop("_t")


def cap_words(col, n: int = 10) -> Column:
    """First n words of a supplied title."""
    toks = tx.tokens(tx.strip(col))
    return F.when(F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(tx.strip(col))


def history_window(turns: DataFrame, n: int, chat="chat_id", pos="pos", content="content",
                   span: int = 1024) -> DataFrame:
    """For every user turn, the n turns before it as ``Role: text`` lines.

    The turn itself is not part of its history. ``pos`` counts the turns of a chat, so a
    chat is cut into spans with the last n turns of one span repeated at the head of the
    next: a long chat is spread over many tasks and each window sees all it needs.
    """
    span = max(span, n + 1)
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce(content, F.lit("")))
    rows = turns.select(chat, pos, "role", line.alias("_l"))
    own = F.floor(F.col(pos) / span)
    placed = rows.withColumn("_b", F.explode(F.when(
        F.col(pos) % span >= span - n, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy(chat, "_b").orderBy(pos).rowsBetween(-n, -1)
    seen = placed.withColumn("_h", F.collect_list("_l").over(w))
    return seen.filter((F.col("role") == "user") & (F.col("_b") == own)).select(
        chat, pos, F.array_join("_h", "\n").alias("history"), F.size("_h").alias("n_turns"))


def retag_user(df: DataFrame, claims: DataFrame, user="user_id") -> DataFrame:
    """Move rows of claimed anonymous ids to the real id; ids stay as they are.

    ``claims`` = (anonymous_id, uid); a claim counts when both are given and the anonymous id
    starts with ``demo_``.
    """
    anon = tx.strip(F.coalesce("anonymous_id", F.lit("")))
    good = (claims.select(anon.alias("_anon"), tx.nonblank("uid").alias("_uid"))
            .filter(F.col("_uid").isNotNull() & F.col("_anon").startswith("demo_"))
            .groupBy("_anon").agg(F.min("_uid").alias("_uid")))
    out = df.join(good, df[user] == good["_anon"], "left")
    return (out.withColumn("moved", F.col("_uid").isNotNull())
            .withColumn(user, F.coalesce("_uid", user)).drop("_anon", "_uid"))


def owner_filter(df: DataFrame, requests: DataFrame, id="chat_id") -> tuple[DataFrame, DataFrame]:
    """(allowed, refused) requests ``(id, user_id)``: the row must belong to the user."""
    keys = df.select(id, "user_id")
    return (requests.join(keys, [id, "user_id"], "left_semi"),
            requests.join(keys, [id, "user_id"], "left_anti"))
