"""Chat formatting (7): quotation linking, with DataFrame functions only.

Lines are read for their quote level (``>`` marks, blanks between them allowed). A run of lines
quoted at least n deep is one passage of level n: its lines of just that level, as deeper ones are
what that message quoted itself. Its normalised text is hashed and looked up among the hashes of
what the messages say themselves. A message answers the message of its first level-1 passage that
links inside its conversation.

Rules: a passage links to the first earlier message of its own conversation that says just that, else
to the first earlier one there that says it in lines that follow each other (a quoted part, or the
parts that an answer was written between), else to the smallest (conversation, turn) of another
conversation that says just that; never to itself or a later turn of its conversation. All are
minima, of the two smallest conversations in the last case, so they are aggregated before any join
and a text that a third of all messages share meets no pairs. Runs of lines are indexed only at
the lengths that unlinked passages of their conversation have. Threads follow the answers: a thread is named by its first turn
and lists its messages by turn, so every answer stands behind what it answers.

Edge cases: null texts are empty messages; quotes of unknown texts are removed and stay unlinked;
empty passages (only marks) are no passages. Equal rows count once; of different rows with the same
(conversation, turn) the smallest (role, text) counts. Rows without conversation or turn are
dropped, as they have no place. Empty tables give no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from korvane.dist import top_per
from korvane.session import materialize

PREFIX = r"^\s*((?:>\s?)*)"


def quote_level(line: Column) -> Column:
    """Number of leading ``>`` marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 1), r"[^>]", ""))


def unquoted(line: Column, levels) -> Column:
    """The line without its first ``levels`` marks."""
    return F.regexp_replace(line, F.concat(F.lit(r"^(?:\s*>){"), F.lit(levels).cast("string"),
                                           F.lit(r"} ?")), F.lit(""))


def normal(text: Column) -> Column:
    """What two copies of a message share: letters in lower case, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def said(lines: Column) -> Column:
    """The lines that hold words."""
    return F.filter(lines, lambda x: normal(x) != "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, start, passage, n): the quoted runs of every level, within each row, and
    their lines that hold words.

    A message's lines are folded in the row itself; a message is as long as it is, and no group
    of messages ever meets in one task for this.
    """
    lines = F.filter(F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct(
        i.alias("pos"), quote_level(x).alias("level"), x.alias("line"))), lambda x: x["level"] > 0)
    rows = messages.filter(F.col("text").contains(">")).select("conv", "turn", lines.alias("lines")) \
        .filter(F.size("lines") > 0)
    rows = rows.select("conv", "turn", "lines", F.explode(
        F.sequence(F.lit(1), F.array_max("lines.level"))).alias("level"))
    deep = F.filter("lines", lambda x: x["level"] >= F.col("level"))
    rows = rows.select("conv", "turn", "level", deep.alias("deep")).filter(F.size("deep") > 0)
    # a run starts where the line before is missing from the level
    flagged = F.transform("deep", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["line"].alias("line"), x["level"].alias("level"),
        ((i == 0) | (x["pos"] != F.get("deep", i - 1)["pos"] + 1)).alias("new")))
    rows = rows.select("conv", "turn", "level", flagged.alias("deep"))
    starts = F.transform(F.filter("deep", lambda x: x["new"]), lambda x: x["pos"])
    rows = rows.select("conv", "turn", "level", "deep", starts.alias("starts"))
    rows = rows.select("conv", "turn", "level", "deep", F.posexplode(
        F.transform("starts", lambda x, i: F.struct(
            x.alias("start"), F.coalesce(F.get("starts", i + 1), F.lit(2**31 - 1)).alias("end"))))
        .alias("run", "r"))
    own = F.transform(F.filter("deep", lambda x: (x["pos"] >= F.col("r.start"))
                               & (x["pos"] < F.col("r.end")) & (x["level"] == F.col("level"))),
                      lambda x: unquoted(x["line"], F.col("level")))
    return rows.select("conv", "turn", "level", F.col("r.start").alias("start"),
                       F.array_join(own, "\n").alias("passage"), F.size(said(own)).alias("n")) \
        .filter(F.col("n") > 0)


def own_text(text: Column) -> Column:
    """A message without its quoted lines."""
    return F.trim(F.array_join(F.filter(F.split(text, "\r?\n"), lambda x: quote_level(x) == 0), "\n"))


def places(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, own): one row per place in a conversation."""
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.struct(
            F.col(role).cast("string").alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text")).alias("m")) \
        .filter(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    return rows.groupBy("conv", "turn").agg(F.min("m").alias("m")).select("conv", "turn", "m.*") \
        .withColumn("own", own_text(F.col("text")))


def parts(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, h, part_turn): runs of lines, of the lengths ``wanted`` (conv, n) by conversation."""
    lengths = materialize(wanted.groupBy("conv").agg(F.collect_set("n").alias("lengths")), "quote-lengths")
    lines = messages.join(lengths, "conv").select(
        "conv", "turn", "lengths", said(F.split("own", "\r?\n")).alias("lines"))
    runs = lines.select("conv", "turn", "lines", F.explode("lengths").alias("n")) \
        .filter(F.size("lines") > F.col("n")) \
        .select("conv", "turn", "n", "lines", F.explode(
            F.sequence(F.lit(1), F.size("lines") - F.col("n") + 1)).alias("i")) \
        .select("conv", "turn", text_hash(F.array_join(F.slice("lines", F.col("i"), F.col("n")), "\n")).alias("h"))
    return runs.groupBy("conv", "h").agg(F.min("turn").alias("part_turn"))


def link(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, start, passage, to_conv, to_turn): passages and their originals."""
    quotes = passages(messages).withColumn("h", text_hash(F.col("passage")))
    known = messages.filter(normal(F.col("own")) != "") \
        .select("conv", "turn", text_hash(F.col("own")).alias("h"))
    inside = materialize(known.groupBy("conv", "h").agg(F.min("turn").alias("in_turn")), "quotes-inside")
    two = top_per(inside, "h", ["conv"], 2, "r").groupBy("h").agg(*[
        F.max(F.when(F.col("r") == r, F.struct("conv", F.col("in_turn").alias("turn")))).alias(f"any{r}")
        for r in (1, 2)])
    quotes = materialize(quotes.join(inside, ["conv", "h"], "left"), "quotes")
    whole = F.coalesce(F.col("in_turn") < F.col("turn"), F.lit(False))
    quotes = quotes.join(parts(messages, quotes.filter(~whole).select("conv", "n")), ["conv", "h"], "left") \
        .join(materialize(two, "quotes-any"), "h", "left")
    part = F.coalesce(F.col("part_turn") < F.col("turn"), F.lit(False))
    far = F.when(F.col("any1.conv") != F.col("conv"), F.col("any1")).otherwise(F.col("any2"))
    return quotes.select(
        "conv", "turn", "level", "start", "passage",
        F.when(whole | part, F.col("conv")).otherwise(far["conv"]).alias("to_conv"),
        F.when(whole, F.col("in_turn")).when(part, F.col("part_turn")).otherwise(far["turn"]).alias("to_turn"))


def answers(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Each message with the turn it answers and its thread, by pointer doubling."""
    first = links.filter((F.col("level") == 1) & (F.col("to_conv") == F.col("conv"))) \
        .groupBy("conv", "turn").agg(F.min(F.struct("start", "to_turn")).alias("f"))
    n = links.groupBy("conv", "turn").agg(F.count("level").alias("n_quotes"),
                                          F.count("to_turn").alias("n_linked"))
    up = materialize(
        messages.join(first, ["conv", "turn"], "left").join(n, ["conv", "turn"], "left")
        .select("conv", "turn", "role", F.col("own").alias("text"), F.col("f.to_turn").alias("reply_to"),
                F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "answers")
    # pointer doubling; a message whose pointer has reached a thread's first turn is done
    open_ = materialize(up.filter("reply_to is not null")
                        .select("conv", "turn", F.col("reply_to").alias("top"),
                                F.lit(1).cast("long").alias("depth")), "open")
    done = None
    while not open_.isEmpty():
        known = open_ if done is None else open_.union(done)
        step = materialize(
            open_.join(known.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"),
                                    F.col("depth").alias("more")), ["conv", "top"], "left")
            .select("conv", "turn", F.coalesce("next", "top").alias("top"),
                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                    F.col("next").isNull().alias("done")), "step")
        ended = step.filter("done").drop("done")
        done = ended if done is None else done.union(ended)
        open_ = step.filter("not done").drop("done")
    jump = open_ if done is None else done
    return up.join(jump, ["conv", "turn"], "left") \
        .withColumns({"thread": F.coalesce("top", "turn"), "depth": F.coalesce("depth", F.lit(0))}) \
        .drop("top")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", page: int = 64) -> DataFrame:
    """One row per thread and page of at most ``page`` turns: its messages in reply order."""
    rows = materialize(places(messages, conv, turn, role, text), "messages")
    rows = answers(rows, link(rows))
    message = F.struct("turn", "depth", "reply_to", "role", "text", "n_quotes", "n_linked")
    return (rows.withColumn("page", F.floor((F.col("turn") - F.col("thread")) / page))
            .groupBy("conv", "thread", "page")
            .agg(F.sort_array(F.collect_list(message)).alias("messages"))
            .select(F.col("conv").alias(conv), "thread", "page",
                    F.size("messages").cast("long").alias("n_messages"), "messages"))


def as_mail(chats: DataFrame, levels: int = 2) -> DataFrame:
    """Chats as a mail list would hold them: every message quotes the one it answers, which quoted too.

    A message answers its predecessor, every third one the message two turns before. One in four is
    written between the halves of what it quotes, one in four quotes the last half only.
    """
    base = chats.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("own")).distinct()
    made = base.withColumn("text", F.col("own"))
    back = F.when(F.col("turn") % 3 == 0, 2).otherwise(1)
    for _ in range(levels):
        before = made.groupBy("conv_id", F.col("turn").alias("asked")) \
            .agg(F.min("text").alias("quoted"))
        made = (base.withColumn("asked", F.col("turn") - back)
                .join(before, ["conv_id", "asked"], "left")
                .withColumn("lines", F.transform(F.split("quoted", "\n"), lambda x: F.concat(F.lit("> "), x)))
                .withColumn("half", F.floor(F.size("lines") / 2).cast("int"))
                .withColumn("text", F.when(F.col("quoted").isNull(), F.col("own")).otherwise(F.array_join(
                    F.when(F.col("turn") % 4 == 1, F.concat(
                        F.slice("lines", F.lit(1), F.col("half")), F.array("own"),
                        F.slice("lines", F.col("half") + 1, F.size("lines"))))
                    .when(F.col("turn") % 4 == 2, F.concat(
                        F.slice("lines", F.col("half") + 1, F.size("lines")), F.array("own")))
                    .otherwise(F.concat("lines", F.array("own"))), "\n")))
                .select("conv_id", "turn", "role", "own", "text"))
    return made.drop("own")
