"""Rule gates in front of retrieval: spam, canned answers, sentiment labels, routing.

The rules are lists of constants, so they become expressions on the turn's text and every
gate is a projection: no join, no shuffle, the same in batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..dist import top_per
from ..functions import text as tx

MAX_QUICK_CHARS = 80
I = "(?iU)"  # noqa: E741


def meaningless(text) -> Column:
    return tx.let(tx.strip(F.coalesce(tx._c(text), F.lit(""))), lambda t: (
        (t == "") | tx.has_long_repeat(t) | tx.consonant_run(t) | tx.low_alpha(t)
        | tx.low_vowel(t) | tx.all_symbols(t)))


def abuse_kind(text, offensive=fixed.OFFENSIVE_TERMS, jailbreak=fixed.JAILBREAK_PHRASES) -> Column:
    """Offensive terms are looked for before jailbreak phrases."""
    t = tx.strip(F.coalesce(tx._c(text), F.lit("")))
    return (F.when(tx.term_match(t, offensive), F.lit("offensive"))
            .when(tx.term_match(t, jailbreak), F.lit("jailbreak")))


def spam_reasons(text, **lists) -> Column:
    """Sorted names of the signals that fire."""
    t = F.coalesce(tx._c(text), F.lit(""))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_sort(F.array_compact(F.array(
        flag(meaningless(t), "meaningless_text"), flag(tx.has_long_repeat(t), "long_repeat"),
        flag(tx.has_link(t), "contains_link"), flag(tx.heavy_punct(t), "heavy_punct"),
        flag(tx.many_emojis(t), "many_emojis"), abuse_kind(t, **lists))))


def spam_gate(df: DataFrame, text="text", **lists) -> DataFrame:
    out = df.withColumn("spam_reasons", spam_reasons(text, **lists))
    return out.withColumns({"spam_score": F.size("spam_reasons"),
                            "is_spam": F.size("spam_reasons") > 0})


def legal_looking(norm: Column, pattern=fixed.LEGAL_QUERY_PATTERN) -> Column:
    return norm.rlike(I + pattern)


def quick_key(text, keys=tuple(fixed.QUICK_KEYS), word_boundary: bool = False,
              legal=fixed.LEGAL_QUERY_PATTERN) -> Column:
    """The canned-answer key a short text matches, else null.

    Longest key first: equal or prefix; then, for keys of eight or more characters, anywhere
    in the text. ``word_boundary`` asks for a space after a prefix.
    """
    ordered = sorted(keys, key=len, reverse=True)

    def match(norm):
        out = F.when((F.length(norm) > MAX_QUICK_CHARS) | legal_looking(norm, legal),
                     F.lit(None).cast("string"))
        for key in ordered:
            hit = (norm == key) | norm.startswith(key + (" " if word_boundary else ""))
            out = out.when(hit, F.lit(key))
        for key in ordered:
            if len(key) >= 8:
                out = out.when(F.contains(norm, F.lit(key)), F.lit(key))
        return out

    return tx.let(tx.normalize(text, strip_punct=True), match)


def is_meta(text, pattern=fixed.META_PATTERN, legal=fixed.LEGAL_QUERY_PATTERN) -> Column:
    """Greeting or ability question, short and not about the law."""
    return tx.let(tx.normalize(text, strip_punct=True), lambda norm: (
        (norm != "") & (F.length(norm) <= MAX_QUICK_CHARS) & ~legal_looking(norm, legal)
        & norm.rlike(I + pattern)))


def answer_of(key: Column, answers: dict[str, str]) -> Column:
    out = None
    for k, v in answers.items():
        cond = key == k
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.lit(None).cast("string") if out is None else out


def quick_match(df: DataFrame, answers: dict[str, str], text="text", **kw) -> DataFrame:
    """Canned answer per turn; ``answers`` maps keys to texts."""
    out = df.withColumn("quick_key", quick_key(text, tuple(answers), **kw))
    return out.withColumn("quick_answer", answer_of(F.col("quick_key"), answers))


def meta_match(df: DataFrame, answers: dict[str, str], text="text",
               default_key=fixed.META_DEFAULT_KEY, **kw) -> DataFrame:
    """The default answer where the turn is small talk."""
    out = df.withColumn("is_meta", is_meta(text, **kw))
    return out.withColumn("meta_answer", F.when(F.col("is_meta"), F.lit(answers.get(default_key))))


def select_labels(scores: DataFrame, k: int = 2, tau: float = 0.2, by="turn_id",
                  label="label", score="score", pos="pos") -> DataFrame:
    """The best k labels at or above tau; else the best one, marked undetermined."""
    best = top_per(scores, by, [F.desc(score), F.asc(pos)], max(k, 1))
    keep = (F.col("rank") <= k) & (F.col(score) >= tau)
    undetermined = (F.col("rank") == 1) & (F.col(score) < tau)
    return best.filter(keep | undetermined).select(
        by, F.col(label).alias("label"), F.round(F.col(score).cast("double"), 4).alias("confidence"),
        "rank", undetermined.alias("undetermined"))


def sentiment_flags(labels: DataFrame, by="turn_id", negative=tuple(fixed.NEGATIVE_LABELS),
                    info="neutral_info") -> DataFrame:
    """Labels of a turn as one text with the negative and information flags (at most k
    labels per turn)."""
    sure = labels.filter(~F.col("undetermined"))
    return sure.groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))),
                                 lambda s: s["label"]), ", ").alias("sentiment"),
        F.max(F.col("label").isin(*negative)).alias("is_negative"),
        F.max(F.col("label") == info).alias("is_findinfo"))


def resolve_tone(sentiment, labels=tuple(fixed.TONE_LABELS), neutral="neutral_info") -> Column:
    """First known label that is not neutral, else neutral."""
    parts = F.transform(F.split(F.coalesce(tx._c(sentiment), F.lit("")), ","), tx.strip)
    known = F.array(*[F.lit(x) for x in labels if x != neutral])
    return F.coalesce(F.get(F.filter(parts, lambda p: F.array_contains(known, p)), F.lit(0)),
                      F.lit(neutral))


def tone_text(df: DataFrame, tones: dict[str, str], sentiment="sentiment") -> DataFrame:
    """Tone label and its supplied text."""
    out = df.withColumn("tone", resolve_tone(sentiment, tuple(tones)))
    return out.withColumn("tone_text", F.coalesce(answer_of(F.col("tone"), tones),
                                                  F.lit(tones.get("neutral_info"))))


def route_turns(df: DataFrame, answers: dict[str, str], text="text", sentiment="sentiment",
                negative="is_negative", info="is_findinfo", **lists) -> DataFrame:
    """One decision per turn: quick answer, spam, escalate or proceed.

    Sentiment columns are input; absent ones count as neutral.
    """
    for name, default in ((sentiment, None), (negative, False), (info, False)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast("string" if default is None
                                                         else "boolean"))
    key = quick_key(text, tuple(answers))
    d = df.withColumns({
        "_key": key, "_meta": is_meta(text) & F.lit(fixed.META_DEFAULT_KEY in answers),
        "_reasons": spam_reasons(text, **lists)})
    quick, meta = F.col("_key").isNotNull(), F.col("_meta")
    spam = F.size("_reasons") > 0
    neg = F.coalesce(F.col(negative), F.lit(False))
    inf = F.coalesce(F.col(info), F.lit(False))
    mood = F.coalesce(F.col(sentiment), F.lit(""))
    answered = quick | meta
    escalate = ~answered & ~spam & neg & ~inf
    return d.withColumns({
        "action": F.when(answered, "quick_answer").when(spam, "spam").when(escalate, "escalate")
                   .otherwise("proceed"),
        "reason": F.when(quick, "quick_question_match").when(meta, "meta_conversation")
                   .when(spam, F.array_join("_reasons", ", ")).when(escalate, mood).otherwise(""),
        "answer_key": F.when(quick, F.col("_key")).when(meta, F.lit(fixed.META_DEFAULT_KEY)),
        "normalized_prompt": F.lower(tx.strip(F.coalesce(F.col(text), F.lit("")))),
        "route_sentiment": F.when(answered | spam | escalate, F.lit(None).cast("string"))
                            .when(inf, mood).otherwise(F.lit("neutral")),
    }).drop("_key", "_meta", "_reasons")


def scope_gate(df: DataFrame, intent="intent", text="text") -> DataFrame:
    """Refuse turns whose supplied intent says no, unless they are small talk."""
    verdict = F.coalesce(tx.nonblank(intent), F.lit("Có"))
    return df.withColumn("refused", F.contains(F.lower(verdict), F.lit("không")) & ~is_meta(text))
