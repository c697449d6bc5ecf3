"""Analyzer and multi-field lexical ranking over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed
from ..dist import top_per
from ..functions import text as tx
from ..session import materialize

K1, B = 1.2, 0.75


def analyze(col, stop=tuple(fixed.STOPWORDS)) -> Column:
    """Word tokens, lower case, without stop words and punctuation.

    The underscore is the only punctuation a word token can hold, so it goes first.
    """
    clean = tx.words(F.translate(tx._c(col), "_", ""))
    return F.filter(clean, lambda t: ~t.isin(*stop)) if stop else clean


def ngrams(tokens: Column, longest: int, heads: Column) -> Column:
    """Runs of up to ``longest`` neighbouring tokens that start with one of ``heads``."""
    starts = F.filter(F.sequence(F.lit(1), F.size(tokens)),
                      lambda i: F.array_contains(heads, F.get(tokens, i - 1)))
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size(tokens) - i + 1)),
        lambda n: F.array_join(F.slice(tokens, i, n), " "))))


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def expand(tokens: Column, groups=tuple(fixed.SYNONYM_GROUPS)) -> Column:
    """Tokens plus one group token (``~N``) for every synonym phrase that occurs.

    Texts without the first word of any phrase pass unchanged.
    """
    table: dict[str, list[str]] = {}
    for i, group in enumerate(groups):
        for phrase in group.split(","):
            table.setdefault(phrase.strip().lower(), []).append(f"~{i}")
    if not table:
        return tokens
    # one parsed expression each: hundreds of single literals would cost a second to build
    array = lambda items: "array(" + ", ".join(_quote(i) for i in items) + ")"
    heads = F.expr(array(sorted({p.split()[0] for p in table})))
    names = F.expr("map(" + ", ".join(f"{_quote(p)}, {array(g)}" for p, g in table.items()) + ")")
    none = F.array().cast("array<string>")

    def grown(toks):
        runs = ngrams(toks, max(len(p.split()) for p in table), heads)
        found = F.flatten(F.transform(runs, lambda g: F.coalesce(F.try_element_at(names, g), none)))
        return F.when(F.arrays_overlap(toks, heads), F.concat(toks, found)).otherwise(toks)

    return tx.let(tokens, grown)


ANY = "~any"
TASK_CHARS, TASK_SUMS = 4 << 20, 1 << 20    # of texts to count and of (query, document, term) rows to add up


def postings(docs: DataFrame, fields: list[str], vocabulary: DataFrame, id: str, stop,
             synonyms) -> DataFrame:
    """(id, field, len, term, tf) of the terms in ``vocabulary``; ``~any`` marks every field with words.

    Every field is tokenised once. Documents are dealt out first, to tasks of about ``TASK_CHARS``
    characters: what a task counts stays bounded however large the table, and postings need no
    further shuffle.
    """
    chars = docs.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).cast("long"))).first()[0]
    dealt = docs.repartition(1 + (chars or 0) // TASK_CHARS, id)
    per_field = F.array(*[F.struct(F.lit(i).alias("field"), analyze(f, stop).alias("t"))
                          for i, f in enumerate(fields)])
    flat = dealt.select(id, F.explode(per_field).alias("f")).filter(F.size("f.t") > 0)
    terms = F.concat(expand(F.col("f.t"), synonyms), F.array(F.lit(ANY)))
    rows = flat.select(id, "f.field", F.size("f.t").alias("len"), F.explode(terms).alias("term"))
    marker = vocabulary.sparkSession.createDataFrame([(ANY,)], "term string")
    # written out, as its true size lets the planner broadcast it where it is small
    known = materialize(vocabulary.union(marker), "vocabulary")
    return rows.join(known, "term", "left_semi") \
        .groupBy(id, "field", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def impacts(posts: DataFrame, boosts: list[float], k1: float, b: float, id: str) -> DataFrame:
    """(id, field, term, g): what one occurrence of the term in a query adds to the field's score."""
    whole = posts.filter(F.col("term") == ANY).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"))
    df = posts.filter(F.col("term") != ANY).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(F.broadcast(whole), "field").select(     # a row per field
        "field", "term", "avglen", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = materialize(weights, "weights")        # a row per field and term of the queries
    boost = F.array(*[F.lit(float(w)) for w in boosts])
    tf = F.col("tf")
    gain = F.col("idf") * tf / (tf + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    return posts.join(weights, ["field", "term"]).select(
        id, "field", "term", (gain * F.get(boost, F.col("field"))).alias("g"))


def bm25_search(queries: DataFrame, docs: DataFrame, boosts: dict[str, float], k: int = 20, *,
                query_id="query_id", q_text="q_text", id="id", stop=tuple(fixed.STOPWORDS),
                synonyms=tuple(fixed.SYNONYM_GROUPS), k1: float = K1, b: float = B) -> DataFrame:
    """Best boosted field score per document, top k per query.

    One plan for any number of queries: impact postings of the queries' terms are written once, dealt
    out by document and summed there, so (query, document) pairs are never shuffled; each task hands
    on ``k`` rows per query, cut by the score that is returned. Tasks are as many as keep the rows that
    one adds up at about ``TASK_SUMS``, counted beforehand from the postings and queries of each term.
    """
    terms = expand(analyze(q_text, stop), synonyms)
    q = materialize(queries.select(query_id, F.explode(terms).alias("term"))
                    .groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf")), "query-terms")
    posts = materialize(postings(docs.select(id, *boosts), list(boosts), q.select("term").distinct(), id,
                                 stop, synonyms), "postings")
    gains = impacts(posts, list(boosts.values()), k1, b, id)
    per_term = posts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(
        q.groupBy("term").agg(F.count(F.lit(1)).alias("m")), "term")
    sums = per_term.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    field = (gains.repartition(1 + sums // TASK_SUMS, id).join(q, "term").groupBy(query_id, id, "field")
             .agg(F.sum(F.col("g") * F.col("qtf")).alias("s")))
    best = field.groupBy(query_id, id).agg(F.round(F.max("s"), 9).alias("score")).filter("score > 0")
    return top_per(best, query_id, [F.desc("score"), F.asc(id)], k)
