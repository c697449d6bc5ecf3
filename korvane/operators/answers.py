"""Answer quality over a table of (response, gold) pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.stem import porter
from ..functions.vectors import cosine
from ..session import materialize

BLEU_K = 5  # constant of the fourth published smoothing rule


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, one machine word row per token of ``b``."""
    where: dict = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _numbers(tokens: pa.ListArray, seen: dict[str, int], stem: bool) -> list[np.ndarray]:
    """Token numbers per row; every different token of a batch is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    words = [porter(w) if stem and len(w) > 3 else w for w in coded.dictionary.to_pylist()]
    number = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    flat = number[coded.indices.to_numpy(zero_copy_only=False)]
    return np.split(flat, np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def rouge_l(response, gold, ascii_only: bool = False, stem: bool = False) -> Column:
    """ROUGE-L F over lower-case tokens; null texts are empty and score 0.

    ``ascii_only`` keeps ``[a-z0-9]`` runs only, as the usual tokenizer does; the default keeps letters
    of any script. ``stem`` compares the Porter stems of tokens of more than three letters. Texts
    are tokenised by Spark, tasks see batches of tokens.
    """
    pattern = "([a-z0-9]+)" if ascii_only else tx.WORD

    def words(c):
        return F.regexp_extract_all(F.lower(F.coalesce(tx._c(c), F.lit(""))), F.lit(pattern), F.lit(1))

    @F.arrow_udf("double")
    def score(r: pa.Array, g: pa.Array) -> pa.Array:
        seen: dict[str, int] = {}
        pairs = zip(_numbers(r, seen, stem), _numbers(g, seen, stem)) if len(r) else ()
        out = []
        for b, a in pairs:
            same = _lcs(a.tolist(), b.tolist()) if len(a) and len(b) else 0
            out.append(2 * same / (len(a) + len(b)) if same else 0.0)
        return pa.array(out, pa.float64())

    return score(words(response), words(gold))


def with_bleu(df: DataFrame, response: str, gold: str, out: str = "bleu") -> DataFrame:
    """Sentence BLEU up to 4-grams over white-space tokens, smoothed.

    The n-grams of both texts are rows; their clipped counts are sums that combine before they
    travel. Null texts are empty ones and score 0.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "answers")
    sides = rows.select("_row", tx.tokens(F.coalesce(response, F.lit(""))).alias("h"),
                        tx.tokens(F.coalesce(gold, F.lit(""))).alias("r"))

    def grams(side: str) -> DataFrame:
        def of(n):
            return F.when(F.size(side) >= n, F.transform(
                F.sequence(F.lit(1), F.size(side) - (n - 1)), lambda i: F.struct(
                    F.lit(n).alias("n"), F.array_join(F.slice(side, i, n), " ").alias("g"))))

        runs = [of(n) for n in range(1, 5)]
        return sides.select("_row", F.explode(F.flatten(F.array_compact(F.array(*runs)))).alias("x"),
                            *[F.lit(int(side == s)).alias(s) for s in "hr"])

    hits = (grams("h").union(grams("r")).groupBy("_row", "x").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
            .groupBy("_row").agg(*[F.sum(F.when(F.col("x.n") == n, F.least("h", "r"))).alias(f"_{n}")
                                   for n in range(1, 5)]))
    found = sides.select("_row", F.size("h").alias("hl"), F.size("r").alias("rl")) \
        .join(hits, "_row", "left").fillna(0)
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        none = F.col(f"_{n}") == 0
        zeros = zeros + none.cast("int")
        share = F.when(none, F.log("hl") / (F.pow(F.lit(2), zeros) * BLEU_K)).otherwise(F.col(f"_{n}"))
        share = share / F.greatest(F.lit(1), F.col("hl") - (n - 1))
        logs = logs + F.when(share > 0, 0.25 * F.log(share)).otherwise(0)
    brevity = F.when(F.col("hl") > F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    score = F.when(F.col("_1") == 0, 0.0).otherwise(brevity * F.exp(logs))
    return rows.join(found.select("_row", score.alias(out)), "_row").drop("_row")


def answer_similarity(response_vec, gold_vec) -> Column:
    return cosine(response_vec, gold_vec)
