"""Benchmark decontamination (5): winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive word 4-grams the one with the smallest hash is kept, in
documents and items alike, so a shared run of ten words always shares a kept 4-gram. Documents'
fingerprints join the items', and each hit is extended to the windows around it, which join the
items' windows by their words; the result is exact. Items with fewer words than a window keep
their only n-gram and meet all n-grams of that length.

Edge cases: null or empty texts have no words and no hits; rows of ``benchmark`` without an id or
words are no items; repeated ids count once, repeated documents each get their row (also with null
ids). Ties in a window keep the rightmost 4-gram on both sides. Empty tables give no rows or no
hits. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from korvane.session import materialize

from . import arrays as A
from .bitmaps import Bitmap, build

WINDOW = 10
GRAM = 4
BITS = 24                 # two megabytes, whatever the size of the benchmark
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(part: pa.RecordBatch, column: str, hasher: A.RangeHash):
    """Lower-cased bytes, word ranges, the text of each word and the word hashes."""
    data, offsets = A.text_bytes(part.column(column))
    data = A.LOWER[data]
    starts, ends = A.ranges(A.ALNUM_SPLIT[data], offsets)
    return data, starts, ends, A.owner(starts, offsets), hasher(data, starts, ends)


def winnow(hashes: np.ndarray, texts: np.ndarray, window: int, gram: int):
    """Kept grams: their hashes and the number of their first word."""
    g, first = A.grams(hashes, texts, gram)
    width = window - gram + 1
    if len(g) < width:
        return g[:0], first[:0]
    views = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.flatnonzero(texts[first[:len(views)]] == texts[first[width - 1:]])
    kept = np.zeros(len(g), bool)
    for lo in range(0, len(at), 1 << 16):
        some = at[lo:lo + (1 << 16)]
        kept[some + width - 1 - np.argmin(views[some, ::-1], axis=1)] = True
    return g[kept], first[kept]


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id as string, words) of all items."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, SMALL), F.lit(WORD), F.lit(0))
    return items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")) \
        .filter(F.col("item").isNotNull() & (F.size("words") > 0))


def windows_of(words, first, size, window: int):
    """Array of (start, n, text) of all windows in ``words``, whose first word has number ``first``."""
    return F.transform(F.sequence(F.lit(0), size - window), lambda i: F.struct(
        (first + i).alias("start"), window.alias("n"),
        F.array_join(F.slice(words, i + 1, window), " ").alias("window")))


def item_prints(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(n, print): the fingerprints of the items by window length."""
    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "text"):
                *_, texts, hashes = split(part, "text", hasher)
                long, _ = winnow(hashes, texts, window, gram)
                n, prints = [np.full(len(long), window)], [long]
                sizes = np.bincount(texts, minlength=part.num_rows)
                for size in np.unique(sizes[(sizes > 0) & (sizes < window)]):
                    g, first = A.grams(hashes, texts, int(size))
                    g = g[sizes[texts[first]] == size]
                    n.append(np.full(len(g), size)), prints.append(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(n), pa.int32()),
                     pa.array(A.signed(np.concatenate(prints)))], names=["n", "print"])

    text = items.select(F.array_join("words", " ").alias("text"))
    return text.mapInArrow(run, "n int, print long").distinct()


CANDIDATE = pa.struct([("n", pa.int32()), ("print", pa.int64()), ("start", pa.int32()),
                       ("words", pa.list_(pa.string()))])


def candidates(docs: DataFrame, id_col: str, text_col: str, shared, lengths: list[int],
               window: int, gram: int) -> DataFrame:
    """A row per document: a key, its id, its number of words and the fingerprints that may hit."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        hasher, present = A.RangeHash(), Bitmap(shared)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in A.slices(batch, "_text"):
                data, starts, ends, texts, hashes = split(part, "_text", hasher)
                rows = part.num_rows
                sizes = np.bincount(texts, minlength=rows)
                begin = np.cumsum(sizes) - sizes
                found = []
                for n in lengths:
                    g, first = winnow(hashes, texts, window, gram) if n == window \
                        else A.grams(hashes, texts, n)
                    hit = present(g)
                    g, first = g[hit], first[hit]
                    around = n - gram if n == window else 0
                    doc = texts[first]
                    lo = np.maximum(first - around, begin[doc])
                    hi = np.minimum(first + n, begin[doc] + sizes[doc])
                    found += zip(doc.tolist(), [n] * len(g), A.signed(g).tolist(),
                                 (lo - begin[doc]).tolist(), lo.tolist(), hi.tolist())
                raw, each = data.tobytes() if found else b"", [[] for _ in range(rows)]
                for doc, n, g, start, lo, hi in found:
                    if hi - lo >= n:
                        each[doc].append({"n": n, "print": g, "start": start, "words": [
                            raw[starts[i]:ends[i]].decode() for i in range(lo, hi)]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(key, key + rows), pa.int64()), part.column(0), part.column(2),
                     pa.array(sizes, pa.int64()), pa.array(each, pa.list_(CANDIDATE))],
                    names=["key", "id", "h", "n_words", "found"])
                key += rows

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       A.text_hash(text_col).alias("_h")).mapInArrow(
        run, f"key long, id {id_type.simpleString()}, h long, n_words long, "
             "found array<struct<n:int,print:long,start:int,words:array<string>>>")


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
          gram: int = GRAM, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(a row per document: key, id, h, n_words; the occurrences: key, start, n, item)."""
    items = materialize(item_words(benchmark, item_col, item_text), "items")
    prints = materialize(item_prints(items, window, gram), "prints")
    # at most one value per length up to the window
    lengths = sorted(r[0] for r in prints.select("n").distinct().collect())
    base = materialize(candidates(docs, id_col, text_col, build(prints, "print", bits), lengths,
                                  window, gram), "candidates")
    size = F.least(F.size("words"), F.lit(window))
    item_windows = materialize(items.select("item", F.explode(
        windows_of(F.col("words"), F.lit(0), F.size("words"), size)).alias("w"))
        .select("item", "w.n", "w.window").distinct(), "windows")
    hits = (base.filter(F.size("found") > 0).select("key", F.explode("found").alias("c"))
            .select("key", "c.*").join(prints, ["n", "print"], "left_semi"))
    around = (hits.select("key", F.explode(windows_of(
        F.col("words"), F.col("start"), F.size("words"), F.col("n"))).alias("w"))
        .select("key", "w.*").distinct())
    return base.drop("found"), around.join(item_windows, ["n", "window"]).drop("window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    base, found = spans(docs, benchmark, id_col, **names)
    end = F.col("start") + F.col("n")
    before = W.partitionBy("key").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before),
                                                                           F.lit(0))))
    per = (found.withColumn("new", new).groupBy("key")
           .agg(F.sum("new").alias("hit"), F.sort_array(F.collect_set("item")).alias("items")))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(per, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **names) -> DataFrame:
    """The documents that share no window with an item, with all their columns."""
    base, found = spans(docs, benchmark, id_col, text_col, **names)
    hit = materialize(base.join(found.select("key").distinct(), "key", "left_semi")
                      .select("id", "h").distinct(), "contaminated")
    return A.on_document(A.packed(docs, id_col, text_col), hit, "left_anti") \
        .select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{WORD}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(text, '{UPPER}', '{SMALL}'), '{WORD}') AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(
        w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s
          FROM i WHERE len(w) > 0)),
dw AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s
          FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT k, s, dw.n AS n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS p FROM hit)
    GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
    FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)"""
