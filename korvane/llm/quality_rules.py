"""Quality rules (4): compression bands.

A text that zstandard shrinks too well repeats itself, one that it hardly shrinks is noise. The
whole text and each of its fixed-size chunks must stay inside the band for their length; the
chunks find a repetitive or random stretch that the whole text's ratio hides.

Edge cases: a null or empty text has no words, fails the base rule and has no ratios (null). Ties
do not occur: every row is judged alone, so repeated rows get equal results. An empty table gives
an empty result. Other columns, whatever their names, are never read; ``keep_good`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays as A

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """``bands``: (below this many bytes, least ratio, largest ratio); the last one is open.

    The limits are the extremes of the texts and chunks of documents labelled clean, outside the
    held-out third, that pass the base rule (sf0.1), widened by 5 %. A last chunk may be one byte,
    so the shortest have no least ratio; the longest, 13 texts, take the least ratio before them.
    """
    bands: tuple = ((128, 0.0, 1.36), (256, 1.02, 1.63), (512, 1.29, 1.8), (1024, 1.44, 2.08),
                    (4096, 1.63, 2.33), (16384, 1.97, 2.53), (float("inf"), 1.97, 2.56))
    chunk_bytes: int = 4096
    level: int = 3

    def inside(self, size: int, ratio: float) -> bool:
        low, high = next((low, high) for below, low, high in self.bands if size < below)
        return low <= ratio <= high


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("chunk_low", T.DoubleType()), T.StructField("chunk_high", T.DoubleType())])


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(hashes: np.ndarray, texts: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, the words covered by a window of five words that the text has more than once."""
    windows, first = A.grams(hashes, texts, WINDOW)
    if not len(first):
        return np.zeros(n_texts, np.int64)
    key = windows ^ A.mix(texts[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, where = key[order], first[order]
    same = (key[1:] == key[:-1]) & (texts[where[1:]] == texts[where[:-1]])
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(hashes), bool)
    for i in range(WINDOW):
        covered[where[again] + i] = True
    return np.bincount(texts[covered], minlength=n_texts)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def judge(part: pa.RecordBatch, column: str, rules: Bands, hasher: A.RangeHash) -> dict:
    data, offsets = A.text_bytes(part.column(column))
    words = A.SPACE_SPLIT[data]
    starts, ends = A.ranges(words, offsets)
    texts, n = A.owner(starts, offsets), part.num_rows
    n_words = np.bincount(texts, minlength=n)
    repeat = repeated_words(hasher(data, starts, ends), texts, n)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    raw, pack = data.tobytes(), zstandard.ZstdCompressor(level=rules.level).compress
    ratio, low, high, kept, lines = [], [], [], [], []
    for i in range(n):
        text = raw[offsets[i]:offsets[i + 1]]
        lines.append(duplicate_lines(text))
        if not text:
            ratio.append(None), low.append(None), high.append(None), kept.append(False)
            continue
        whole = len(text) / len(pack(text))
        chunks = [text[k:k + rules.chunk_bytes] for k in range(0, len(text), rules.chunk_bytes)]
        each = [whole] if len(chunks) == 1 else [len(c) / len(pack(c)) for c in chunks]
        ratio.append(whole), low.append(min(each)), high.append(max(each))
        kept.append(bool(not failed[i] and rules.inside(len(text), whole) and
                         all(rules.inside(len(c), r) for c, r in zip(chunks, each))))
    return {"n_words": n_words, "word_chars": _per_text(words & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": _per_text(SYMBOLS[data], offsets), "n_dup_lines": lines,
            "n_repeat_words": repeat, "base_failed": failed, "kept": kept, "ratio": ratio,
            "chunk_low": low, "chunk_high": high}


def score_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Bands = Bands()) -> DataFrame:
    """One row per document: its id, the base counts, the ratios and ``kept``."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *FIELDS.fields])
    types = {f.name: f.dataType for f in FIELDS.fields}
    arrow = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}

    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "_text"):
                found = judge(part, "_text", rules, hasher)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(found[k], arrow[type(types[k])]) for k in types)],
                    names=[id_col, *types])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    names = docs.columns

    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, text_col):
                kept = judge(part, text_col, rules, hasher)["kept"]
                yield part.filter(pa.array(kept, pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
