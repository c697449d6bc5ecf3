"""Quality classifier (1): attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from how it is
written (letters, case, marks, repetition), a gated attention learns from document labels alone
which passages tell, and the attention-weighted sum of the encodings is scored.

Edge cases: a null or empty text is one empty passage and is scored like any other; equal texts
get equal scores. Training uses at most ``Settings.train_docs`` labelled documents (a documented
bound of the fit alone); with no labels or one class only, the score is the rate of label 1 (0.5
without any). Empty tables give no rows. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .labelled import held_out, training_rows
from .quality_rules import WINDOW

PASSAGE = 64
CLASSES = ["upper", "lower", "digit", "space", "newline", "sentence", "bang", "bar", "symbol",
           "other", "high"]
CLASS_OF = np.full(256, CLASSES.index("other"), np.int64)
for _name, _bytes in {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B),
                      "digit": range(0x30, 0x3A), "space": [0x20, 9], "newline": [10, 11, 12, 13],
                      "sentence": b".,;:?'\"-", "bang": b"!", "bar": b"|", "symbol": b"#*$%&<>@^~=+",
                      "high": range(0x80, 0x100)}.items():
    CLASS_OF[list(_bytes)] = CLASSES.index(_name)
FEATURES = [*CLASSES, "word_bytes", "distinct", "again", "repeated", "first_upper", "end_mark",
            "words", "passages"]


@dataclass(frozen=True)
class Settings:
    train_docs: int = 6000
    hidden: int = 16
    gate: int = 8
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7


def passages(part: pa.RecordBatch, column: str, hasher: A.RangeHash):
    """Features of all passages, and the first passage of each text; no text is without one."""
    data, offsets = A.text_bytes(part.column(column))
    rows = part.num_rows
    starts, ends = A.ranges(A.SPACE_SPLIT[data], offsets)
    texts = A.owner(starts, offsets)
    hashes = hasher(data, starts, ends)
    n_words = np.bincount(texts, minlength=rows)
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    first_word = np.cumsum(n_words) - n_words
    bag = base[texts] + (np.arange(len(starts)) - first_word[texts]) // PASSAGE
    total = int(count.sum())
    # bytes between two words belong to the passage of the word before them
    edge = np.zeros(len(data) + 1, np.int64)
    if len(starts):
        head = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        owner = np.zeros(len(data), np.int64)
        edge = np.searchsorted(starts[head], np.arange(len(data)), "right") - 1
        owner = np.where(edge >= 0, bag[head][np.maximum(edge, 0)], -1)
    else:
        owner = np.full(len(data), -1)
    text_of = np.repeat(np.arange(rows), np.diff(offsets))
    owner = np.where((owner < base[text_of]) | (owner >= (base + count)[text_of]),
                     base[text_of], owner)
    size = np.maximum(1, np.bincount(owner, minlength=total))
    marks = np.bincount(owner * len(CLASSES) + CLASS_OF[data],
                        minlength=total * len(CLASSES)).reshape(total, -1) / size[:, None]
    words = np.bincount(bag, minlength=total)
    some = np.maximum(1, words)
    order = np.lexsort((hashes, bag))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])

    def share(flag):
        return np.bincount(bag[flag], minlength=total) / some

    doc_of = np.repeat(np.arange(rows), count)
    features = np.column_stack([
        marks, np.bincount(bag, ends - starts, total) / some / 10,
        share(order[new]), share(same), share(_covered(hashes, texts)),
        share((CLASS_OF[data[starts]] == 0)), share(~np.isin(CLASS_OF[data[ends - 1]], (0, 1, 2, 10))),
        np.log1p(words), np.log1p(count[doc_of])])
    return features.astype(np.float32), base


def _covered(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Words in a window of five that the text has more than once."""
    covered = np.zeros(len(hashes), bool)
    g, first = A.grams(hashes, texts, WINDOW)
    if len(g):
        key = g ^ A.mix(texts[first].astype(np.uint64) + np.uint64(1))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        for i in range(WINDOW):
            covered[first[n[back] > 1] + i] = True
    return covered


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """Encoder, gated attention and scorer over bags of passages."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.w, self.prior = mean, scale, weights, prior

    def forward(self, x, first):
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * u) @ w["a"]
        sizes = np.diff(np.append(first, len(x)))
        s = s - np.repeat(np.maximum.reduceat(s, first), sizes)
        e = np.exp(s)
        att = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(att[:, None] * h, first)
        return h, t, u, att, z, z @ w["c"] + w["d"][0], sizes

    def score(self, features, first):
        if self.w is None:
            return np.full(len(first), self.prior)
        return _sigmoid(self.forward((features - self.mean) / self.scale, first)[5])

    @classmethod
    def fit(cls, features, first, labels, settings: Settings):
        prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels) or prior in (0.0, 1.0):
            return cls(None, None, None, prior)
        rng, d = np.random.default_rng(settings.seed), features.shape[1]
        shapes = {"W": (d, settings.hidden), "V": (settings.hidden, settings.gate),
                  "U": (settings.hidden, settings.gate), "a": (settings.gate,),
                  "c": (settings.hidden,)}
        w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        w |= {"b": np.zeros(settings.hidden), "d": np.array([np.log(prior / (1 - prior))])}
        model = cls(features.mean(0), features.std(0) + 1e-3, w, prior)
        x = (features - model.mean) / model.scale
        m = {k: np.zeros_like(v) for k, v in w.items()}
        v = {k: np.zeros_like(v) for k, v in w.items()}
        for step in range(1, settings.steps + 1):
            h, t, u, att, z, logit, sizes = model.forward(x, first)
            g = (_sigmoid(logit) - labels) / len(labels)
            dz = np.repeat(g[:, None] * w["c"], sizes, 0)
            da = (dz * h).sum(1)
            ds = att * (da - np.repeat(np.add.reduceat(att * da, first), sizes))
            dt = ds[:, None] * w["a"] * u * (1 - t * t)
            du = ds[:, None] * w["a"] * t * u * (1 - u)
            dh = (att[:, None] * dz + dt @ w["V"].T + du @ w["U"].T) * (1 - h * h)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ du,
                     "a": (t * u).T @ ds, "c": z.T @ g, "d": np.array([g.sum()])}
            for k in w:
                grad = grads[k] + (settings.decay * w[k] if k not in "bd" else 0)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - settings.rate * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"):
    """Passages are encoded in the tasks; the driver fits on the bounded sample."""
    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "text"):
                x, first = passages(part, "text", hasher)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2),
                     pa.array([b.tobytes() for b in np.split(x, first[1:])], pa.binary())],
                    names=["id", "label", "bag"])

    sample = training_rows(docs, labels, label, settings.train_docs, id_col, text_col)
    sample = sample.select(F.col("id").cast("string").alias("id"), "text", "label")
    rows = sample.mapInArrow(run, "id string, label int, bag binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[2])))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, len(FEATURES)) for r in rows]
    first = np.cumsum([0, *map(len, bags)])[:-1].astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, len(FEATURES)))
    return GatedAttention.fit(x.astype(np.float64), first,
                              np.array([r[1] > 0 for r in rows], float), settings)


def score(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.score(*passages(part, "_text", hasher)))],
                    names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
