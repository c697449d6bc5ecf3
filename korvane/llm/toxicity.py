"""Toxicity (6): Levenshtein automata intersected with a lexicon trie.

The lexicon (words, and stems that take any ending) is learned from the labelled rows by how far a
term leans towards toxic documents. Its trie is walked together with a Levenshtein automaton; the
product is turned into a deterministic automaton as words come, so a word costs a step per letter
and most words leave it after two or three. Every hit is weighed by its context window: quotation
marks, quote prefixes and reporting words on one side, further hits close by on the other. A
logistic model over these sums gives the score; it is fitted on hits that the other half of the
training rows' lexicon found, so that it does not trust terms for having been learned there.

Edge cases: a null or empty text has no hits and scores as such; equal texts get equal scores; ties
between terms go to fewer edits, then to the heavier and then to the alphabetically first term.
Training takes at most ``Settings.train_docs`` labelled documents and ``Settings.terms`` terms
(documented bounds of the fit alone); without both classes the score is the rate of label 1 (0
without labels). Empty tables give no rows. Only id and text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from korvane.session import materialize

from .arrays import slices
from .labelled import held_out, training_rows

WORD = re.compile(r"[^\W\d_]+")
QUOTES = re.compile("[\"“”„«»]")
REPORT = frozenset("said says wrote writes called quote quoted reported schrieb sagte zitat dit "
                   "écrit cité dijo escribió cita".split())
STEM_LENGTHS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    train_docs: int = 20_000
    terms: int = 1_000
    lean: float = 12.0        # least ratio of a term's rates in toxic and other documents
    window: int = 6           # words on each side of a hit
    cached_words: int = 200_000
    states: int = 100_000


def edits(length: int) -> int:
    """Spelling errors allowed in a term of this length."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The lexicon trie times the Levenshtein automaton, made deterministic on demand.

    A state is the set of (trie node, edits spent) a prefix can be in, plus the best stem it has
    passed. Accepted words give (edits, -weight, term).
    """

    def __init__(self, terms: list[tuple[str, bool, float]], settings: Settings):
        self._next: list[dict[str, int]] = [{}]
        self._word: dict[int, list] = {}
        self._stem: dict[int, tuple] = {}
        self._reach = [0]
        self._limits = settings
        for term, stem, weight in sorted(terms):
            node = 0
            allowed = 0 if stem else edits(len(term))
            self._reach[0] = max(self._reach[0], allowed)
            for c in term:
                if c not in self._next[node]:
                    self._next[node][c] = len(self._next)
                    self._next.append({})
                    self._reach.append(0)
                node = self._next[node][c]
                self._reach[node] = max(self._reach[node], allowed)
            if stem:
                self._stem[node] = (0, -weight, term)
            else:
                self._word.setdefault(node, []).append((allowed, weight, term))
        self._reset()

    def _reset(self):
        self._ids, self._sets, self._moves, self._accept, self._cache = {}, [], [], [], {}
        self._start = self._state(self._close({0: 0}), None)

    def _close(self, spent: dict[int, int]) -> dict[int, int]:
        """Adds the nodes reached by letters that the text leaves out."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            for child in self._next[node].values():
                cost = spent[node] + 1
                if cost <= self._reach[child] and cost < spent.get(child, 99):
                    spent[child] = cost
                    todo.append(child)
        return spent

    def _state(self, spent: dict[int, int], stem) -> int:
        for node, cost in spent.items():
            if cost == 0 and node in self._stem:
                stem = min(x for x in (stem, self._stem[node]) if x is not None)
        key = (frozenset(spent.items()), stem)
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append((spent, stem))
            self._moves.append({})
            found = [(cost, -weight, term) for node, cost in spent.items()
                     for allowed, weight, term in self._word.get(node, ()) if cost <= allowed]
            found += [stem] if stem else []
            self._accept.append(min(found) if found else None)
        return self._ids[key]

    def _move(self, state: int, letter: str) -> int:
        spent, stem = self._sets[state]
        after: dict[int, int] = {}

        def put(node, cost):
            if cost <= self._reach[node] and cost < after.get(node, 99):
                after[node] = cost

        for node, cost in spent.items():
            put(node, cost + 1)                                    # a letter too many
            for c, child in self._next[node].items():
                put(child, cost + (c != letter))                   # right or wrong letter
        to = self._state(self._close(after), stem) if after or stem else -1
        self._moves[state][letter] = to
        return to

    def match(self, word: str):
        """The best (edits, -weight, term) for a word, or None."""
        if word in self._cache:
            return self._cache[word]
        if len(self._cache) >= self._limits.cached_words or len(self._sets) > self._limits.states:
            self._reset()
        state = self._start
        for c in word:
            to = self._moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        found = self._accept[state] if state >= 0 else None
        self._cache[word] = found
        return found


N_FEATURES = 8


def features(text: str | None, automaton: Automaton, window: int) -> list[float]:
    """Sums over the hits of a text: exact, misspelled, quoted and crowded ones."""
    if not text:
        return [0.0] * N_FEATURES
    exact = near = quoted = heaviest = crowd = 0.0
    words = WORD.findall(text.lower())
    found = {w: automaton.match(w) for w in set(words)}
    hits = [(i, found[w]) for i, w in enumerate(words) if found[w] is not None] \
        if any(found.values()) else []
    if not hits:
        return [0.0] * N_FEATURES
    text = text.lower()
    starts = [m.start() for m in WORD.finditer(text)]
    for k, (i, (cost, weight, _)) in enumerate(hits):
        weight = -weight
        close = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(hits) and abs(hits[j][0] - i) <= window)
        before = text[text.rfind("\n", 0, starts[i]) + 1:starts[i]]
        around = words[max(0, i - window):i + window + 1]
        if before.lstrip().startswith(">") or len(QUOTES.findall(before)) % 2 \
                or any(w in REPORT for w in around):
            quoted += weight
        elif cost:
            near += weight
        else:
            exact += weight
        heaviest = max(heaviest, weight / (1 + cost))
        crowd += close
    rate = len(hits) / max(1, len(words))
    return [math.log1p(exact), math.log1p(near), math.log1p(quoted), heaviest, math.log1p(crowd),
            math.log1p(100 * rate), float(bool(hits)), float(len(hits) > 1)]


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, p0, c0, p1, c1): toxic and all documents with a term, by half of the rows."""
    words = rows.select("label", "half", "row", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    stems = [F.when(F.length("w") > n, F.struct(F.substring("w", 1, n).alias("term"),
                                                F.lit(True).alias("stem"))) for n in STEM_LENGTHS]
    terms = words.select("label", "half", "row", F.explode(F.array_compact(F.array(
        F.struct(F.col("w").alias("term"), F.lit(False).alias("stem")), *stems))).alias("t"))
    # a document's words are one task's rows, so its repeats fold before they travel
    return terms.select("label", "half", "row", "t.*").distinct().groupBy("term", "stem").agg(*[
        x for h in (0, 1) for x in (F.sum(F.when(F.col("half") == h, F.col("label")).otherwise(0))
                                    .alias(f"p{h}"), F.count_if(F.col("half") == h).alias(f"c{h}"))])


def lexicon(counts: DataFrame, sizes: dict, halves: tuple, settings: Settings) \
        -> list[tuple[str, bool, float]]:
    """Terms that lean towards label 1, with the log of the ratio as weight.

    A term must beat the chance of the best of all candidate terms (likelihood ratio test).
    """
    pos, n = (sum(sizes.get(h, (0, 0))[i] for h in halves) for i in (0, 1))
    if not pos or pos == n:
        return []
    p, c = (sum((F.col(f"{x}{h}") for h in halves[1:]), F.col(f"{x}{halves[0]}")) for x in "pc")
    counts = counts.select("term", "stem", p.alias("p"), c.alias("c")).filter("c > 1")
    candidates = max(2, counts.count())
    lean = (F.col("p") / pos) / ((F.col("c") - F.col("p") + 0.5) / (n - pos))
    p, q, base = F.col("p"), F.col("c") - F.col("p"), pos / n
    gain = 2 * (p * F.log(p / (F.col("c") * base))
                + F.when(q > 0, q * F.log(q / (F.col("c") * (1 - base)))).otherwise(F.lit(0.0)))
    best = (counts.withColumns({"lean": lean, "gain": gain})
            .filter((F.col("lean") >= settings.lean) & (F.col("gain") >= 2 * math.log(candidates)))
            .orderBy(F.desc("gain"), "term", "stem").limit(settings.terms)).collect()
    # a stem that stands for one longer term alone says no more than that term
    same = {(r["term"][:n], r["p"], r["c"]) for r in best for n in STEM_LENGTHS
            if len(r["term"]) > n or (len(r["term"]) == n and not r["stem"])}
    return [(r["term"], r["stem"], math.log(r["lean"])) for r in best
            if not (r["stem"] and (r["term"], r["p"], r["c"]) in same)]


@dataclass
class Model:
    terms: list
    weights: np.ndarray | None
    prior: float
    settings: Settings

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the offset."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(rows: DataFrame, keep: str, types: str, terms: list, settings: Settings) -> DataFrame:
    """Column ``keep`` and the features of column ``text``."""
    def run(batches):
        automaton = Automaton(terms, settings)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [features(t, automaton, settings.window)
                         for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.float64()))], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {types}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    row = F.xxhash64("id", "text")
    rows = materialize(
        training_rows(docs, labels, label, settings.train_docs, id_col, text_col)
        .select(row.alias("row"), row.bitwiseAND(1).cast("int").alias("half"), "text",
                (F.col("label") > 0).cast("int").alias("label")), "toxic-sample")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("half").agg(F.sum("label"), F.count("label"))
             .collect()}
    counts = materialize(term_counts(rows), "toxic-terms")
    x, y = [], []
    for half in (0, 1):
        terms = lexicon(counts, sizes, (half,), settings)
        # bounded by ``train_docs``
        got = _featured(rows.filter(F.col("half") != half), "label", "int", terms, settings).collect()
        x += [r[1] for r in got]
        y += [r[0] for r in got]
    y = np.array(y, float)
    prior = float(y.mean()) if len(y) else 0.0
    terms = lexicon(counts, sizes, (0, 1), settings)
    weights = logistic(np.array(x), y) if 0 < prior < 1 else None
    return Model(terms, weights, prior, settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    def run(batches):
        automaton = Automaton(model.terms, model.settings)
        for batch in batches:
            for part in slices(batch, "_text"):
                x = [features(t, automaton, model.settings.window)
                     for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.score(np.array(x)))], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
