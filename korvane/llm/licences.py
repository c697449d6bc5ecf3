"""Licence scans (12): one suffix automaton over all licence templates.

The automaton holds every run of words of every template. A text streams through it once: after
each word the state and the *matching statistic*, the length of the longest run that ends there
and occurs in a template, are known. Where a run stops growing and has at least ``LEAST`` words it
is a match, at every place of the templates where its state says it ends. Matches of one template
that follow each other in text and template, with at most ``GAP`` other words between them, are
chained; the best chain ending at each template place is kept, so a chain step looks at no more
chains than the template has words. A chain that covers ``SHARE`` of its template is a span. The
phrases are templates too: a phrase ends wherever its state, or a state above that of the whole run,
is reached with enough words.

A text is read as bytes in slices; only words that stand in a pair of words of some template are
walked, all others leave a statistic of one or none. Work and memory follow the text; the automaton
follows the templates, which are a parameter.

Edge cases: a null or empty text has no words and a score of 0. Texts of any length are read whole. A
repeated notice gives a span each time, phrases inside each other count each, repeated rows are
judged alike. Templates without words are left out, of one word are refused. An empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays as A
from .licence_texts import PHRASES, TEMPLATES

LEAST = 4            # words of a match
GAP = 8              # other words inside a chain
SHARE = 0.6          # of a template, for a span
MENTION = 0.5        # score of a text that only names a licence
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Automaton:
    """The smallest automaton of all runs of the sequences, built a word at a time.

    ``ends`` lists, for every state of at least ``least`` words, the (sequence, end) places of its
    runs; ``names`` the sequences that are whole and end with it, longest first.
    """

    def __init__(self, sequences: list[list], least: int = LEAST):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list] = [[]]
        whole = []
        for k, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self._add(state, word)
                self.ends[state].append((k, i + 1))
            whole.append(state)
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:                       # a run ends where every longer run around it ends
            if self.link[s] > 0 and self.length[self.link[s]] >= least:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(e) if n >= least else [] for e, n in zip(self.ends, self.length)]
        own: list[list] = [[] for _ in self.link]
        for k, s in enumerate(whole):
            own[s].append((len(sequences[k]), k))
        self.names: list[list] = [[] for _ in self.link]
        for s in reversed(order):
            self.names[s] = sorted(own[s], reverse=True) + self.names[self.link[s]]

    def _state(self, length: int) -> int:
        self.next.append({}), self.link.append(0), self.length.append(length), self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, word, target: int) -> int:
        """The state of the runs of ``target`` that are as short as they come from ``state``."""
        if self.length[state] + 1 == self.length[target]:
            return target
        copy = self._state(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, word) -> int:
        if word in self.next[last]:           # another sequence has this run already
            return self._split(last, word, self.next[last][word])
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def walk(self, words):
        """(state, statistic) after each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


def matches(automaton: Automaton, words: list, first: int, least: int):
    """(sequence, place in it, place in the text, words) of runs that cannot grow; places of their
    first words."""
    last = None
    for i, (state, length) in enumerate([*automaton.walk(words), (0, 0)]):
        if last is not None and length <= last[1] and last[1] >= least:
            for k, end in automaton.ends[last[0]]:
                yield k, end - last[1], first + i - last[1], last[1]
        last = state, length


def chains(found, gap: int) -> list[tuple[int, int, int, int]]:
    """(sequence, first, last word in the text, words covered), none inside another of its sequence.

    ``found`` comes in the order of the text. Words that two matches share count once.
    """
    live: dict[int, dict[int, tuple]] = {}
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for k, place, at, n in found:
        mine = live.setdefault(k, {})
        new = (n, at)
        for end, (covered, first, last) in list(mine.items()):
            if at - last - 1 > gap:
                del mine[end]                 # later matches start later, so none reaches it
                continue
            over = max(0, last + 1 - at, end - place)
            if over < n and at + over - last - 1 <= gap:
                new = max(new, (covered + n - over, first), key=lambda c: c[0])
        if mine.get(place + n, (0,))[0] <= new[0]:
            mine[place + n] = (*new, at + n - 1)
        best[k, new[1]] = max(best.get((k, new[1]), (0, 0)), (new[0], at + n - 1))
    out, reached = [], {}
    for (k, first), (covered, last) in sorted(best.items()):
        if last > reached.get(k, -1):
            reached[k] = last
            out.append((k, first, last, covered))
    return out


@dataclass(frozen=True)
class Scanner:
    """The templates and phrases of a scan, and how long a match, a gap and a share count."""
    templates: tuple = TEMPLATES
    phrases: tuple = PHRASES
    least: int = LEAST
    gap: int = GAP
    share: float = SHARE

    def sequences(self) -> list[tuple[str, list, bool]]:
        """(label, words, is a phrase)."""
        both = [(l, words_of(t), True) for l, t in self.phrases] \
            + [(l, words_of(t), False) for l, t in self.templates]
        return [x for x in both if x[1]]


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
                     T.StructField("last", T.LongType()), T.StructField("covered", T.LongType()),
                     T.StructField("share", T.DoubleType())])
PLACES = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])


def _pairs(sequences: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the sequences, sorted, and the pairs of their numbers that occur."""
    hasher = A.RangeHash()
    words = sorted({w for _, s, _ in sequences for w in s})
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    hashes = hasher(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    table = np.unique(hashes)
    number = dict(zip(words, np.searchsorted(table, hashes).tolist()))
    pairs = {number[a] * len(table) + number[b] for _, s, _ in sequences for a, b in zip(s, s[1:])}
    return table, np.array(sorted(pairs), np.int64)


def stretches(hashes: np.ndarray, texts: np.ndarray, table: np.ndarray, pairs: np.ndarray):
    """(first, last) word of each longest stretch whose neighbours are pairs of a template; outside
    them no run has two words."""
    if len(hashes) < 2 or not len(pairs):
        return []
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    known = table[at] == hashes
    code = at[:-1].astype(np.int64) * len(table) + at[1:]
    place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
    good = known[:-1] & known[1:] & (texts[:-1] == texts[1:]) & (pairs[place] == code)
    edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def scan(docs: DataFrame, scanner: Scanner = Scanner(), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, n_words, phrases, spans): for each phrase its number of places and the first and last
    start; the covered template spans. Places are word numbers from 0."""
    sequences = scanner.sequences()
    if any(len(s) < 2 for _, s, _ in sequences):
        raise ValueError("a template or phrase needs two words")
    automaton = Automaton([s for _, s, _ in sequences], scanner.least)
    least, gap, share = scanner.least, scanner.gap, scanner.share
    table, pairs = _pairs(sequences)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("n_words", T.LongType()),
                           T.StructField("phrases", T.ArrayType(PLACES)),
                           T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches):
        hasher = A.RangeHash()
        for batch in batches:
            for part in A.slices(batch, "_text"):
                data, offsets = A.text_bytes(part.column("_text"))
                data = A.LOWER[data]
                starts, ends = A.ranges(A.ALNUM_SPLIT[data], offsets)
                texts, n = A.owner(starts, offsets), part.num_rows
                n_words = np.bincount(texts, minlength=n)
                begin = np.cumsum(n_words) - n_words
                named: list[dict] = [{} for _ in range(n)]
                runs: list[list] = [[] for _ in range(n)]
                for lo, hi in stretches(hasher(data, starts, ends), texts, table, pairs):
                    doc = int(texts[lo])
                    here = [data[starts[i]:ends[i]].tobytes() for i in range(lo, hi + 1)]
                    first = lo - int(begin[doc])
                    for i, (state, length) in enumerate(automaton.walk(here)):
                        for size, k in automaton.names[state]:
                            if size <= length and sequences[k][2]:
                                at = first + i + 1 - size
                                c = named[doc].setdefault(k, [0, at, at])
                                c[0], c[1], c[2] = c[0] + 1, min(c[1], at), max(c[2], at)
                    runs[doc] += [m for m in matches(automaton, here, first, least)
                                  if not sequences[m[0]][2]]
                spans = [[{"label": sequences[k][0], "first": a, "last": b, "covered": c,
                           "share": c / len(sequences[k][1])}
                          for k, a, b, c in chains(r, gap) if c >= share * len(sequences[k][1])]
                         for r in runs]
                phrases = [[{"label": sequences[k][0], "n": c[0], "first": c[1], "last": c[2]}
                            for k, c in sorted(x.items())] for x in named]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(phrases, PHRASE_TYPE),
                     pa.array(spans, SPAN_TYPE)], names=["id", "n_words", "phrases", "spans"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .mapInArrow(run, schema)


PHRASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64()), ("first", pa.int64()),
                                  ("last", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                                ("covered", pa.int64()), ("share", pa.float64())]))


def report(docs: DataFrame, scanner: Scanner = Scanner(), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: the phrases' places and labels, and the labels with those of the spans.

    ``score`` is the largest covered share of a span, and at least ``MENTION`` where a phrase stands.
    """
    found = scan(docs, scanner, id_col, text_col)
    base, spans = F.col("phrases.label"), F.col("spans.label")
    named = F.array_join(F.array_sort(F.array_distinct(base)), ",")
    n = F.aggregate("phrases", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return found.select(
        F.col("id").alias(id_col), "n_words", n.alias("n_base"),
        F.array_min("phrases.first").alias("first_word"), F.array_max("phrases.last").alias("last_word"),
        named.alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans)), ",").alias("labels"),
        F.greatest(F.when(n > 0, F.lit(MENTION)).otherwise(0.0),
                   F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
        "spans")
