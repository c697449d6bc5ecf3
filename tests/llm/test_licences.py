"""Licence scans (12): the automaton, matches and chains against plain versions, and edge cases."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from korvane.llm import arrays as A, licences as L

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, n_words int, phrases int, spans string, label string, _id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", 3) for i, t in rows], SCHEMA)


def base(text):
    """(n_words, n_base, first, last, labels) by looking at every place."""
    words = ALNUM.findall((text or "").translate(LOWER))
    at = [(i, label) for label, phrase in L.PHRASES for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in at})))


def test_automaton_against_all_runs():
    rng = random.Random(4)
    for _ in range(200):
        letters = "abc"[:rng.randint(1, 3)]
        seqs = [[rng.choice(letters) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 5))]
        automaton = L.Automaton(seqs, 2)
        text = [rng.choice("abcd") for _ in range(40)]
        places = {}
        for k, q in enumerate(seqs):
            for i in range(len(q)):
                for j in range(i + 1, len(q) + 1):
                    places.setdefault(tuple(q[i:j]), []).append((k, j))
        for i, (state, n) in enumerate(automaton.walk(text)):
            assert n == max([m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m:i + 1]) in places])
            if n >= 2:
                assert automaton.ends[state] == sorted(places[tuple(text[i + 1 - n:i + 1])])
            assert sorted(k for m, k in automaton.names[state] if m <= n) == \
                [k for k, q in enumerate(seqs) if len(q) <= i + 1 and q == text[i + 1 - len(q):i + 1]]


def test_matches_are_the_runs_that_cannot_grow():
    rng = random.Random(9)
    for _ in range(100):
        seqs = [[rng.choice("abc") for _ in range(rng.randint(3, 12))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(30)]
        want = set()
        for k, q in enumerate(seqs):
            for i in range(len(text)):
                for j in range(len(q)):
                    n = 0
                    while i + n < len(text) and j + n < len(q) and text[i + n] == q[j + n]:
                        n += 1
                    if n >= 3 and not (i and j and text[i - 1] == q[j - 1]):
                        want.add((k, j, i, n))
        got = list(L.matches(L.Automaton(seqs, 3), text, 0, 3))
        assert [m[2] for m in got] == sorted(m[2] for m in got) and set(got) <= want
        # what the text holds nowhere longer is found at every place of every template
        for k, j, i, n in want:
            around = [m for m in want if m[2] <= i and m[2] + m[3] >= i + n]
            if max(m[3] for m in around) == n:
                assert (k, j, i, n) in got


def test_stretches_hold_every_pair():
    rng = random.Random(2)
    seqs = [("l", [rng.choice("abcde").encode() for _ in range(6)], False) for _ in range(2)]
    pairs = {(a, b) for _, s, _ in seqs for a, b in zip(s, s[1:])}
    table, codes = L._pairs(seqs)
    words = [rng.choice("abcdefg").encode() for _ in range(300)]
    texts = np.arange(300) // 50
    ends = np.arange(1, 301)
    hashes = A.RangeHash()(np.frombuffer(b"".join(words), np.uint8), ends - 1, ends)
    inside = {i for lo, hi in L.stretches(hashes, texts, table, codes) for i in range(lo, hi)}
    assert inside == {i for i in range(299) if (words[i], words[i + 1]) in pairs and texts[i] == texts[i + 1]}


def test_chains():
    def found(template, text, gap=3, least=2):
        return L.chains(L.matches(L.Automaton([template.split()], least), text.split(), 0, least), gap)
    t = "a b c d e f g h"
    assert found(t, "x " + t + " y") == [(0, 1, 8, 8)]
    assert found(t, "a b c x x e f g h") == [(0, 0, 8, 7)]                # words in between
    assert found(t, "a b c x x x x e f g h") == [(0, 0, 2, 3), (0, 7, 10, 4)]
    assert found(t, "e f g h a b c d") == [(0, 0, 3, 4), (0, 4, 7, 4)]    # the wrong way round
    assert found(t, t + " " + t) == [(0, 0, 7, 8), (0, 8, 15, 8)]         # one span each
    assert found(t, "a b c c d e") == [(0, 0, 5, 5)]                      # a shared word counts once


def test_spans_of_cut_and_changed_notices(spark):
    mit = next(t for label, t in L.TEMPLATES if label == "mit")
    words = mit.split()
    cut = " ".join(words[:120])
    changed = " ".join("other" if i % 25 == 24 else w for i, w in enumerate(words)).upper()
    rows = [(1, "Copyright me. " + mit), (2, cut), (3, changed), (4, " ".join(words[:40])),
            (5, " ".join(reversed(words))), (6, mit + " filler words here " * 9 + mit)]
    got = {r.doc_id: r for r in L.report(frame(spark, rows)).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "mit"}
    assert got[1].score == 1 and 0.6 <= got[2].score < 0.8 and 0.9 < got[3].score < 1 and got[4].score == 0
    assert len(got[6].spans) == 2 and got[1].base_labels == "" and got[1].n_base == 0


def test_base_against_every_place(spark):
    rng = random.Random(6)
    pool = [*"gnu general public license apache mit cc by".split(), "x", "the", "License-MIT", "cc-by", "É"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "  ", "CC by\x00GNU General\nPublic\tLicense", "mit license " * 30_000,
              "gnu general public license" + " general public license" * 5, "ümit license", "mit licenseß"]
    rows = [*enumerate(texts), (None, "mit license"), (3, texts[3]), (3, texts[3])]
    got = L.report(frame(spark, rows).repartition(5)).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got),
                  key=key) == sorted(((i, *base(t)) for i, t in rows), key=key)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score >= L.MENTION) == (r.labels != "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_empty_table_and_own_templates(spark):
    assert L.report(frame(spark, [])).count() == 0
    own = L.Scanner(templates=(("t", "one two three four"), ("none", " ")), phrases=(("p", "two three"),))
    rows = L.report(frame(spark, [(1, "one two three four"), (2, "Two, three")]), own).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in rows] == [("p,t", 1.0), ("p", L.MENTION)]
    none = L.Scanner(templates=(), phrases=())
    assert L.report(frame(spark, [(1, "mit license")]), none).select(F.max("n_base")).first()[0] == 0
