"""Text expressions on columns. Everything here stays in the JVM except ``ascii_slug``.

Java's ``\\w \\s \\b`` are ASCII by default, so every pattern carries ``(?U)``; ``(?d)`` keeps
``.`` from stopping at anything but a line feed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .. import fixed

U = "(?U)"
WORD = U + r"(\w+)"
# what ``\s`` means under (?U)
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A plain expression would be repeated by every use inside a lambda or a CASE branch.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col) -> Column:
    """Trim every kind of white space on both ends."""
    return F.btrim(_c(col), F.lit(SPACES))


def nonblank(col) -> Column:
    """The value, or null when it is empty."""
    return F.nullif(_c(col), F.lit(""))


def head(col, chars: int | None) -> Column:
    """The first ``chars`` characters; the whole value for ``None``."""
    return _c(col) if chars is None else F.substring(_c(col), 1, chars)


def tokens(col) -> Column:
    """White-space tokens without empties."""
    return F.filter(F.split(_c(col), U + r"\s+"), lambda t: t != "")


def words(col) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD), F.lit(1))


# ---- composing texts ----------------------------------------------------------------

def block_text(topic, subtopic, chapter, title, body) -> Column:
    """Non-blank stripped parts, one blank line between them."""
    return F.concat_ws("\n\n", *[nonblank(strip(c))
                                 for c in (topic, subtopic, chapter, title, body)])


def passage_text(topic, subtopic, chapter, title, body) -> Column:
    """Non-empty parts, one per line."""
    return F.concat_ws("\n", *[nonblank(c) for c in (topic, subtopic, chapter, title, body)])


def labelled_block(topic, subtopic, chapter, title, body, note) -> Column:
    """Labelled lines; missing values stay as empty text."""
    val = lambda c: F.coalesce(_c(c), F.lit(""))
    return F.concat(F.lit("Chủ đề: "), val(topic), F.lit("\nĐề mục: "), val(subtopic),
                    F.lit("\nChương: "), val(chapter), F.lit("\nĐiều: "), val(title),
                    F.lit("\n"), val(body), F.lit("\nCăn cứ theo "), val(note))


def join_body(col, sep: str = "\n") -> Column:
    """Array of lines to one text, blank lines dropped."""
    lines = F.transform(_c(col), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), sep)


def capped_body(body: Column, as_json, max_bytes: int, slack: int, step: int = 4000) -> Column:
    """Longest body whose JSON fits, shortened from the tail in steps.

    ``as_json(text)`` renders the metadata with that body. Only rows that are too large pay
    for the search over cut lengths.
    """
    fits = lambda text: F.octet_length(as_json(text)) + slack <= max_bytes

    def cut(text):
        cuts = F.concat(F.sequence(F.length(text), F.lit(0), F.lit(-step)), F.array(F.lit(0)))
        found = F.filter(cuts, lambda n: (n == 0) | fits(F.substring(text, F.lit(1), n)))
        return F.when(fits(text), text).otherwise(F.substring(text, F.lit(1), found[0]))

    return let(body, cut)


def ascii_slug(col) -> Column:
    """ASCII-only slug. NFKD has no built-in, so that one step is an Arrow batch."""
    @F.pandas_udf("string")
    def nfkd(s: pd.Series) -> pd.Series:
        return (s.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore")
                .str.decode("ascii"))

    runs = F.regexp_replace(nfkd(_c(col)), r"[^A-Za-z0-9]+", "_")
    return F.coalesce(nonblank(F.regexp_replace(runs, r"^_+|_+$", "")), F.lit("NA"))


def normalize(col, strip_punct: bool = False) -> Column:
    """Lower case, single spaces; optionally non-word characters become spaces."""
    text = F.lower(strip(F.coalesce(_c(col), F.lit(""))))
    if strip_punct:
        text = F.regexp_replace(text, U + r"[^\w\s]", " ")
    return strip(F.regexp_replace(text, U + r"\s+", " "))


def truncate_marked(col, n: int) -> Column:
    """Cut long texts and mark the cut."""
    def cut(text):
        head = F.regexp_replace(F.substring(text, 1, n - 20), U + r"\s+$", "")
        return F.when(F.length(text) <= n, text).otherwise(
            F.concat(head, F.lit(fixed.TRUNCATED_MARK)))

    return let(strip(F.coalesce(_c(col), F.lit(""))), cut)


_MARKDOWN = [
    (r"\*\*(.*?)\*\*", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"#{1,6}\s", ""),
    (r"\[(.*?)\]\(.*?\)", "$1"),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (r"---+", ""),
    (r"\n+", ". "),
]


def strip_markdown(col, cap: int = 4096) -> Column:
    """Plain text for speech: the marks go, line breaks become stops."""
    text = _c(col)
    for pattern, repl in _MARKDOWN:
        text = F.regexp_replace(text, "(?dU)" + pattern, repl)
    return F.substring(strip(text), 1, cap)


def chunk_pattern(n: int) -> str:
    """Pattern of one piece: a run of line feeds, or a word with its trailing space cut at
    ``n`` characters, or one stray space."""
    cut = [rf"\S{{{n}}}"] + [rf"\S{{{i}}}\s{{0,{n - i}}}" for i in range(n - 1, 0, -1)]
    return r"(\n+|" + "|".join(cut) + r"|\s)"


def chunk_text(col, n: int = 32) -> Column:
    """Array of pieces whose concatenation is the text."""
    return F.regexp_extract_all(_c(col), F.lit(U + chunk_pattern(n)), F.lit(1))


def chunk_fixed(col, n: int = 5) -> Column:
    """Array of pieces of ``n`` characters."""
    return F.regexp_extract_all(_c(col), F.lit(rf"(?s)(.{{1,{n}}})"), F.lit(1))


# ---- overlap ------------------------------------------------------------------------

def word_overlap(query, text) -> Column:
    """Share of the query's distinct words found in the text, 0 for an empty query."""
    q = F.array_distinct(words(query))
    hit = F.array_intersect(q, words(F.coalesce(_c(text), F.lit(""))))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(hit) / F.size(q))


def substring_overlap(query, text) -> Column:
    """Number of distinct query tokens that occur anywhere inside the text."""
    wanted = F.array_distinct(tokens(F.lower(_c(query))))
    return let(F.lower(F.coalesce(_c(text), F.lit(""))), lambda low: F.size(F.filter(
        wanted, lambda t: F.contains(low, t))))


def shared_tokens(query, text) -> Column:
    """Number of distinct white-space tokens two texts share."""
    return F.size(F.array_intersect(F.array_distinct(tokens(F.lower(_c(query)))),
                                    tokens(F.lower(_c(text)))))


# ---- spam signals -------------------------------------------------------------------

LETTERS = f"[{fixed.LETTER_CLASS}]"
EMOJI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in fixed.EMOJI_RANGES) + "]"


def has_long_repeat(col) -> Column:
    return _c(col).rlike(r"(?d)(.)\1{4,}")


def has_link(col) -> Column:
    return _c(col).rlike(r"(?iU)(https?://|www\.)\S+")


def heavy_punct(col) -> Column:
    return _c(col).rlike(r"[!?.,@#$%^&*()_+\-=]{6,}")


def many_emojis(col, n: int = 4) -> Column:
    return F.regexp_count(_c(col), F.lit(EMOJI)) >= n


def low_alpha(col, threshold: float = 0.4) -> Column:
    letters = F.regexp_count(_c(col), F.lit(LETTERS))
    return letters / F.greatest(F.length(_c(col)), F.lit(1)) < threshold


def consonant_run(col) -> Column:
    return _c(col).rlike(r"(?iU)\b[b-df-hj-np-tv-z]{6,}\b")


def low_vowel(col, threshold: float = 0.5) -> Column:
    """Share of words with six or more letters and at most one vowel."""
    toks = F.regexp_extract_all(_c(col), F.lit(f"([{fixed.LETTER_CLASS}]+)"), F.lit(1))
    vowel = F.lit(f"(?iu)[{fixed.VOWELS}]")
    bad = F.filter(toks, lambda t: (F.length(t) >= 6) & (F.regexp_count(t, vowel) <= 1))
    return (F.size(toks) > 0) & (F.size(bad) / F.greatest(F.size(toks), F.lit(1)) >= threshold)


def all_symbols(col) -> Column:
    return ((F.regexp_count(_c(col), F.lit(LETTERS)) <= 1)
            & _c(col).rlike(r"[^\p{L}\p{N}]"))


def term_pattern(terms) -> str:
    """One alternation of word-bounded terms; phrases allow any space run, two-letter terms
    one optional space between the letters."""
    alts = []
    for term in (t.strip() for t in terms):
        if not term:
            continue
        if " " in term:
            alts.append(r"\s+".join(re.escape(p) for p in term.split()))
        elif len(term) == 2 and term.isalpha():
            alts.append(rf"{re.escape(term[0])}\s{{0,1}}{re.escape(term[1])}")
        else:
            alts.append(re.escape(term))
    return r"\b(?:" + "|".join(alts) + r")\b"


def term_match(col, terms) -> Column:
    return F.lower(_c(col)).rlike("(?iU)" + term_pattern(terms))


# ---- small gates --------------------------------------------------------------------

def contains_any(col, keywords) -> Column:
    def any_in(low):
        found = F.lit(False)
        for kw in keywords:
            found = found | F.contains(low, F.lit(kw))
        return found

    return let(F.lower(F.coalesce(_c(col), F.lit(""))), any_in)


def needs_recent(col, keywords=tuple(fixed.RECENT_KEYWORDS)) -> Column:
    return contains_any(col, keywords)


def needs_realtime(col, keywords=tuple(fixed.REALTIME_KEYWORDS)) -> Column:
    return contains_any(col, keywords)


def has_sensitive(col, patterns=tuple(fixed.SENSITIVE_PATTERNS)) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | _c(col).rlike(U + p)
    return found


def is_replacement(col, pattern: str = fixed.REPLACEMENT_PATTERN) -> Column:
    return F.coalesce(_c(col), F.lit("")).rlike("(?iU)" + pattern)


def safe_rewrite(prompt, rewrite) -> Column:
    """The rewrite, or the prompt where the rewrite is blank, an error or too short."""
    def pick(r):
        bad = ((r == "") | r.startswith("Lỗi") | r.startswith("Error")
               | F.contains(r, F.lit("Chưa cấu hình"))
               | (F.length(r) < 6) | (F.size(tokens(r)) < 2))
        return F.when(bad, _c(prompt)).otherwise(r)

    return let(strip(F.coalesce(_c(rewrite), F.lit(""))), pick)


def parse_score(col) -> Column:
    """First number that starts with 0 or 1, clamped to 0..1; 0 when there is none."""
    found = F.regexp_extract(F.coalesce(_c(col), F.lit("")), r"([01](?:\.\d+)?)", 1)
    value = F.coalesce(found.try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def strip_json_fence(col) -> Column:
    text = strip(F.coalesce(_c(col), F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(text, U + r"^```(?:json)?\s*", ""),
                             U + r"\s*```$", "")
    return strip(F.when(text.startswith("```"), inner).otherwise(text))


def roman_ordinal(col) -> Column:
    """Chapter ordinal: ten times the numeral, letters add their place. Null where the
    text has another letter or a numeral right after a letter that is no numeral."""
    roman = F.create_map(*[x for k, v in fixed.ROMAN.items() for x in (F.lit(k), F.lit(v))])
    chars = F.filter(F.split(F.upper(_c(col)), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev"),
                     F.lit(True).alias("first"), F.lit(True).alias("ok"))

    def step(acc, ch):
        value = F.try_element_at(roman, ch)
        place = F.instr(F.lit(fixed.ROMAN_LETTERS), ch)
        gain = (F.when(value.isNull(), place)
                .when(~acc["first"] & (value > acc["prev"]), value - 2 * acc["prev"])
                .otherwise(value))
        fine = F.when(value.isNull(), place > 0).otherwise(acc["first"] | (acc["prev"] > 0))
        return F.struct((acc["sum"] + gain).alias("sum"),
                        F.coalesce(value, F.lit(0)).alias("prev"),
                        F.lit(False).alias("first"), (acc["ok"] & fine).alias("ok"))

    return F.aggregate(chars, start, step, lambda a: F.when(a["ok"], a["sum"]))
