"""Porter stems of English tokens, with the usual extensions for short and irregular words."""

from __future__ import annotations

# Suffixes and what replaces them, in the order in which they are tried.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}


def _consonants(word: str) -> list[bool]:
    """Whether each letter is a consonant; y is one at the start and behind a vowel."""
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and (c != "y" or i == 0 or not out[-1]))
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    kinds = _consonants(stem)
    return sum(1 for a, b in zip(kinds, kinds[1:]) if b and not a)


def _short_end(word: str) -> bool:
    """Ends with consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = _consonants(word)
    if len(word) == 2:
        return not kinds[0] and kinds[1]
    return kinds[-3:] == [True, False, True] and word[-1] not in "wxy"


def _first(word: str, rules) -> str:
    """The first rule whose suffix fits decides; it applies where a vowel-consonant pair is left."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _plural_and_tense(word: str) -> str:
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[:-len(suffix)]
        if word.endswith(suffix) and not all(_consonants(stem)):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _consonants(stem)[-1]:
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _adverb_and_noun(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _adverb_and_noun(word[:-2])
    if word.endswith("logi") and not any(word.endswith(s) for s, _ in STEP_2):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _first(word, STEP_2)


def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _plural_and_tense(word)
    if word.endswith("y") and len(word) > 2 and _consonants(word)[-2]:
        word = word[:-1] + "i"
    word = _first(_adverb_and_noun(word), STEP_3)
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
