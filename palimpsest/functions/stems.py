"""Stems of English words by the published suffix-stripping algorithm (Porter, 1980)."""

from __future__ import annotations

from functools import lru_cache

# Suffixes of the second, third and fourth step, and what they become.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Whether a word ends in consonant, vowel, consonant, the last of which is not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, table) -> str:
    rules = dict(table)
    s = _longest(word, rules)
    if s is None or _measure(word[: -len(s)]) == 0:
        return word
    return word[: -len(s)] + rules[s]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of three letters or fewer are their own."""
    if len(word) <= 3:
        return word
    w = word
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        end = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
        if end and "v" in _shape(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, SECOND), THIRD)
    s = _longest(w, FOURTH)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
