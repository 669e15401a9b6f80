"""Column functions on generated replies: repairs, lists, spacing, repetition, spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

# Words that stay small inside names, and roman numbers that stay in capitals.
SMALL_WORDS = (
    "a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "vs", "via", "de", "du", "von", "van", "der",
    "den", "ten", "ter",
)
ROMAN_NUMERALS = (
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX",
    "XXI", "XXII", "XXIII", "XXIV", "XXV",
)


def digit_repaired(text: Column) -> Column:
    """A reply without a figure stuck to its first word; '1n' and '1 want' mean In and I want."""
    t = F.regexp_replace(text, r"^1(?=[nstf]\b)", "I")
    t = F.regexp_replace(t, r"^1(?= (?:want|am|have|would|will|was|think|see)\b)", "I")
    return F.regexp_replace(t, r"^\d{1,2}(?=[A-Z][a-z])", "")


def field_tidied(text: Column) -> Column:
    """Without code fences, an 'Input:' or 'Output:' label and outer quotes."""
    t = F.regexp_replace(F.trim(text), r"^```\w*\s*|\s*```$", "")
    t = F.regexp_replace(t, r"(?i)^(?:input|output)\s*:\s*", "")
    return F.regexp_replace(t, "^\"(.*)\"$", "$1")


def preamble_stripped(text: Column) -> Column:
    """Without a first line that announces the reply, and without a rule below it."""
    t = F.regexp_replace(text, r"(?i)^\s*(?:sure[,!]? )?here(?:'s| is)[^\n:]{0,80}:\s*\n+", "")
    return F.trim(F.regexp_replace(t, r"^\s*-{3,}\s*\n", ""))


def spacing_tidied(text: Column) -> Column:
    """No blanks before punctuation and inside brackets, and contractions closed up."""
    t = F.regexp_replace(text, r" +([,.;:!?)\]])", "$1")
    t = F.regexp_replace(t, r"([(\[]) +", "$1")
    t = F.regexp_replace(t, r"(\w) ?' ?(s|t|re|ve|ll|d|m)\b", "$1'$2")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def first_words(text: Column, n: Column | int) -> Column:
    """The first n words, joined by single blanks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n if isinstance(n, Column) else F.lit(n)), " ")


def outer_quotes_stripped(text: Column) -> Column:
    """Without one pair of matching outer quotes."""
    t = F.trim(text)
    pair = t.rlike("(?s)^\"[^\"]*\"$") | t.rlike("(?s)^“[^“”]*”$") | t.rlike("(?s)^'[^']*'$")
    return F.when(pair, F.regexp_replace(t, "(?s)^.(.*).$", "$1")).otherwise(t)


def title_cased(name: Column) -> Column:
    """Words capitalised but for small ones after the first; initials in capitals, other words with
    a full stop and roman numbers as they are."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        letters = F.regexp_replace(w, "[^A-Za-z]", "")
        return (
            F.when((i > 0) & F.lower(letters).isin(*SMALL_WORDS), low)
            .when(w.rlike(r"^(?:[A-Za-z]\.)+$"), F.upper(w))
            .when(F.contains(w, F.lit(".")) | letters.isin(*ROMAN_NUMERALS), w)
            .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))
        )

    return F.array_join(F.transform(words, one), " ")


def punctuation_issues(text: Column) -> Column:
    """Doubled, spaced or missing-blank punctuation per 100 words; null without words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    n = F.regexp_count(text, F.lit(r" [,.;:!?]|[,;:]{2,}|[,;][A-Za-z]"))
    return F.when(words > 0, n * 100.0 / words)


@F.pandas_udf(ArrayType(StringType()))
def numbered_items(texts: pd.Series) -> pd.Series:
    """The items of a numbered list, with lines that go on an item joined; [] without a list, null for null."""
    mark = re.compile(r"^\s*(?:\d{1,3}[.):]|#\d{1,3}\b)\s*(.*)$")
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        items: list[str] = []
        for line in t.split("\n"):
            m = mark.match(line)
            if m:
                items.append(m.group(1).strip())
            elif items and line.strip():
                items[-1] = f"{items[-1]} {line.strip()}".strip()
        out.append([i for i in items if i])
    return pd.Series(out, dtype=object)


@F.pandas_udf(IntegerType())
def longest_repeat(words: pd.Series) -> pd.Series:
    """Words in the longest run of one block (of 12 words at most) repeated at once; 0 without any."""
    out = []
    for w in words:
        best, w = 0, [] if w is None else list(w)
        for p in range(1, 13):
            run = 0
            for i in range(p, len(w)):
                run = run + 1 if w[i] == w[i - p] else 0
                if run >= p:
                    best = max(best, run + p)
        out.append(best)
    return pd.Series(out, dtype="int32")


@F.pandas_udf(DoubleType())
def span_logprob(tokens: pd.Series, logprobs: pd.Series, answer: pd.Series) -> pd.Series:
    """Mean log probability of the last tokens that make up an answer's length; null without tokens."""
    out = []
    for t, lp, a in zip(tokens, logprobs, answer, strict=True):
        if t is None or lp is None or a is None or not len(t):
            out.append(None)
            continue
        n, span = 0, []
        for x, p in zip(reversed(list(t)), reversed(list(lp)), strict=True):
            span.append(p)
            n += len(x)
            if n >= len(a):
                break
        out.append(sum(span) / len(span))
    return pd.Series(out, dtype="float64")
