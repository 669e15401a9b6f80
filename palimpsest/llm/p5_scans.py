"""Problem 5: repairing text from scanned pages into continuous paragraphs.

Every line is observed by its layout (blank, page mark, number, capitals, text), by whether
the text before it stops and how the text after it begins, by whether a number goes on a
count of stanzas, by how the line ends (a stop, a broken word), by its length and by its rate
of misread words. A hidden Markov model labels every line of every text:

- body: prose, which goes on with the body line after it,
- verse: a line that stands by itself (verse, dialogue, headings),
- header: a running head or page number amid the text, which is dropped,
- break: blank lines between paragraphs,
- gap: blank lines within a sentence, around a header or between wrapped lines.

The model starts from the tables below and is trained by Viterbi training on the lines of
about TRAIN_TEXTS texts, chosen by a hash of their id; the tables weigh as PRIOR lines. The
labels decide what is joined: broken words and wrapped lines of body and verse, across
dropped headers and gaps too. Misread letters in such lines are put right where that makes a
known word, or where a sign stands between letters.

Only texts with evidence in the labelled lines (a broken word, a misread letter inside a word,
a header amid the text) are changed; others come back as they are. Null and blank texts have
no evidence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from . import p2_quality as quality
from .hmm import LineHmm
from .words import WordSet, small_batches

STATES = ("body", "verse", "header", "break", "gap")
BODY, VERSE, HEADER, BREAK, GAP = range(5)
TRAIN_TEXTS, PRIOR = 2000, 20_000.0
# Tables of the untrained model: probability of each value of each statistic, by state.
START = {
    # layout: blank, text, page mark, number alone, capitals, other
    "layout": (
        (0.003, 0.955, 0.002, 0.010, 0.025, 0.005), (0.003, 0.900, 0.002, 0.030, 0.060, 0.005), (0.003, 0.030, 0.650, 0.060, 0.250, 0.007),
        (0.985, 0.003, 0.003, 0.003, 0.003, 0.003), (0.985, 0.003, 0.003, 0.003, 0.003, 0.003),
    ),
    # text before: none, stops, does not stop
    "before": ((0.10, 0.35, 0.55), (0.10, 0.50, 0.40), (0.02, 0.28, 0.70), (0.10, 0.75, 0.15), (0.01, 0.04, 0.95)),
    # text after: none, begins small, begins otherwise
    "after": ((0.12, 0.55, 0.33), (0.12, 0.08, 0.80), (0.02, 0.60, 0.38), (0.10, 0.08, 0.82), (0.01, 0.94, 0.05)),
    # a number that goes on a count: no, yes
    "count": ((0.95, 0.05), (0.85, 0.15), (0.995, 0.005), (0.99, 0.01), (0.99, 0.01)),
    # the line's own end: no text, a stop, a broken word, otherwise
    "end": ((0.04, 0.22, 0.12, 0.62), (0.09, 0.50, 0.01, 0.40), (0.90, 0.05, 0.01, 0.04), (0.97, 0.01, 0.01, 0.01), (0.97, 0.01, 0.01, 0.01)),
    # length: under 25 characters, 50, 90, longer
    "length": ((0.06, 0.24, 0.50, 0.20), (0.18, 0.50, 0.27, 0.05), (0.55, 0.35, 0.09, 0.01), (0.97, 0.01, 0.01, 0.01), (0.97, 0.01, 0.01, 0.01)),
    # misread words: none, one, more
    "misread": ((0.90, 0.07, 0.03), (0.94, 0.04, 0.02), (0.96, 0.03, 0.01), (0.98, 0.01, 0.01), (0.98, 0.01, 0.01)),
}
MOVE = (
    (0.75, 0.02, 0.05, 0.16, 0.02), (0.03, 0.72, 0.03, 0.21, 0.01), (0.42, 0.04, 0.10, 0.22, 0.22),
    (0.52, 0.28, 0.05, 0.13, 0.02), (0.62, 0.04, 0.20, 0.01, 0.13),
)

# Hyphens that break words at line ends.
HYPHENS = "-¬‐­="
_MARK = re.compile(
    r"^\s*(?:[\[({*—–-]+\s*(?:[Pp](?:age|g)?\.?\s*)?[\dOolIivxcSZB]{1,6}\s*[\])}*—–-]+|\d[\dOolI]{0,3}\*+)\s*$|"
    r"^\s*\x0c|^\s*(?:\[Pg\.? ?\w+\]|[Pp]\. ?[\dOolI]{1,4} [^a-z]+$)"
)
_NUMBER_LAST = re.compile(r"\s\s[\dOolIivxcSZ]{1,8}\s*$")
_NUMBER_FIRST = re.compile(r"^\s*[\dOolI]{1,4}\s{2,}")
_SMALL_LETTER, _THREE_CAPITALS = re.compile("[a-z]"), re.compile("[A-ZÀ-Þ0]{3}")
_NUMBER = re.compile(r"^\s*(?:(\d{1,4})|([IVXLC]{1,7}))\.?\s*$")
_STOPS = frozenset(".!?:;…")
# Signs and figures read for letters.
SIGNS = {
    "^": "a", "«": "e", "»": "e", "°": "o", "¡": "i", "†": "t", "¢": "c", "|": "l", "!": "l", "€": "e", "£": "f",
    "§": "s", "ß": "b", "@": "a", "$": "s", "•": "o", "ſ": "s", "ﬅ": "st", "ﬆ": "st", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff",
    "ﬃ": "ffi", "ﬄ": "ffl", "0": "o", "1": "l", "9": "g", "6": "b", "5": "s", "8": "b", "3": "e", "4": "a",
}
_SIGN_CLASS = "".join(re.escape(c) for c in SIGNS if not c.isdigit() and c not in "ß|!$@£€•")
#: A sign between letters that no word has there; the looks behind keep the search at signs.
_INSIDE = re.compile(rf"[{_SIGN_CLASS}0](?<=[^\W\d_ſ].)(?=[^\W\d_])|[16983|!•](?<=[a-z].)(?=[a-z])")
_LIGATURES = re.compile("[ſﬅﬆ]")
#: Whether a letter and a sign or figure meet at all, and the tokens where they do.
_MEET = re.compile(rf"[{_SIGN_CLASS}|\d](?:(?<=[a-zA-Z].)|(?=[a-zA-Z]))")
_MIXED = re.compile(rf"(?<![\w&])[\w{_SIGN_CLASS}|]+(?!\w)")
_SMALL = re.compile("[a-zà-ÿ]{4}")
# Letter groups read for others, as read and as meant.
CONFUSED = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("lc", "k"), ("tl", "d"))
_WORD = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile("|".join(a for a, _ in CONFUSED))
_JUNK = re.compile(r"(?:(?<=\s)|^)[|¬■_\\~•^·]{1,2}(?:(?=\s)|$) ?")
_SPACED = re.compile(r"(?<=\w) +(?=[,;.:!?](?:\s|$))")


def page_mark(line: str) -> bool:
    """Whether a line is a page number in marks, or a head in capitals with a page number."""
    if _MARK.match(line):
        return True
    if m := _NUMBER_LAST.search(line):
        head = line[: m.start()].rstrip()
        if head and not _SMALL_LETTER.search(head[:-1]) and _THREE_CAPITALS.search(head):
            return True
    if m := _NUMBER_FIRST.match(line):
        rest = line[m.end() :]
        return not _SMALL_LETTER.search(rest) and _THREE_CAPITALS.search(rest) is not None
    return False


def broken_end(line: str) -> str | None:
    """The letters before a hyphen at a line's end; None without such."""
    line = line.rstrip()
    if not line or line[-1] not in HYPHENS:
        return None
    k = len(line) - 1
    while k and line[k - 1].isalpha():
        k -= 1
    return line[k:-1] or None


_WORD_FIRST = re.compile(r"\s*([^\W\d_]+)")


class Scans:
    """Observation, evidence and repair; holds the vocabulary, its words' beginnings and the memory of words."""

    def __init__(self, known: WordSet | frozenset[str], beginnings: WordSet | frozenset[str]):
        self.known, self.beginnings = known, beginnings
        self.memo: dict[tuple[str, bool], str | None] = {}
        self.tokens: dict[str, int] = {}

    # -- words

    def _reading(self, low: str, signs: bool) -> str | None:
        """The known word that a token stands for, by signs read for letters and at most two
        confused groups of letters: the one with the fewest groups, then the first.

        The search follows only beginnings of known words, so it needs no bound on alternatives.
        """
        best: tuple[int, str] | None = None
        todo = [(0, "", 0)]
        while todo:
            at, made, groups = todo.pop()
            if at == len(low):
                if len(made) > 2 and made != low and made in self.known and (best is None or (groups, made) < best):
                    best = (groups, made)
                continue
            c = low[at]
            steps = [(at + 1, made + c, groups)]
            if signs and c in SIGNS and c != "ß":
                steps = [(at + 1, made + a, groups) for a in (("l", "i") if c in "1|" else (SIGNS[c],))]
            if groups < 2:
                steps += [(at + len(a), made + b, groups + 1) for a, b in CONFUSED if low.startswith(a, at)]
            todo += [x for x in steps if x[1] in self.beginnings]
        return best[1] if best else None

    def _remembered(self, low: str, signs: bool) -> str | None:
        key = (low, signs)
        if key not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = self._reading(low, signs)
        return self.memo[key]

    def meant(self, word: str) -> str | None:
        """What a word without signs was misread from; None where it may be right."""
        low = word.lower()
        if len(low) < 3 or not _SUSPECT.search(low) or low in self.known:
            return None
        return self._remembered(low, False)

    def unsigned(self, token: str) -> str | None:
        """A token with signs or figures among its letters put right, if that makes a known word."""
        low = token.lower()
        return self._remembered(low, True) if sum(c.isalpha() for c in low) >= 2 or len(low) == 2 else None

    def misread(self, line: str) -> int:
        """Number of misread words and signs inside words of a line; a token counts once."""
        memo, n = self.tokens, 0
        for t in line.split():
            r = memo.get(t)
            if r is None:
                if len(memo) > 500_000:
                    memo.clear()
                r = len(_INSIDE.findall(t)) + len(_LIGATURES.findall(t))
                if not r and _MEET.search(t):
                    r = sum(self.unsigned(x) is not None for x in _MIXED.findall(t) if _MEET.search(x))
                if not r and _SUSPECT.search(t.lower()):
                    r = sum(self.meant(w) is not None for w in _WORD.findall(t))
                memo[t] = r
            n += r
        return n

    def joins(self, left: str | None, line: str) -> str | None:
        """What comes of a word broken before a line: '' for joined, '-' for a compound, None for no broken word."""
        m = _WORD_FIRST.match(line) if left else None
        if not m:
            return None
        a, b = left.lower(), m[1].lower()
        if f"{a}-{b}" in self.known and a + b not in self.known:
            return "-"
        return "" if m[1][0].islower() or left.isupper() else None

    # -- lines

    def observe(self, lines: list[str]) -> tuple[np.ndarray, list[int]]:
        """(observations (lines, 7), misread words of each line)."""
        n = len(lines)
        o = np.zeros((n, len(START)), np.int8)
        kinds, wrong = [], []
        expected = {"d": 1, "r": 1}
        for i, line in enumerate(lines):
            if not line.strip():
                k = 0 if "\x0c" not in line else 2
            elif page_mark(line):
                k = 2
            elif _SMALL.search(line):
                k = 1
            elif m := _NUMBER.match(line):
                k = 3
                kind, v = ("d", int(m.group(1))) if m.group(1) else ("r", _roman(m.group(2)))
                if v == 1 or v == expected[kind]:
                    o[i, 3], expected[kind] = 1, v + 1
            elif len(line) < 90 and not _SMALL_LETTER.search(line) and _THREE_CAPITALS.search(line):
                k = 4  # a full line in capitals is text
            elif any(c.isalpha() for c in line):
                k = 1
            else:
                k = 5
            kinds.append(k)
            wrong.append(self.misread(line) if k in (1, 4) else 0)
            if k == 1:
                o[i, 5] = (len(line) >= 25) + (len(line) >= 50) + (len(line) >= 90)
        o[:, 0] = kinds
        o[:, 6] = np.minimum(wrong, 2)
        stop, left = 0, None
        for i, line in enumerate(lines):
            o[i, 1] = stop
            if kinds[i] == 1:
                stop = 1 if line.rstrip(" \t\r\"'”’»“)]_")[-1:] in _STOPS else 2
                o[i, 4] = 1 if stop == 1 else 3
        begin, below = 0, ""
        for i in range(n - 1, -1, -1):
            o[i, 2] = begin
            if kinds[i] == 1:
                if self.joins(broken_end(lines[i]), below) is not None:
                    o[i, 4] = 2
                c = lines[i].lstrip()[:1]
                begin, below = (1 if c.islower() or c in ",;." else 2), lines[i]
        return o, wrong

    def evidence(self, obs: np.ndarray, labels: np.ndarray, wrong: list[int], lines: list[str]) -> tuple[int, int, int]:
        """(broken words, misread words, headers amid the text) by the labels of the lines."""
        said = (labels == BODY) | (labels == VERSE)
        text_at = np.flatnonzero(said & np.isin(obs[:, 0], (1, 4)))
        if not len(text_at):
            return 0, 0, 0
        broken, left = 0, None
        for i in text_at.tolist():
            broken += self.joins(left, lines[i]) == ""
            left = broken_end(lines[i])
        misread = int(np.asarray(wrong)[said].sum())
        # a page mark is proof; numbers and capitals alone are it where they interrupt a sentence
        proof = (obs[:, 0] == 2) | ((obs[:, 0] > 2) & (obs[:, 1] == 2) & (obs[:, 2] == 1))
        at = np.flatnonzero((labels == HEADER) & proof)
        return broken, misread, int(((at > text_at[0]) & (at < text_at[-1])).sum())

    def repair(self, lines: list[str], labels: np.ndarray) -> str:
        """Paragraphs of the text lines, joined as their labels say."""
        paged = any(s == HEADER and page_mark(l) for l, s in zip(lines, labels, strict=True))
        paragraphs: list[str] = []
        now, left, last = "", None, BREAK
        for line, s in zip(lines, labels.tolist(), strict=True):
            line = line.strip()
            if s in (GAP, HEADER) and (paged or not line):
                continue
            if not line:
                paragraphs.append(now)
                now, left, last = "", None, BREAK
                continue
            how = self.joins(left, line)
            if how is None or not now:
                now += (" " if last == BODY and s == BODY else "\n") * bool(now) + line
            else:
                now = now[:-1] + how + line
            left, last = broken_end(line), s
        text = "\n\n".join(p for p in [*paragraphs, now] if p)
        text = _SPACED.sub("", text)
        text = _JUNK.sub("", text)
        text = _MIXED.sub(lambda m: _cased(m[0], self.unsigned(m[0])) if _MEET.search(m[0]) else m[0], text)
        text = _INSIDE.sub(lambda m: SIGNS.get(m[0], m[0]), text)
        text = _LIGATURES.sub(lambda m: SIGNS[m[0]], text)
        return _WORD.sub(lambda m: _cased(m[0], self.meant(m[0])), text)


def _cased(word: str, meant: str | None) -> str:
    if meant is None:
        return word
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    return meant.capitalize() if word[:1].isupper() else meant


def _roman(s: str) -> int:
    v = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    n = [v[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def start_model() -> LineHmm:
    """The untrained model."""
    return LineHmm([np.array(v) for v in START.values()], np.array(MOVE))


def beginnings(vocab: DataFrame, least: int = quality.KNOWN_CNT) -> WordSet:
    """All beginnings of the vocabulary's words; more than the bound of words are an error."""
    v = vocab.filter((F.col("cnt") >= least) & (F.col("word") != "__total__") & (F.col("word") != ""))
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.xxhash64(F.substring("word", F.lit(1), n))))
    h = v.select(parts.alias("h")).distinct().limit(quality.MAX_VOCAB + 1).toArrow().column(0).to_numpy()
    if len(h) > quality.MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {quality.MAX_VOCAB} beginnings of words is not broadcast")
    return WordSet(h)


def line_breaks_unified(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def fit(sample: DataFrame, known, begun) -> LineHmm:
    """The model, trained on the lines of the texts of a sample (t)."""

    def run(batches):
        scans = Scans(known.value, begun.value)
        for b in batches:
            obs = [scans.observe(line_breaks_unified(t))[0] for t in b.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_arrays([pa.array([o.tobytes() for o in obs], pa.binary())], ["o"])

    rows = sorted(bytes(r.o) for r in sample.filter("t is not null").mapInArrow(run, "o binary").collect())
    return start_model().trained([np.frombuffer(s, np.int8).reshape(-1, len(START)) for s in rows], PRIOR)


SCHEMA = "k long, broken int, misread int, headers int, natural boolean, repaired string"


def repair_scans(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(key, broken, misread, headers, natural, repaired): the texts with evidence only.

    natural is the verdict of problem 2 on the text as it is; evidence in texts that are
    not natural counts for nothing in `p5_found`.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(quality.known_words(vocab))
    begun = spark.sparkContext.broadcast(beginnings(vocab))
    sample = quality.sample_of(docs, key, text, TRAIN_TEXTS)
    lines_model = spark.sparkContext.broadcast(fit(sample, known, begun))
    quality_model = spark.sparkContext.broadcast(quality.fit(sample, known))

    def run(batches):
        scans, judge = Scans(known.value, begun.value), quality.Lines(known.value)
        model, q = lines_model.value, quality_model.value
        for whole in batches:
            for b in small_batches(whole, 1):
                keys, texts = b.column(0), b.column(1).to_pylist()
                lines = [line_breaks_unified(t) for t in texts]
                seen = [scans.observe(x) for x in lines]
                labels = model.label_all([o for o, _ in seen])
                found = [scans.evidence(o, s, w, x) for (o, w), s, x in zip(seen, labels, lines, strict=True)]
                at = [i for i, f in enumerate(found) if any(f)]
                obs, sizes, _ = judge.observe(["\n".join(lines[i]) for i in at])
                odd = quality.odd_shares(q, obs, sizes)
                rows = [
                    (keys[i].as_py(), *found[i], len(texts[i]) < quality.MIN_CHARS or bool(by[1:].sum() <= 0.5), scans.repair(lines[i], labels[i]))
                    for i, by in zip(at, odd, strict=True)
                ]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    ["k", "broken", "misread", "headers", "natural", "repaired"],
                )

    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null")
    return src.mapInArrow(run, SCHEMA).withColumnRenamed("k", key)


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, broken, misread, headers, repaired of every natural text with traces of scanning."""
    docs = spread(table(spark, folder, "docvalue").select("rec_id", "text"))
    return repair_scans(docs, "rec_id", table(spark, folder, "vocab")).filter("natural").drop("natural")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id of the natural texts with traces of scanning."""
    return p5_repaired(spark, folder).select("rec_id")


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
ORACLE: dict[str, str] = {}
