"""Problem 2: statistics of each text's quality, and which texts are not natural.

Lines (long ones in segments of about SEGMENT characters) are observed by a few discrete
statistics: layout pattern, share of natural words, of unpronounceable words, of symbols
and of digits, repetition, length. A hidden Markov model with the states prose, list, table
and junk labels them by Viterbi's algorithm; a text is not natural if more than half of its
characters lie in lines that are not prose.

The model starts from the tables below and is trained by Viterbi training on the lines of
at most TRAIN_TEXTS texts, chosen by a hash of their id; the tables weigh as PRIOR lines.
The vocabulary and the trained tables are broadcast: of the vocabulary 8 bytes a word. More
than MAX_VOCAB words are refused with an error, never cut.

Null, empty and blank texts have statistics of 0 and are natural; so are texts under
MIN_CHARS characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..tables import spread, table
from .hmm import LineHmm
from .p6_pairs import FUNCTION_WORDS
from .words import WordSet, small_batches

STATES = ("prose", "list", "table", "junk")
MIN_CHARS, SEGMENT, TRAIN_TEXTS, PRIOR, MAX_VOCAB = 100, 240, 2000, 4000.0, 20_000_000
#: A word of the vocabulary is known from this count on.
KNOWN_CNT = 3
_ALL_WORDS = re.compile(r"[^\W_]+")
_FUNCTION = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
_ODD_WORD = re.compile(
    r"[bcdfghjklmnpqrstvwxz]{5}|(?:[aeiouyàâäéèêëîïôöùûüæœ]){5}|(.)\1\1|q[^u]|^[bcdfghjklmnpqrstvwxzßñ]{3,}$|"
    r"[jqvx][bcdfghjklmnpqrstvwxz]|[bcdfgjkmpqtvwz]x|[^\W\d_]*[jqvwxz]$(?<!z)(?<!x)(?<!w)|^(?:[bdfgjkmpqrtvwxz]{2}(?<![bdfgkptw]r)(?<!dw)(?<!kw)(?<!tw))"
)
_PATTERNS = (
    # (value, pattern) in order; the first that fits names the layout
    (7, re.compile(r"^[\W\d_]*\d[\W\d_]*$")),
    (3, re.compile(r"^\|.*\||^[\s|:+=-]{5,}$|^[^;\s][^;]*(?:;(?! )[^;]*){3,}$|^[^,\s][^,]*(?:,(?! )[^,]*){3,}$|\t[^\t]+\t|^[^:\s]+(?:/[^/\s]+){3,}$")),
    (4, re.compile(r"\.{4,}|(?:\. ){4,}|·{4,}|_{4,}|\S {3,}\S.* {3,}\S")),
    (6, re.compile(r"^\W*\d+\W+\w.*(?:\bvols?\b|\b(?:8vo|4to|12mo|fol)\b|\d+[sd]\.)")),
    (5, re.compile(r"^[^.!?]{3,90}?,(?: ?\d{1,4}(?:[-–]\d+)?[,;.]?)+\s*$")),
    (2, re.compile(r"^\W*[\d½¼¾]+\S* (?:lb|lbs|oz|drachms?|gills?|pints?|quarts?|ounces?|pounds?|cups?|spoonfuls?|dozen|gallons?|grains?|yards?|bushels?|pecks?|scruples?|handfuls?)\b\.? [^.,;:!?]*$")),
    (1, re.compile(r"^\s*(?:[-–—•*·+○●■]|\(?[a-z\d]{1,3}[.)]) \S[^.!?]{0,60}$|^\s*(?:[-–•*·+○●]|\(?\d{1,3}[.)]) ")),
    (8, re.compile(r"^\d")),
)
# Tables of the untrained model: probability of each value of each statistic, by state.
START = {
    # layout: none, bullet, quantity, fields, columns, index, catalogue, figures, begins with a digit
    "layout": (
        (0.930, 0.010, 0.004, 0.003, 0.004, 0.004, 0.002, 0.028, 0.015),
        (0.120, 0.250, 0.250, 0.010, 0.010, 0.180, 0.150, 0.010, 0.020),
        (0.060, 0.010, 0.010, 0.420, 0.420, 0.010, 0.020, 0.040, 0.010),
        (0.710, 0.010, 0.005, 0.060, 0.010, 0.020, 0.005, 0.150, 0.030),
    ),
    # natural words: no words, under 20 %, 50 %, 80 %, above
    "natural": (
        (0.03, 0.01, 0.12, 0.30, 0.54),
        (0.01, 0.05, 0.24, 0.40, 0.30),
        (0.10, 0.15, 0.40, 0.25, 0.10),
        (0.38, 0.45, 0.09, 0.04, 0.04),
    ),
    # unpronounceable words: none, under 15 %, 40 %, above
    "odd": ((0.80, 0.14, 0.05, 0.01), (0.85, 0.08, 0.05, 0.02), (0.80, 0.08, 0.08, 0.04), (0.30, 0.05, 0.15, 0.50)),
    # symbols: under 4 %, 10 %, 20 %, above
    "symbols": ((0.83, 0.13, 0.03, 0.01), (0.60, 0.25, 0.10, 0.05), (0.20, 0.20, 0.30, 0.30), (0.45, 0.10, 0.10, 0.35)),
    # digits: under 4 %, 15 %, 40 %, above
    "digits": ((0.92, 0.05, 0.02, 0.01), (0.30, 0.40, 0.28, 0.02), (0.15, 0.30, 0.45, 0.10), (0.55, 0.15, 0.10, 0.20)),
    # repetition within the text: no, yes
    "repeat": ((0.9995, 0.0005), (0.98, 0.02), (0.97, 0.03), (0.60, 0.40)),
    # length: under 25 characters, 80, longer
    "length": ((0.12, 0.48, 0.40), (0.40, 0.50, 0.10), (0.30, 0.60, 0.10), (0.20, 0.40, 0.40)),
}
STAY = 0.85
#: Place of the statistic in an observation.
NAMES = tuple(START)


class Lines:
    """Observes the lines of texts; holds the vocabulary."""

    def __init__(self, known: WordSet | frozenset[str]):
        self.known = known
        self.kind: dict[str, int] = {}
        cls = np.zeros(0x3000, np.uint8)
        for c in range(0x3000):
            ch = chr(c)
            cls[c] = 0 if ch.isspace() else 1 if ch.isalpha() else 2 if ch.isnumeric() else 3
        for ch in ".,;:!?'’‘“”\"-—–()«»„¿¡\r":
            cls[ord(ch)] = 0
        self.cls = cls

    def _kinds(self, words: list[str]) -> list[int]:
        """1 natural, 2 unpronounceable, 3 a number, 0 neither, of each word."""
        kinds = list(map(self.kind.get, words))
        if None in kinds:
            if len(self.kind) > 300_000:
                self.kind.clear()
            for w in set(words):
                if w not in self.kind:
                    self.kind[w] = (
                        1 if w in _FUNCTION or w in self.known else 3 if w.isnumeric()
                        else 2 if len(w) > 24 or (len(w) > 2 and _ODD_WORD.search(w)) else 0
                    )
            kinds = list(map(self.kind.get, words))
        return kinds

    @staticmethod
    def layout(line: str, digits: bool) -> int:
        """The first layout pattern that fits; cheap tests keep plain prose from the patterns."""
        for value, pattern in _PATTERNS:
            if value == 3:
                if not (
                    "|" in line or "\t" in line or line.count("/") > 2 or not line.strip("|:+=- ")
                    or (line.count(";") > 2 and "; " not in line) or (line.count(",") > 2 and ", " not in line)
                ):
                    continue
            elif value == 4:
                if not ("...." in line or ". . ." in line or "····" in line or "____" in line or "   " in line):
                    continue
            elif value == 1:
                if line[0].isalpha() and line[1:2] not in ".)" and line[2:3] not in ".)" and line[3:4] not in ".)":
                    continue
            elif not digits:
                continue
            if pattern.search(line):
                return value
        return 0

    def segments(self, text: str) -> list[str]:
        """Lines that are not blank, long ones in pieces at spaces."""
        out = []
        for line in text.split("\n"):
            line = line.strip()
            at, n = 0, len(line)
            while n - at > 1.5 * SEGMENT:
                k = line.find(" ", at + SEGMENT, at + int(1.5 * SEGMENT))
                k = at + SEGMENT if k < 0 else k
                out.append(line[at:k])
                at = k
                while at < n and line[at].isspace():
                    at += 1
            if at < n:
                out.append(line[at:] if at else line)
        return out

    def observe(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[dict]]:
        """(observations (segments, 7), segment sizes, statistics) of each text."""
        segs = [self.segments(t) for t in texts]
        flat = [s for x in segs for s in x]
        if flat:
            code = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = self.cls[np.minimum(code, 0x2FFF)]
            size = np.fromiter(map(len, flat), np.int64, len(flat))
            at = np.cumsum(size) - size
            digits = np.add.reduceat((kind == 2).astype(np.int32), at) / size
            symbols = np.add.reduceat((kind == 3).astype(np.int32), at) / size
        obs, sizes, stats, p = [], [], [], 0
        for t, s in zip(texts, segs, strict=True):
            n = len(s)
            o = np.zeros((n, len(NAMES)), np.int8)
            words, letters, natural, chars, per = 0, 0, 0, 0, []
            y, d = (symbols[p : p + n], digits[p : p + n]) if n else (None, None)
            with_digits = (d > 0).tolist() if n else []
            for i, line in enumerate(s):
                w = _ALL_WORDS.findall(line.lower())
                per.append(w)
                kinds = self._kinds(w)
                good, bad, figures = kinds.count(1), kinds.count(2), kinds.count(3)
                m = len(w) - figures
                words += len(w)
                letters += m
                natural += good
                chars += sum(map(len, w))
                o[i, 0] = self.layout(line, with_digits[i])
                o[i, 1] = 0 if not m else 1 + (good >= 0.2 * m) + (good >= 0.5 * m) + (good >= 0.8 * m)
                o[i, 2] = 0 if not bad else 1 + (bad >= 0.15 * m) + (bad >= 0.4 * m)
                o[i, 6] = (len(line) >= 25) + (len(line) >= 80)
            if n:
                o[:, 3] = (y >= 0.04).astype(np.int8) + (y >= 0.1) + (y >= 0.2)
                o[:, 4] = (d >= 0.04).astype(np.int8) + (d >= 0.15) + (d >= 0.4)
                o[:, 5] = self._repeats(per)
            whole = [x.rstrip() for x in t.split("\n") if x.strip()]
            stats.append(
                {
                    "n_words": words,
                    "mean_word_len": chars / words if words else 0.0,
                    "symbol_share": float((y * size[p : p + n]).sum() / max(1, len(t))) if n else 0.0,
                    "end_share": sum(x[-1] in ".!?…;:,\"'”’»“" for x in whole) / len(whole) if whole else 0.0,
                    "common_share": natural / letters if letters else 0.0,
                }
            )
            obs.append(o)
            sizes.append(size[p : p + n] if n else np.zeros(0, np.int64))
            p += n
        return obs, sizes, stats

    @staticmethod
    def _repeats(per: list[list[str]]) -> np.ndarray:
        """Whether most of a segment is copied over and over, at any distance.

        Its word triples must come four times at least in the text, and each at the same
        distance for as long as that distance is: prose has frequent triples too, but alone.
        """
        out = np.zeros(len(per), np.int8)
        w = [x for s in per for x in s]
        if len(w) < 12:
            return out
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
        tri = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
        order = np.argsort(tri, kind="stable")
        same = tri[order[1:]] == tri[order[:-1]]
        if not (same[2:] & same[1:-1] & same[:-2]).any():
            return out
        gap = np.where(same, order[1:] - order[:-1], 0)
        run = np.cumsum(np.concatenate([[True], ~same])) - 1
        often = np.zeros(len(tri), bool)
        often[order] = np.bincount(run)[run] >= 4
        copied = np.zeros(len(tri), bool)
        for lag in (np.concatenate([[0], gap]), np.concatenate([gap, [0]])):
            at = np.zeros(len(tri), np.int64)
            at[order] = lag
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            size = np.diff(np.concatenate([first, [len(at)]]))
            copied |= np.repeat((at[first] > 0) & (size >= at[first]), size)
        hits = np.concatenate([[0], np.cumsum(copied & often)])
        k = 0
        for i, s in enumerate(per):
            end = min(k + max(1, len(s) - 2), len(tri))
            out[i] = end > k and hits[end] - hits[k] > 0.6 * (end - k)
            k += len(s)
        return out


def start_model() -> LineHmm:
    """The untrained model."""
    n = len(STATES)
    move = np.full((n, n), (1 - STAY) / (n - 1))
    np.fill_diagonal(move, STAY)
    return LineHmm([np.array(START[k]) for k in NAMES], move)


def odd_shares(model: LineHmm, obs: list[np.ndarray], sizes: list[np.ndarray]) -> list[np.ndarray]:
    """Share of each text's characters by state."""
    labels = model.label_all(obs)
    return [np.bincount(s, n, len(STATES)) / max(1, n.sum()) for s, n in zip(labels, sizes, strict=True)]


def known_words(vocab: DataFrame, least: int = KNOWN_CNT) -> WordSet:
    """All words of the vocabulary of at least this count; more than MAX_VOCAB are an error."""
    v = vocab.filter((F.col("cnt") >= least) & F.col("word").isNotNull() & (F.col("word") != "__total__"))
    h = v.select(F.xxhash64("word").alias("h")).limit(MAX_VOCAB + 1).toArrow().column(0).to_numpy()
    if len(h) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} words is not broadcast")
    return WordSet(h)


def sample_of(docs: DataFrame, key: str, text: str, texts: int = TRAIN_TEXTS) -> DataFrame:
    """(t): about `texts` texts, chosen by a hash of the key; staged, as they are read more than once."""
    share = max(1, -(-docs.count() // texts))
    return staged(docs.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(F.col(text).alias("t")), "train-texts")


def fit(sample: DataFrame, known) -> LineHmm:
    """The model, trained on the lines of the texts of a sample (t)."""

    def run(batches):
        lines = Lines(known.value)
        for b in batches:
            for s in small_batches(b, 0):
                obs, _, _ = lines.observe([t for t in s.column(0).to_pylist() if t])
                obs = [o for o in obs if len(o)]
                yield pa.RecordBatch.from_arrays([pa.array([o.tobytes() for o in obs], pa.binary())], ["o"])

    rows = sample.filter("t is not null").mapInArrow(run, "o binary").collect()
    seqs = sorted(bytes(r.o) for r in rows)
    return start_model().trained([np.frombuffer(s, np.int8).reshape(-1, len(NAMES)) for s in seqs], PRIOR)


STATS_SCHEMA = (
    "k long, n_chars long, n_lines int, n_words long, mean_word_len double, symbol_share double, end_share double, "
    "common_share double, prose_share double, list_share double, table_share double, junk_share double, natural boolean"
)


def text_statistics(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text", carry: tuple = ()) -> DataFrame:
    """(key, statistics, label shares, natural, the columns of `carry` as doubles): one row for each row of docs."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(known_words(vocab))
    model = spark.sparkContext.broadcast(fit(sample_of(docs, key, text), known))

    def run(batches):
        lines, m = Lines(known.value), model.value
        for whole in batches:
            for b in small_batches(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                obs, sizes, stats = lines.observe(texts)
                rows = []
                for t, o, by, s in zip(texts, obs, odd_shares(m, obs, sizes), stats, strict=True):
                    odd = float(by[1:].sum())
                    rows.append((len(t), len(o), *s.values(), *map(float, by), not (len(t) >= MIN_CHARS and odd > 0.5)))
                cols = list(zip(*rows, strict=True))
                arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())]
                arrays += [pa.array(c, pa.float64()) for c in cols[3:-1]] + [pa.array(cols[-1], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays + b.columns[2:], [f.split()[0] for f in schema.split(", ")])

    schema = ", ".join([STATS_SCHEMA, *[f"c{i} double" for i in range(len(carry))]])
    src = docs.select(
        F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(carry)]
    )
    return src.mapInArrow(run, schema).withColumnsRenamed({"k": key} | {f"c{i}": c for i, c in enumerate(carry)})


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: its statistics and label shares beside the stored metrics."""
    docs = table(spark, folder, "docvalue").select("rec_id", "text", "quality", "dicthit")
    return text_statistics(spread(docs), "rec_id", table(spark, folder, "vocab"), carry=("quality", "dicthit"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id of the records that are not natural text."""
    docs = spread(table(spark, folder, "docvalue").select("rec_id", "text"))
    return text_statistics(docs, "rec_id", table(spark, folder, "vocab")).filter("not natural").select("rec_id")


QUERIES = {"p2_found": p2_found, "p2_statistics": p2_statistics}
ORACLE: dict[str, str] = {}
