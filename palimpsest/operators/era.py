"""Out-of-period vocabulary and the likely date of a text, from word-frequency tables.

Terms and frequency tables are DataFrames: they are parameters, built from a corpus or read
from files. Texts are read once, in Arrow batches; word tables of a checked size are broadcast
and larger ones joined to the texts' word counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import staged
from . import lookup as L

# Constants of the date scorer, and its weights as published.
SMOOTH, GATE, LOW, HIGH, VETO = 0.5, 200.0, -8.0, 10.0, 0.03
WEIGHTS = {"sum_lr": 0.4147516365738406, "gated_sum": 0.5026655644445829, "arch_count": -0.7609529245783236}
BIAS = -1.1547807599900197
ARCHAIC = (
    "thou", "thee", "thy", "thine", "hath", "hast", "doth", "dost", "art", "ye", "ere", "whilst", "betwixt", "methinks",
    "prithee", "forsooth", "wherefore", "hither", "thither", "whence", "thence", "verily", "nay", "yea", "unto", "shalt",
    "wilt", "'tis", "'twas", "o'er", "ne'er",
)


def word_frequencies(docs: DataFrame, text: str = "text", least: int = 1, by: Column | None = None) -> DataFrame:
    """(word, cnt), or (period, word, cnt) by a column of strings, of the detector's words, at least `least` times.

    Words are counted by batch before the shuffle; rows of a null period are left out.
    """

    def run(batches):
        for whole in batches:
            for b in L.slices(whole, 1):
                n: Counter = Counter()
                for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n.update((p, w) for w in L.detector_words(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(n.values(), pa.int64())], ["period", "word", "cnt"]
                )

    src = docs.select((F.lit("") if by is None else by).alias("p"), F.col(text).alias("t")).filter("t is not null and p is not null")
    keys = ["word"] if by is None else ["period", "word"]
    out = src.mapInArrow(run, "period string, word string, cnt long").groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    return out.filter(F.col("cnt") >= least) if least > 1 else out


def term_list(spark, banned: list[str], allowed: list[str] = ()) -> DataFrame:
    """(term, n): banned terms that are not allowed, lower case, comments and blanks left out."""
    clean = lambda xs: [(x.strip().lower(),) for x in xs if x.strip() and not x.strip().startswith("#")]
    b = spark.createDataFrame(clean(banned) or [("",)], "term string").filter("term <> ''").distinct()
    a = spark.createDataFrame(clean(allowed) or [("",)], "term string")
    return b.join(a, "term", "left_anti").withColumn("n", F.size(F.split("term", " ")))


#: Terms that are looked for in one pass over the texts; longer lists take further passes.
TERM_LIMIT = 100_000
# Endings that a term may have.
ENDINGS = ("es", "ed", "s")
_WORDS_ONLY = re.compile(r"[a-z]+(?: [a-z]+)*")


def base_forms(word: str) -> list[str]:
    """A word and what it may be an inflected form of: before its apostrophe, or without an ending."""
    if "'" in word:
        return [word, word.split("'", 1)[0]]
    if len(word) <= 2:
        return [word]
    return [word, *(word[: -len(e)] for e in ENDINGS if word.endswith(e))]


class TermFinder:
    """Terms by their first words, and terms with other signs in an automaton."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.single: set[str] = set()
        self.longer: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
        self.signed = ahocorasick.Automaton()
        for t in terms:
            if not _WORDS_ONLY.fullmatch(t):
                self.signed.add_word(t, t)
            elif " " in t:
                self.longer[t.split(" ", 1)[0]].append((t, t.split(" ")))
            else:
                self.single.add(t)
        if len(self.signed):
            self.signed.make_automaton()
        self.tail = re.compile(r"(?:'s|es|s|ed)?(?!\w)")
        self.memo: dict[str, str | None] = {}

    def find(self, text: str) -> set[str]:
        words = L.detector_words(text)
        hits = set()
        distinct = set(words)
        for w in distinct:
            if w not in self.memo:
                if len(self.memo) > 500_000:
                    self.memo.clear()
                self.memo[w] = next((f for f in base_forms(w) if f in self.single), None)
            if self.memo[w] is not None:
                hits.add(self.memo[w])
        begun = self.longer.keys() & distinct
        if begun:
            for i, w in enumerate(words):
                for term, parts in self.longer[w] if w in begun else ():
                    end = i + len(parts) - 1
                    if end < len(words) and words[i:end] == parts[:-1] and parts[-1] in base_forms(words[end]):
                        hits.add(term)
        if len(self.signed):
            low = text.lower()
            for end, term in self.signed.iter(low):
                at = end + 1 - len(term)
                before = low[at - 1] if at else " "
                if not (before.isalnum() or before == "_") and self.tail.match(low, end + 1):
                    hits.add(term)
        return hits


def term_hits(docs: DataFrame, key: str, terms: DataFrame, text: str = "text") -> DataFrame:
    """(key, term): the terms that occur in each text as whole words, once each.

    The last word of a term may have an ending (-s, -es, -ed, or an apostrophe and what
    follows). Terms of words, of any number, are looked up among the text's words; terms with
    other signs in the lower-case text, between characters that are no letters or digits. The
    list is broadcast TERM_LIMIT terms at a time, each block with a pass of its own. Null texts
    have no hits.
    """
    spark = docs.sparkSession
    every = sorted({r.term for r in terms.select("term").distinct().toLocalIterator() if r.term})
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")

    def search(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            finder = TermFinder(shared.value)
            for whole in batches:
                for b in L.slices(whole, 1):
                    at, found = [], []
                    for i, t in enumerate(b.column(1).to_pylist()):
                        hits = sorted(finder.find(t))
                        at += [i] * len(hits)
                        found += hits
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["k", "term"])

        return src.mapInArrow(run, f"k {kind}, term string")

    blocks = [every[k : k + TERM_LIMIT] for k in range(0, len(every), TERM_LIMIT)] or [[]]
    return reduce(DataFrame.unionByName, map(search, blocks)).distinct().withColumnRenamed("k", key)


def late_years(text: Column) -> Column:
    """Distinct years 1901 to 2099 in a text, but for years B.C. and ends of ranges B.C."""
    years = F.regexp_extract_all(text, F.lit(r"\b((?!1900\b)(?:19\d\d|20\d\d))\b(?!\s*B\.?\s*C\.?)"), F.lit(1))
    bc = F.regexp_extract_all(text, F.lit(r"(?i)\bB\.?\s*C\.?\s*,?\s*to\s+(\d{4})\b"), F.lit(1))
    return F.array_sort(F.array_except(years, bc))


def late_numbers(text: Column) -> Column:
    """Numbers of three or four digits above 1900, in order: what may be a year not yet come."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d{3,4})\b"), F.lit(1)), lambda n: n.cast("int") > 1900)


def era_gate(docs: DataFrame, key: str, terms: DataFrame, text: str = "text") -> DataFrame:
    """(key, terms, year, reason) of every row: its out-of-period terms, first late number, and why it is out.

    reason is 'terms' before 'year', null for a text in period. Keys must be unique.
    """
    hits = term_hits(docs, key, terms, text).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    year = F.try_element_at(late_numbers(F.col(text)), F.lit(1)).cast("int")
    out = docs.select(key, year.alias("year")).join(hits, key, "left")
    reason = F.when(F.size("terms") > 0, "terms").when(F.col("year").isNotNull(), "year")
    return out.select(key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "year", reason.alias("reason"))


def log_ratios(old: DataFrame, modern: DataFrame) -> DataFrame:
    """(word, old_cnt, lr, lr0): smoothed log ratio of modern to old, for every word of either.

    Staged, as its users read it more than once; lr0 is the ratio of a word in neither table.
    """
    both = old.select("word", F.col("cnt").alias("o")).join(modern.select("word", F.col("cnt").alias("m")), "word", "full_outer")
    both = staged(both.select("word", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("m", F.lit(0)).alias("m")), "word-counts")
    # one row
    total = both.agg(F.sum("o").alias("sum_o"), F.sum("m").alias("sum_m"), F.count(F.lit(1)).alias("v"))
    p = lambda c, t: (c + SMOOTH) / (F.col(t) + F.col("v") * SMOOTH)
    return both.crossJoin(F.broadcast(total)).select(
        "word", F.col("o").alias("old_cnt"), F.log(p(F.col("m"), "sum_m") / p(F.col("o"), "sum_o")).alias("lr"),
        F.log(p(F.lit(0.0), "sum_m") / p(F.lit(0.0), "sum_o")).alias("lr0"),
    )


FEATURES = "n_tokens long, english_frac double, sum_lr double, gated_sum double, arch_count double"


def date_features(docs: DataFrame, key: str, ratios: DataFrame, text: str = "text") -> DataFrame:
    """(key, n_tokens, english_frac, sum_lr, gated_sum, arch_count) of every row; 0 without words.

    The ratios are looked up within the row while they fit a broadcast; a larger table is
    joined to word counts by text, for which the keys must be unique.
    """
    spark = docs.sparkSession
    first = ratios.select("lr0").limit(1).collect()
    lr0 = first[0].lr0 if first else 0.0
    known = L.word_table(ratios, "word", "old_cnt", "lr")
    if known is None:
        return _joined_features(docs, key, ratios, lr0, text)
    shared = spark.sparkContext.broadcast(known)
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", *[f.split()[0] for f in FEATURES.split(", ")]]

    def run(batches):
        table, old = shared.value, frozenset(ARCHAIC)
        for whole in batches:
            for b in L.slices(whole, 1):
                words, at, counts = L.flat_words(b.column(1).to_pylist())
                place = table.places(words)
                cnt, lr = (np.where(place >= 0, v[place] if len(v) else 0.0, d) for v, d in zip(table.values, (0.0, lr0), strict=True))
                per = np.stack(
                    [
                        (place >= 0).astype(float), np.clip(lr, LOW, HIGH), np.where(lr > 0, lr / (1 + cnt / GATE), 0.0),
                        np.fromiter((w in old for w in words), float, len(words)),
                    ],
                    axis=1,
                )
                s = L.sums_by_text(per[at], counts)
                frac = s[:, 0] / np.maximum(counts, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(frac), *[pa.array(s[:, i].copy()) for i in (1, 2, 3)]], names)

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {kind}, {FEATURES}").withColumnRenamed("k", key)


def _words_by_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    words = docs.select(key, F.explode(T.word_tokens(F.col(text))).alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def _joined_features(docs: DataFrame, key: str, ratios: DataFrame, lr0: float, text: str) -> DataFrame:
    """date_features by a join; a hot word's rows are split by the adaptive skew join."""
    x = _words_by_text(docs, key, text).join(ratios.select("word", "old_cnt", "lr").hint("merge"), "word", "left")
    x = x.withColumn("known", F.col("lr").isNotNull()).withColumn("lr", F.coalesce("lr", F.lit(lr0)))
    feats = x.groupBy(key).agg(
        F.sum("n").alias("n_tokens"),
        (F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("english_frac"),
        F.sum(F.col("n") * F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.col("lr")))).alias("sum_lr"),
        F.sum(F.when(F.col("lr") > 0, F.col("n") * F.col("lr") / (1 + F.coalesce("old_cnt", F.lit(0)) / GATE)).otherwise(0.0)).alias("gated_sum"),
        F.sum(F.when(F.col("word").isin(*ARCHAIC), F.col("n")).otherwise(0)).cast("double").alias("arch_count"),
    )
    return docs.select(key).join(feats, key, "left").na.fill(0)


def date_scores(docs: DataFrame, key: str, ratios: DataFrame, hits: DataFrame, text: str = "text", prior: float = 0.0) -> DataFrame:
    """(key, features, p): p that the text is old, a row for each key.

    A text with a term hit has p of VETO at most; one without words has counts of 0.
    """
    feats = date_features(docs, key, ratios, text)
    logit = F.lit(BIAS - prior) + sum((F.col(f) * w for f, w in WEIGHTS.items()), F.lit(0.0))
    p = F.when(logit > 700, 0.0).otherwise(1 / (1 + F.exp(logit)))
    veto = hits.select(key).distinct().withColumn("hit", F.lit(True))
    return feats.join(veto, key, "left").withColumn("p", F.when(F.col("hit"), F.least(p, F.lit(VETO))).otherwise(p)).drop("hit")


def best_period(docs: DataFrame, key: str, periods: DataFrame, text: str = "text") -> DataFrame:
    """(key, period): the period (period, word, cnt) under which the text's words are likeliest.

    Of equal ones the greatest name. Texts without words give no row; keys must be unique. The
    frequencies are looked up within the row while they fit a broadcast, or else joined.
    """
    spark = docs.sparkSession
    periods = staged(periods.select("period", "word", "cnt"), "periods")
    sizes = {r.period: r.total for r in periods.groupBy("period").agg(F.sum("cnt").alias("total")).collect()}  # one row a period
    names = sorted(sizes)
    if not names:
        return docs.select(key, F.lit(None).cast("string").alias("period")).limit(0)
    wide = periods.groupBy("word").agg(*[F.sum(F.when(F.col("period") == p, F.col("cnt")).otherwise(0)).alias(f"p{i}") for i, p in enumerate(names)])
    wide = staged(wide, "periods-by-word")
    v = wide.count()
    rest = [np.log(SMOOTH) - np.log(sizes[p] + v * SMOOTH) for p in names]
    known = L.word_table(wide, "word", *[f"p{i}" for i in range(len(names))]) if v * len(names) <= L.WORD_LIMIT else None
    if known is None:
        return _joined_period(docs, key, wide, names, rest, text)
    shared = spark.sparkContext.broadcast(known)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        table = shared.value
        gain = np.log(np.stack(table.values, axis=1) + SMOOTH) - np.log(SMOOTH)
        for whole in batches:
            for b in L.slices(whole, 1):
                words, at, counts = L.flat_words(b.column(1).to_pylist())
                place = table.places(words)
                per = np.where((place >= 0)[:, None], gain[place], 0.0)
                ll = L.sums_by_text(per[at], counts) + counts[:, None] * np.array(rest)
                best = len(names) - 1 - ll[:, ::-1].argmax(1)
                keep = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([names[i] for i in best[keep]], pa.string())], ["k", "period"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    return src.mapInArrow(run, f"k {kind}, period string").withColumnRenamed("k", key)


def _joined_period(docs: DataFrame, key: str, wide: DataFrame, names: list[str], rest: list[float], text: str) -> DataFrame:
    x = _words_by_text(docs, key, text).join(wide.hint("merge"), "word", "left")
    gains = [F.sum(F.col("n") * (F.log(F.coalesce(f"p{i}", F.lit(0)) + SMOOTH) - float(np.log(SMOOTH)) + float(rest[i]))) for i in range(len(names))]
    ll = x.groupBy(key).agg(*[g.alias(f"l{i}") for i, g in enumerate(gains)])
    top = F.array_max(F.array(*[F.struct(F.col(f"l{i}").alias("l"), F.lit(p).alias("period")) for i, p in enumerate(names)]))
    return ll.select(key, top["period"].alias("period"))
