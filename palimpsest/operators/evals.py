"""Scoring model answers and summarising runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.stems import stem
from .ordinal import quantiles

LETTERS = "ABCDEFGH"


def parse_letter(text: Column, choices: Column) -> Column:
    """Index of the option letter an answer names; null without one in range.

    An answer cue counts in any case; else the first capital that stands alone and is in range.
    """
    cue = F.upper(F.regexp_extract(text, r"(?i)answer\s*(?:is)?\s*[:\-]?\s*\(?([A-H])(?![A-Za-z])", 1))
    alone = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-H])(?![A-Za-z])"), F.lit(1))
    place = lambda c: F.ascii(c) - 65
    first = F.try_element_at(F.filter(alone, lambda c: place(c) < choices), F.lit(1))
    return F.when((cue != "") & (place(cue) < choices), place(cue)).otherwise(place(first))


def match_choice(text: Column, choices: Column) -> Column:
    """Index of the choice an answer gives in words: the equal one, or the longest that contains
    or is contained; null if two are equal or the two longest tie."""
    out = F.array_join(T.answer_tokens(text), " ")
    c = F.transform(
        choices,
        lambda x, i: F.struct(
            F.size(T.answer_tokens(x)).alias("n"), F.array_join(T.answer_tokens(x), " ").alias("t"), i.alias("i")
        ),
    )
    c = F.filter(c, lambda x: x["n"] > 0)
    same = F.filter(c, lambda x: x["t"] == out)
    part = F.filter(c, lambda x: (x["t"] != out) & (F.contains(out, x["t"]) | F.contains(x["t"], out)))
    best = F.array_max(F.transform(part, lambda x: x["n"]))
    top = F.filter(part, lambda x: x["n"] == best)
    return (
        F.when((out == "") | text.isNull(), F.lit(None))
        .when(F.size(same) == 1, F.try_element_at(same, F.lit(1))["i"])
        .when(F.size(same) > 1, F.lit(None))
        .when(F.size(top) == 1, F.try_element_at(top, F.lit(1))["i"])
    )


def begins_with_answer(generated: Column, gold: Column) -> Column:
    """Whether the normalized gold answer begins the normalized generation; empty gold wants nothing."""
    g, a = T.answer_tokens(generated), T.answer_tokens(gold)
    return F.when(F.size(a) == 0, F.size(g) == 0).otherwise(F.slice(g, 1, F.greatest(F.lit(1), F.size(a))) == a)


def token_budget(gold: Column) -> Column:
    """Tokens to allow for an answer: three a word and eight, within 8 and 200."""
    words = F.greatest(F.lit(1), F.size(T.space_words(gold)))
    return F.least(F.lit(200), F.greatest(F.lit(8), words * 3 + 8))


def rouge_l(a: Column, b: Column) -> Column:
    """ROUGE-L F of two token arrays (harmonic mean of the longest common subsequence's shares)."""

    def lcs(x: list, y: list) -> int:
        # bit-parallel over y: one word-wise step per token of x
        at: dict = {}
        for i, t in enumerate(y):
            at[t] = at.get(t, 0) | (1 << i)
        s, full = (1 << len(y)) - 1, (1 << len(y)) - 1
        for t in x:
            u = s & at.get(t, 0)
            s = ((s + u) | (s - u)) & full
        return len(y) - s.bit_count()

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            n = lcs(list(p), list(q)) if len(p) and len(q) else 0
            out.append(2 * n / (len(p) + len(q)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return f(a, b)


@F.pandas_udf(ArrayType(StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """The stems of an array of lower-case words."""
    return tokens.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def answers_alike(generated: Column, gold: Column, least: float = 0.30) -> Column:
    """Whether a generated answer is close enough to the gold one: ROUGE-L F of the stems of their
    normalized words of at least `least`; null texts are like nothing."""
    r = rouge_l(stemmed(T.answer_tokens(generated)), stemmed(T.answer_tokens(gold)))
    return F.coalesce(r >= least, F.lit(False))


def best_rouge(candidates: DataFrame, pool: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, best): the best ROUGE-L of each candidate against a fixed pool of token arrays.

    The pool is a stated query set of bounded size (checked), broadcast once; the corpus side
    is not shuffled.
    """
    rows = [list(r[0]) for r in pool.select(tokens).limit(5001).collect()]
    if len(rows) > 5000:
        raise ValueError("a pool of more than 5,000 entries must be given in blocks")
    b = candidates.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("double")
    def best(x: pd.Series) -> pd.Series:
        tables = []
        for y in b.value:
            at: dict = {}
            for i, t in enumerate(y):
                at[t] = at.get(t, 0) | (1 << i)
            tables.append((at, len(y)))
        out = []
        for p in x:
            top = 0.0
            for at, n in tables if p is not None and len(p) else ():
                s = full = (1 << n) - 1
                for t in p:
                    u = s & at.get(t, 0)
                    s = ((s + u) | (s - u)) & full
                common = n - s.bit_count()
                top = max(top, 2 * common / (n + len(p)))
            out.append(top)
        return pd.Series(out, dtype="float64")

    return candidates.select(key, best(F.col(tokens)).alias("best"))


def novel_first(pairs: list[tuple[int, int]], order: list[int]) -> list[int]:
    """Entries kept in order, each unless it is similar to one kept before (pairs of similar entries)."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept: set[int] = set()
    for x in order:
        if not near.get(x, set()) & kept:
            kept.add(x)
    return sorted(kept, key=order.index)


def accuracy(records: DataFrame, task: str = "task") -> DataFrame:
    """(task, n, accuracy, unparsed, errors, first_error): of records (idx, correct, answered, error)."""
    failed = F.col("error").isNotNull()
    return records.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.avg((~F.col("answered")).cast("int")).alias("unparsed"),
        F.avg(failed.cast("int")).alias("errors"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("idx"))).alias("first_error"),
    )


def centred(acc: Column, baseline_pct: Column) -> Column:
    """Accuracy on the scale where chance is 0 and perfect is 1."""
    b = F.coalesce(baseline_pct, F.lit(0)) / 100.0
    return (acc - b) / (1 - b)


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column a share): the value at the index int(n * share) of the group's sorted values; nulls left out."""
    return quantiles(df, group, value, shares, nearest=True)


def token_statistics(tokens: DataFrame, key: str, logprob: str) -> DataFrame:
    """Mean, median, tenth percentile and least token probability, share under 1 %, perplexity."""
    p = F.exp(logprob)
    t = tokens.filter(F.col(logprob).isNotNull()).withColumn("_p", p)
    per = t.groupBy(key).agg(
        F.avg("_p").alias("mean_p"), F.min("_p").alias("min_p"), F.avg((F.col("_p") < 0.01).cast("int")).alias("rare"),
        F.exp(-F.avg(logprob)).alias("perplexity"),
    )
    ranks = quantiles(t, key, "_p", {"median_p": 0.5, "p10": 0.1}).withColumnRenamed(key, "_g")
    return per.join(ranks, F.col(key).eqNullSafe(F.col("_g"))).select(key, "mean_p", "median_p", "p10", "min_p", "rare", "perplexity")


def bits_per_byte(nll_sum: Column, byte_sum: Column) -> Column:
    """Bits per byte of summed negative log likelihoods (natural) over summed bytes."""
    return nll_sum / F.log(F.lit(2.0)) / byte_sum


def ladder(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation between anchors, clamped outside."""
    pts = sorted(points)
    out = F.lit(pts[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:], strict=False))):
        out = F.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= pts[0][0], F.lit(pts[0][1])).otherwise(out)


def composite(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are neither null nor NaN."""
    ok = {c: F.col(c).isNotNull() & ~F.isnan(c) for c in parts}
    top = sum((F.when(ok[c], F.col(c) * w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return top / F.nullif(sum((F.when(ok[c], F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0)), F.lit(0.0))


def echo_rate(words: Column, back: int = 4) -> Column:
    """Share of words that are among the `back` before them."""
    at = F.sequence(F.lit(1), F.size(words))
    hits = F.filter(
        at, lambda i: F.array_contains(F.slice(words, F.greatest(F.lit(1), i - back), F.least(i - 1, F.lit(back))), F.element_at(words, i))
    )
    return F.when(F.size(words) > 0, F.size(hits) / F.size(words))


def distinct_share(words: Column, n: int) -> Column:
    """Distinct n-grams over all n-grams; null where there are none."""
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.array_join(F.slice(words, i, n), " ")
    )
    return F.when(F.size(words) >= n, F.size(F.array_distinct(grams)) / F.size(grams))


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """The text up to the first of the stop sequences."""
    places = F.array(*[F.instr(text, s) for s in stops])
    first = F.array_min(F.filter(places, lambda p: p > 0))
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def trailing_number(name: Column) -> Column:
    """The number a name ends with, 10^12 without one, for sorting."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(10**12))


def tier(x: Column, bands: list[tuple[float, str]], below: str) -> Column:
    """The name of the highest band whose floor x reaches."""
    out = F.lit(below)
    for floor, name in sorted(bands):
        out = F.when(x >= floor, name).otherwise(out)
    return out


def best_choice(scores: Column) -> Column:
    """Index of the greatest score that is not null, the first of equals; null without any."""
    top = F.array_max(scores)
    return F.when(top.isNotNull(), (F.array_position(scores, top) - 1).cast("int"))


def suite(df: DataFrame, group: str, metrics: dict[str, Column]) -> DataFrame:
    """(group, one column a metric): aggregates registered by name; group null for all rows."""
    return df.rollup(group).agg(*[m.alias(n) for n, m in metrics.items()])
