"""Quality metrics of texts and the scores made of them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..operators import lookup as L
from . import text as T

# Limits of the ingest filter.
MIN_LENGTH, MAX_LENGTH, MIN_UNIQUE, MAX_UNIQUE = 100, 10_000_000, 10, 132
METRICS = ("compress", "entropy", "dicthit", "alpha", "vowel", "ascii")
_ALPHA = "^[A-Za-z][A-Za-z'’\\-]*$"


@F.pandas_udf(IntegerType())
def distinct_characters(texts: pd.Series) -> pd.Series:
    """Number of different characters; null for null. In Arrow batches, as the built-in way makes an array of all of them."""
    return pd.Series([None if t is None else len(set(t)) for t in texts], dtype="Int32")


def prefilter(text: Column, max_length: int = MAX_LENGTH) -> Column:
    """Long enough, varied enough, of more than two words; false for null. Only texts of a fit
    length are looked into."""
    n = F.length(text)
    fit = (n > MIN_LENGTH) & (n <= max_length) & text.rlike(r"\S\s+\S+\s+\S")
    kinds = distinct_characters(F.when(fit, text))
    return F.coalesce(fit & (kinds > MIN_UNIQUE) & (kinds <= MAX_UNIQUE), F.lit(False))


def quality(text: Column) -> Column:
    """Weighted shares of letters, digits and blanks, marks and other characters, times 100."""
    n = F.length(text)
    letters, digits, marks = (T.count_of(text, c) for c in (T.QUALITY_LETTERS, T.QUALITY_DIGITS, T.QUALITY_MARKS))
    other = n - letters - digits - marks
    score = letters * 2.0 + digits * 1.0 + marks * 0.5 - other * 0.5
    return F.when(n > 0, (score / n - 0.75) * 100)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, as percent of 4.4."""
    chars = T.characters(text)
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    h = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, h / 4.4 * 100)


@F.pandas_udf(DoubleType())
def compress(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """100 * (raw deflate length / UTF-8 length + 0.5); null for null and empty texts."""
    for texts in batches:
        out = []
        for t in texts:
            if not t:
                out.append(None)
                continue
            raw = t.encode()
            c = zlib.compressobj(wbits=-15)
            out.append(100 * ((len(c.compress(raw)) + len(c.flush())) / len(raw) + 0.5))
        yield pd.Series(out, dtype="float64")


def alpha_tokens(tokens: Column) -> Column:
    """Well-formed alphabetic tokens."""
    return F.filter(tokens, lambda t: t.rlike(_ALPHA))


def alpha_share(text: Column) -> Column:
    toks = T.store_tokens(text)
    return F.size(alpha_tokens(toks)) * 100.0 / F.greatest(F.lit(1), F.size(toks))


def vowel_share(text: Column) -> Column:
    a = alpha_tokens(T.store_tokens(text))
    hits = F.size(F.filter(a, lambda t: t.rlike("(?i)[aeiouy]")))
    return F.when(F.size(a) > 0, hits * 100.0 / F.size(a)).otherwise(0.0)


def ascii_share(text: Column) -> Column:
    noise = T.count_of(text, T.noise_class())
    n = F.nullif(F.length(T.normalized(text)), F.lit(0))
    return F.greatest(F.lit(0.0), (1 - noise * 5.0 / n) * 100)


def dict_key(token: Column) -> Column:
    return F.translate(F.lower(token), "’", "'")


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_ALPHA_TOKEN = re.compile(_ALPHA)


def dict_hits(docs: DataFrame, key: str, vocab: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """(key, alpha_n, hit_n, dict_hit): share of alphabetic tokens in the vocabulary, of texts with such tokens.

    A token counts whole or without a possessive ending. The vocabulary is looked up within
    the row while it fits a broadcast; a larger one is joined to each text's distinct tokens,
    for which the keys must be unique.
    """
    words = vocab.filter((F.col("cnt") >= least) & (F.col("word") != "__total__")).select("word").distinct()
    known = L.word_table(words, "word")
    if known is None:
        return _joined_hits(docs, key, words, text)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        table, memo = shared.value, {}
        for whole in batches:
            for b in L.slices(whole, 1):
                texts = [_BLANKS.split(t) for t in b.column(1).to_pylist()]
                fresh = [t for t in {t for x in texts for t in x} if t not in memo]
                if len(memo) > 500_000:
                    memo, fresh = {}, list({t for x in texts for t in x})
                # 0 no alphabetic token, 1 one, 2 one in the vocabulary
                bare = [_OUTER.sub("", t) for t in fresh]
                low = [t.lower().replace("’", "'") for t in bare]
                hit = table.places(low) >= 0
                hit |= (table.places([t[:-2] for t in low]) >= 0) & np.array([t.endswith("'s") for t in low], bool)
                memo.update((t, (1 + int(h)) if _ALPHA_TOKEN.match(x) else 0) for t, x, h in zip(fresh, bare, hit, strict=True))
                codes = [[memo[t] for t in x] for x in texts]
                hits = np.array([c.count(2) for c in codes], np.int64)
                n = np.array([c.count(1) for c in codes], np.int64) + hits
                keep = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(n[keep]), pa.array(hits[keep])], ["k", "alpha_n", "hit_n"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    out = src.mapInArrow(run, f"k {kind}, alpha_n long, hit_n long").withColumnRenamed("k", key)
    return out.withColumn("dict_hit", F.col("hit_n") * 100.0 / F.col("alpha_n"))


def _joined_hits(docs: DataFrame, key: str, words: DataFrame, text: str) -> DataFrame:
    """dict_hits by two joins; a hot token's rows are split by the adaptive skew join."""
    toks = (
        docs.select(F.col(key), F.explode(alpha_tokens(T.store_tokens(F.col(text)))).alias("t"))
        .select(key, dict_key(F.col("t")).alias("t"))
        .groupBy(key, "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bare", F.when(F.col("t").endswith("'s"), F.expr("substring(t, 1, length(t) - 2)")))
    )
    hit = toks.join(words.withColumn("h1", F.lit(1)), F.col("t") == F.col("word"), "left").drop("word")
    hit = hit.join(words.withColumn("h2", F.lit(1)), F.col("bare") == F.col("word"), "left").drop("word")
    per = hit.groupBy(key).agg(
        F.sum("n").alias("alpha_n"),
        F.sum(F.when(F.col("h1").isNotNull() | F.col("h2").isNotNull(), F.col("n")).otherwise(0)).alias("hit_n"),
    )
    return per.withColumn("dict_hit", F.col("hit_n") * 100.0 / F.col("alpha_n"))


def number(c: Column) -> Column:
    """Null and NaN as 0."""
    return F.coalesce(F.when(F.isnan(c), F.lit(None)).otherwise(c), F.lit(0.0))


def global_score(col=F.col) -> Column:
    """Quality less the distances of six metrics from 100."""
    out = number(col("quality"))
    for m in METRICS:
        out = out - F.abs(number(col(m)) - 100)
    return out


def conflict_score(col=F.col) -> Column:
    """The smaller score that decides conflicts at import: quality, compress and entropy."""
    return (
        number(col("quality"))
        - 100
        - F.abs(number(col("compress")) - 100)
        - F.abs(number(col("entropy")) - 100)
    )
