"""Evaluation runs and checkpoints as tables: bits on spans, provenance, restarts, filters, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evals import bits_per_byte, trailing_number
from .ordinal import running

#: Texts of fewer tokens, answers of fewer tokens and generated texts of fewer words are left out.
LEAST_TOKENS, LEAST_ANSWER_TOKENS, LEAST_JUDGED_WORDS = 8, 4, 20


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def held_out_bits(texts: DataFrame, nll: str, n_bytes: str, most: int = 1024) -> DataFrame:
    """(texts, bits_per_byte) of token losses (natural): the first `most` tokens of texts of at least LEAST_TOKENS.

    n_bytes holds the bytes of each token.
    """
    t = texts.filter(F.size(nll) >= LEAST_TOKENS)
    bits = F.sum(_sum(F.slice(nll, 1, most)))
    size = F.sum(_sum(F.slice(F.transform(n_bytes, lambda b: b.cast("double")), 1, most)))
    return t.agg(F.count(F.lit(1)).alias("texts"), F.when(size > 0, bits_per_byte(bits, size)).alias("bits_per_byte"))


def span_bits(prefix: Column, whole: Column, nll: Column, span: Column) -> Column:
    """Bits per byte on the part after a prefix, of token ids and losses; null if the prefix's tokens do not begin the whole's."""
    n = F.size(prefix)
    nested = (F.size(whole) > n) & (F.slice(whole, F.lit(1), F.greatest(n, F.lit(1))) == prefix) | ((n == 0) & (F.size(whole) > 0))
    tail = F.slice(nll, n + 1, F.greatest(F.size(nll) - n, F.lit(0)))
    return F.when(nested & (F.octet_length(span) > 0), bits_per_byte(_sum(tail), F.octet_length(span)))


def fitted_turn(context: Column, target: Column, most: int = 768) -> Column:
    """STRUCT<context, target>: a context cut at its left and a target cut at its right to share `most` tokens; null for
    short targets. The target is granted half of them at most before the context is cut."""
    budget = F.lit(most) - F.least(F.size(target), F.lit(most // 2))
    c = F.slice(context, F.greatest(F.size(context) - budget, F.lit(0)) + 1, budget)
    return F.when(F.size(target) >= LEAST_ANSWER_TOKENS, F.struct(c.alias("context"), F.slice(target, F.lit(1), F.lit(most) - F.size(c)).alias("target")))


def judge_deviation(real: DataFrame, made: DataFrame, nll: str, n_bytes: str, words: str) -> DataFrame:
    """(real, made, deviation): a judge's bits per byte on real and on generated texts of enough words, and how far they lie apart."""
    r = held_out_bits(real, nll, n_bytes).select(F.col("bits_per_byte").alias("real"))
    m = held_out_bits(made.filter(F.col(words) >= LEAST_JUDGED_WORDS), nll, n_bytes).select(F.col("bits_per_byte").alias("made"))
    return r.join(m).select("real", "made", F.abs(F.col("made") - F.col("real")).alias("deviation"))  # one row each


def provenance(runs: DataFrame, name: str, step: str, flos: str, params: str) -> DataFrame:
    """runs with tokens_seen, tokens_per_param and restarted: a name that ends in another step than the trainer counts."""
    tokens = F.when((F.col(flos) > 0) & (F.col(params) > 0), F.col(flos) / (F.col(params) * 6.0))
    named = F.regexp_extract(name, r"(\d+)$", 1).try_cast("long")
    restarted = F.coalesce((F.col(step) != 0) & (named != F.col(step)), F.lit(False))
    return runs.withColumns({"tokens_seen": tokens, "tokens_per_param": tokens / F.col(params), "restarted": restarted})


def restarts(runs: DataFrame, step: str, named: str, share: float = 0.9) -> DataFrame:
    """Runs whose trainer counts less than `share` of the step in their name."""
    return runs.filter(F.col(step) < F.col(named) * share)


def loopers(rows: DataFrame, echo: str, distinct2: str, most_echo: float = 0.30, least_distinct: float = 0.60) -> DataFrame:
    """Rows that repeat themselves: too many echoes or too few different pairs of words."""
    return rows.filter((F.col(echo) > most_echo) | (F.col(distinct2) < least_distinct))


def extremes(rows: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """(group, best, worst, lowest, highest): the names of the best and the worst row; nulls never win, of equals the least name."""
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    g = rows.filter(ok).groupBy(group)
    return g.agg(
        F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best"), F.min_by(name, F.struct(score, name)).alias("worst"),
        F.min(score).alias("lowest"), F.max(score).alias("highest"),
    )


def suite_rows(results: DataFrame, name: str, json: str, paths: dict[str, str]) -> DataFrame:
    """(name, step, one DOUBLE for each path): nested results flattened; the step is the number the name ends with, null without."""
    cols = [F.get_json_object(json, p).try_cast("double").alias(c) for c, p in paths.items()]
    return results.select(name, F.regexp_extract(name, r"(\d+)$", 1).try_cast("long").alias("step"), *cols)


def flat_config(configs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, value): leaves of nested JSON objects by their own name; of equal names the last one in the text counts."""
    leaf = r'"([^"\\]+)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null)'
    names, values = (F.regexp_extract_all(json, F.lit(leaf), F.lit(i)) for i in (1, 2))
    ok = configs.filter(F.try_parse_json(json).isNotNull())
    p = ok.select(key, F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("at", "x"))
    return p.groupBy(key, F.col("x.n").alias("name")).agg(F.regexp_replace(F.max_by("x.v", "at"), r'^"|"$', "").alias("value"))


def scored_bytes(tokens: Column) -> Column:
    """UTF-8 bytes of the tokens from the second one on that is not empty: what a model without a begin mark is scored on."""
    real = F.filter(tokens, lambda t: t != "")
    return F.octet_length(F.array_join(F.slice(real, F.lit(2), F.greatest(F.size(real) - 1, F.lit(0))), ""))


def log_entries(logs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, step, loss, learning_rate) of a trainer's log_history that have all three, in order of place."""
    h = F.from_json(json, "struct<log_history:array<struct<step:long,loss:double,learning_rate:double>>>")
    e = logs.select(key, F.explode(h["log_history"]).alias("e"))
    return e.filter("e.step is not null and e.loss is not null and e.learning_rate is not null").select(key, "e.step", "e.loss", "e.learning_rate")


def epoch_windows(tokens: Column, length: int, epoch: Column, seed: int = 0) -> Column:
    """ARRAY<INT>: begins of the windows of length + 1 tokens of an epoch, whose offset and order depend on the epoch and the seed."""
    offset = F.pmod(F.xxhash64(F.lit(seed), epoch), F.lit(length)).cast("int")
    n = F.floor((F.size(tokens) - offset - 1) / length).cast("int")
    begins = F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: offset + i * length)).otherwise(F.array().cast("array<int>"))
    keyed = F.array_sort(F.transform(begins, lambda b: F.struct(F.xxhash64(F.lit(seed), epoch, b).alias("h"), b.alias("b"))))
    return F.transform(keyed, lambda x: x["b"])


def margins(records: DataFrame, category: str, good: str, bad: str) -> DataFrame:
    """(category, n, accuracy, mean_margin): of scores of the right and the wrong choice; category null for all."""
    m = F.col(good) - F.col(bad)
    ok = records.filter(m.isNotNull())
    return ok.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.avg((m > 0).cast("int")).alias("accuracy"), F.avg(m).alias("mean_margin"))


def shocks(pairs: DataFrame, key: str, trap: str, plain: str) -> DataFrame:
    """(n, mean_shock, least_shock, leaks, least_key): how much more a trap costs than its plain twin; a shock of 0 or less is a leak."""
    s = F.col(trap) - F.col(plain)
    d = pairs.withColumn("_s", s).filter("_s is not null")
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_s").alias("mean_shock"), F.min("_s").alias("least_shock"), F.count_if(F.col("_s") <= 0).alias("leaks"),
        F.min_by(key, F.struct("_s", key)).alias("least_key"),
    )


def ordered_checkpoints(runs: DataFrame, name: str) -> DataFrame:
    """runs with `place`: by the number their name ends with, others last, then by name."""
    from .ordinal import with_ordinal

    return with_ordinal(runs, trailing_number(F.col(name)), name, name="place", start=0)


def worse_than_before(runs: DataFrame, group: str, order: str, value: str, by: float) -> DataFrame:
    """Rows whose value is at least `by` above the best of the rows before, with that best as `before`."""
    d = running(runs, [group], [order], "_low", -F.col(value), "max", before=True)
    return d.withColumn("before", -F.col("_low")).drop("_low").filter(F.col(value) >= F.col("before") + by)
