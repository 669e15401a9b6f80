"""Accepting texts in order, each unless it is too like one accepted before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .evals import rouge_l


def first_of(df: DataFrame, order: str, *key: Column) -> DataFrame:
    """One row for each value of the key columns, the first in order; winners are decided without the other columns."""
    best = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(order).alias("_o"))
    on = F.col(order).eqNullSafe(F.col("_o"))
    for i, k in enumerate(key):
        on = on & k.eqNullSafe(F.col(f"_k{i}"))
    return df.join(best, on).select(*df.columns)


def similar_pairs(docs: DataFrame, order: str, tokens: str, least: float) -> DataFrame:
    """(a, b), a < b by order: pairs of token arrays with a ROUGE-L F of at least `least`.

    A common subsequence is at most as long as the tokens in common, so a pair needs a Dice
    share of `least` in common tokens. Tokens are numbered (the second 'the' is another one) and
    sorted by rarity; such a pair shares one within the first n - ceil(n * least / (2 - least)) + 1 of
    each side, so only those are joined. Candidates are verified by ROUGE-L.
    """
    numbered = docs.select(F.col(order).alias("id"), F.posexplode(tokens).alias("p", "t"))
    from .ordinal import running

    n_th = running(numbered, ["id", "t"], ["p"], "n", F.lit(1)).select("id", F.concat_ws("#", "t", F.col("n").cast("string")).alias("t"))
    n_th = staged(n_th, "numbered-tokens")
    often = n_th.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    ranked = n_th.join(often, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("s"))
    n = F.size("s")
    prefix = F.slice("s", F.lit(1), n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1)
    rare = staged(ranked.select("id", n.alias("n"), F.explode(F.transform(prefix, lambda x: x["t"])).alias("t")), "rare-tokens")
    left, right = rare.toDF("a", "na", "t"), rare.toDF("b", "nb", "t")
    # lengths that no such pair can have are left out before the distinct
    fit = (F.col("a") < F.col("b")) & (2 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")) - 1e-9)
    cand = left.join(right, "t").filter(fit).select("a", "b").distinct()
    x = docs.select(F.col(order).alias("a"), F.col(tokens).alias("x"))
    y = docs.select(F.col(order).alias("b"), F.col(tokens).alias("y"))
    both = cand.join(x, "a").join(y, "b")
    return both.withColumn("r", rouge_l(F.col("x"), F.col("y"))).filter(F.col("r") >= least).select("a", "b")


def novel(df: DataFrame, order: str, tokens: str, least: float = 0.7) -> DataFrame:
    """The rows that are accepted in order: each whose ROUGE-L F to every row accepted before is under `least`.

    `order` is unique. Equal token arrays are one, the first; rows without tokens are accepted.
    The accepted rows are found in rounds over the pairs: a row with no earlier similar row left
    is accepted and its later ones are not; so many rounds as the longest chain takes.
    """
    d = staged(df, "novelty")
    some = d.filter(F.size(tokens) > 0)
    one = staged(some.groupBy(F.col(tokens).alias("w")).agg(F.min(order).alias("o")), "novelty-distinct")
    edges = staged(similar_pairs(one, "o", "w", least), "novelty-pairs")
    out = edges.select(F.col("b").alias("o")).limit(0)
    while not edges.isEmpty():
        roots = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = staged(edges.join(roots, "a").select(F.col("b").alias("o")).distinct(), "novelty-gone")
        out = out.unionByName(gone)
        for end in ("a", "b"):
            edges = edges.join(gone.select(F.col("o").alias(end)), end, "left_anti")
        edges = staged(edges.select("a", "b"), "novelty-pairs")
    kept = one.select("o").join(out, "o", "left_anti").unionByName(d.filter(F.col(tokens).isNull() | (F.size(tokens) == 0)).select(F.col(order).alias("o")))
    return d.join(kept.withColumnRenamed("o", "_o"), F.col(order) == F.col("_o"), "left_semi")
