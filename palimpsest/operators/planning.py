"""Planning of tasks: products, resuming, rendering, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import running, with_ordinal


#: Templates, a stated set, of one plan.
TEMPLATE_LIMIT = 10_000


def plan_tasks(items: DataFrame, templates: DataFrame, done: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Every item with every template, less what is done (null-safe on the keys).

    Templates are a stated set, broadcast; more than TEMPLATE_LIMIT are an error.
    """
    if templates.limit(TEMPLATE_LIMIT + 1).count() > TEMPLATE_LIMIT:
        raise ValueError(f"more than {TEMPLATE_LIMIT} templates must be given in blocks")
    t = items.crossJoin(F.broadcast(templates))
    if done is None:
        return t
    d = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_d_{k}"))
        on = c if on is None else on & c
    return t.join(d, on, "left_anti")


def round_robin(rows: DataFrame, order: str, n: int, name: str = "slot") -> DataFrame:
    """rows with a slot 0..n-1 by their place in the order."""
    return with_ordinal(rows, order, name="_o", start=0).withColumn(name, (F.col("_o") % n).cast("int")).drop("_o")


def hash_sample(df: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """n rows of the least hashes of the key: the same rows however they lie."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def arithmetic(spark, low: int = -2, high: int = 12) -> DataFrame:
    """(a, op, b, answer): the four operations over a grid, without division by 0, rounded to 3 places."""
    a = spark.range(low, high + 1).select(F.col("id").cast("int").alias("a"))
    b = spark.range(low, high + 1).select(F.col("id").cast("int").alias("b"))
    ops = spark.createDataFrame([("+",), ("-",), ("*",), ("/",)], "op string")
    g = a.crossJoin(b).crossJoin(ops).filter("op <> '/' or b <> 0")
    x = (
        F.when(F.col("op") == "+", (F.col("a") + F.col("b")).cast("double"))
        .when(F.col("op") == "-", (F.col("a") - F.col("b")).cast("double"))
        .when(F.col("op") == "*", (F.col("a") * F.col("b")).cast("double"))
        .otherwise(F.col("a") / F.nullif(F.col("b"), F.lit(0)))
    )
    return g.select("a", "op", "b", (F.round(x, 3) + 0.0).alias("answer"))


def changes(rows: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """Rows that differ in any of the columns from the one before; the first counts as a change."""
    s = F.struct(*cols)
    return running(rows, [group], [order], "_p", s, "last", before=True).filter(~F.col("_p").eqNullSafe(s)).drop("_p")


def drift(rows: DataFrame, group: str, order: str, value: str, step: float = 0.2) -> DataFrame:
    """(group, first, last, drift): rising, falling or steady between the first and last value."""
    g = rows.groupBy(group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    d = F.col("last") - F.col("first")
    return g.withColumn("drift", F.when(d > step, "rising").when(d < -step, "falling").otherwise("steady"))


def loss_alarm(loss: Column, step: Column) -> Column:
    """Whether a loss is NaN, infinite, or 0 after the first step."""
    return F.isnan(loss) | (F.abs(loss) == float("inf")) | ((loss == 0) & (step > 1))
