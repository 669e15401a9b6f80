"""Global running numbers and sums without gathering all rows, or a hot group's rows, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

#: monotonically_increasing_id holds the place within a partition in its lower bits.
_PLACE = (1 << 33) - 1
#: Rows of a group that one task may run a window over.
GROUP_LIMIT = 1_000_000


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal", start: int = 1) -> DataFrame:
    """df with the place of each row in the given order, counted from `start`.

    Rows are range-partitioned and sorted once and numbered as they lie; the partitions' sizes
    (one number each) give the offsets. Ties take any order.
    """
    sort = list(order)
    parts = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    parts = staged(parts.withColumn("_id", F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(_PLACE))
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, total = [], start
    for p, n in sizes:
        rows.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _offset long")
    numbered = parts.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (place + F.col("_offset")).cast("long")).drop("_part", "_id", "_offset")


def has_hot_group(df: DataFrame, group: list[str]) -> bool:
    """Whether a group has more rows than one task may run a window over."""
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n")).first()["n"]
    return (largest or 0) > GROUP_LIMIT


def running(
    df: DataFrame, group: list[str], order: list[str], name: str, value: Column, how: str = "sum", before: bool = False, hot: bool | None = None
) -> DataFrame:
    """df with `name`: the sum or maximum of `value` over the rows of a group up to each row, or its last value.

    `before` leaves the row itself out (so that the last value is that of the row before); the
    result is null where nothing comes before. The largest group is counted first: if it has at
    most GROUP_LIMIT rows, each group is one task's window. Else rows are range-partitioned by
    group and order, so a group of any size is spread; within a partition a window runs over
    each group, and what a group carries on from the partitions before is computed from one row for
    each partition that begins or ends within a group. Order must be total within a group, or
    rows of equal order lie anyhow. `hot` tells what is known of the groups already.
    """
    f = {"sum": F.sum, "max": F.max, "last": F.last}[how]
    if not (has_hot_group(df, group) if hot is None else hot):
        w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
        if how == "last":
            return df.withColumn(name, F.last(F.struct(value.alias("x"))).over(w)["x"])
        return df.withColumn(name, f(value).over(w))
    keys = [*group, *order]
    parts = df.withColumn("_v", F.struct(value.alias("x")) if how == "last" else value).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = staged(parts.withColumn("_part", F.spark_partition_id()), "running")
    ends = parts.groupBy("_part").agg(F.min(F.struct(*group)).alias("low"), F.max(F.struct(*group)).alias("high"))
    # only the first and the last group of a partition can go on in others
    g = F.struct(*group)
    cut = parts.join(F.broadcast(ends), "_part").filter((g.eqNullSafe(F.col("low"))) | (g.eqNullSafe(F.col("high"))))
    whole = F.max_by("_v", F.struct(*order)) if how == "last" else f("_v")
    sums = cut.groupBy("_part", *group).agg(whole.alias("_s"))
    w = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.withColumn("_c", f("_s").over(w)).filter("_c is not null").drop("_s")
    for c in group:
        carried = carried.withColumnRenamed(c, f"_g_{c}")
    inside = f("_v").over(W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0))
    d = parts.withColumn("_in", inside)
    on = d["_part"] == carried["_part"]
    for c in group:
        on = on & d[c].eqNullSafe(carried[f"_g_{c}"])
    d = d.join(F.broadcast(carried), on, "left")
    if how == "last":
        return d.withColumn(name, F.coalesce("_in", "_c")["x"]).select(*df.columns, name)
    both = F.when(F.col("_c").isNull(), F.col("_in")).when(F.col("_in").isNull(), F.col("_c"))
    both = both.otherwise(F.col("_c") + F.col("_in") if how == "sum" else F.greatest("_c", "_in"))
    return d.withColumn(name, both).select(*df.columns, name)


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """(group, one column a share): exact quantiles of a group's values, nulls left out.

    Interpolated linearly between the two neighbouring ranks, or the value at the index
    int(n * share). Equal values are counted first; the running counts of a group's distinct
    values are spread over tasks, whatever share of the data one group holds.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_q_n"))
    cum = running(per, [group], [value], "_q_cum", F.col("_q_n"))
    total = cum.groupBy(group).agg(F.max("_q_cum").alias("_q_all"))
    c = cum.join(total.withColumnRenamed(group, "_q_g"), F.col(group).eqNullSafe(F.col("_q_g"))).drop("_q_g")
    aggs, out = [], []
    for name, q in shares.items():
        at = F.least(F.floor(F.col("_q_all") * q), F.col("_q_all") - 1) if nearest else (F.col("_q_all") - 1) * q
        low, high = F.floor(at), F.ceil(at)
        # the first value whose running count passes a rank holds it
        aggs += [F.min(F.when(F.col("_q_cum") > low, F.col(value))).alias(f"_l_{name}"), F.min(F.when(F.col("_q_cum") > high, F.col(value))).alias(f"_h_{name}")]
        aggs.append(F.max(at - low).alias(f"_w_{name}"))
        mixed = F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * F.col(f"_w_{name}")
        out.append((F.col(f"_l_{name}") if nearest else mixed).alias(name))
    return c.groupBy(group).agg(*aggs).select(group, *out)
