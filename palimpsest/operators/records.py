"""Records of titles, tasks and prompts: ties, ordered dedup, indexes, samples, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import staged


def best_with_ties(df: DataFrame, group: str, score: str) -> DataFrame:
    """The rows of each group that share its highest score; null scores never win."""
    top = df.groupBy(group).agg(F.max(score).alias("_top"))
    return df.join(top, group).filter(F.col(score) == F.col("_top")).drop("_top")


def ordered_distinct(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each key, the first in order; rows of a null key are one group."""
    d = df.withColumn("_k", key)
    row = F.struct(*[F.col(c) for c in df.columns])
    return d.groupBy("_k").agg(F.min_by(row, order).alias("_r")).select("_r.*")


def title_key(title: Column) -> Column:
    """A title without subtitle, case and outer blanks."""
    return F.lower(F.trim(F.regexp_extract(title, r"^([^:;]*)", 1)))


def plausible_title(title: Column) -> Column:
    """3 to 60 characters, beginning with no small letter, and no front or back matter."""
    n = F.length(title)
    matter = title.rlike(r"(?i)\b(index|contents|preface|introduction|appendix|chapter|volume|page|illustrated by|edition)\b")
    return F.coalesce((n >= 3) & (n <= 60) & ~title.rlike("^[a-zà-ÿ]") & ~matter, F.lit(False))


def owners(df: DataFrame, key: Column, owner: str) -> DataFrame:
    """(key, owners, n): who has each key, sorted; a set per key combines on the map side."""
    return df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(owner)).alias("owners")).withColumn("n", F.size("owners"))


def years_alive(df: DataFrame, year: int, birth: str = "birth", death: str = "death") -> DataFrame:
    """Rows whose life covers a year; an open end covers it."""
    return df.filter((F.col(birth) <= year) & (F.coalesce(F.col(death), F.lit(year)) >= year))


def centuries_of(df: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each century between two years."""
    c = lambda y: F.floor((F.col(y) - 1) / 100).cast("int") + 1
    return df.filter(F.col(first) <= F.col(last)).withColumn("century", F.explode(F.sequence(c(first), c(last))))


def seeded_order(key: Column, seed: int) -> Column:
    """An order that depends on the seed and the key only."""
    return F.xxhash64(F.lit(seed), key)


def few_shot(items: DataFrame, key: str, k: int, pool: int | None = None, seed: int = 1234) -> DataFrame:
    """(key, shots): k other items for each, drawn by a hash from all items; fewer if there are not so many.

    Items are numbered in an order that depends on the seed. Each draws places by a hash of its
    key and the draw's number, without its own, then the places after the first drawn; the
    drawn places are joined to the items that hold them. `pool` bounds the places to the
    first ones. Keys must be unique; a null key draws and is drawn like any other.
    """
    from .ordinal import with_ordinal

    o = staged(with_ordinal(items.select(key), seeded_order(F.col(key), seed), name="_at", start=0), "shots")
    n = o.count() if pool is None else min(pool, o.count())
    if n < 2 or k < 1:
        return items.select(key, F.array().cast(ArrayType(items.schema[key].dataType)).alias("shots"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(4 * k)), lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col(key), j), F.lit(n)))
    after = F.transform(F.sequence(F.lit(1), F.lit(min(k + 1, n))), lambda j: F.pmod(draws[0] + j, F.lit(n)))
    places = F.slice(F.filter(F.array_distinct(F.concat(draws, after)), lambda p: p != F.col("_at")), 1, k)
    drawn = o.select(F.col("_at").alias("_by"), F.posexplode(places).alias("_j", "_at"))
    held = drawn.join(o.select("_at", F.col(key).alias("_o")), "_at").groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("_j", "_o"))).alias("_s"))
    return o.join(held, o["_at"] == held["_by"], "left").select(
        key, F.coalesce(F.transform("_s", lambda x: x["_o"]), F.array().cast(ArrayType(items.schema[key].dataType))).alias("shots")
    )


def choice_prompt(question: Column, choices: Column) -> Column:
    """A question with lettered choices and a cue for the answer."""
    lines = F.transform(choices, lambda c, i: F.concat(F.chr((i + 65).cast("long")), F.lit(". "), c))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def completion_prompt(context: Column, delimiter: str = " ") -> Column:
    """A context to be continued, without blanks at its end."""
    return F.concat(F.rtrim(context), F.lit(delimiter.rstrip(" ")))


def schema_prompts(options: Column, continuation: Column, delimiter: str = " ") -> Column:
    """Every context option with the same continuation."""
    return F.transform(options, lambda o: F.concat(F.rtrim(o), F.lit(delimiter), continuation))


def reference_parts(text: Column) -> Column:
    """STRUCT<book, chapter, first, last> of 'Book c:v' or 'Book c:v-v2'; null without one."""
    p = r"^\s*(.+?)\s+(\d{1,3}):(\d{1,3})(?:-(\d{1,3}))?\s*[.?]?\s*$"
    g = lambda i: F.regexp_extract(text, p, i)
    first = g(3).try_cast("int")
    return F.when(
        g(1) != "",
        F.struct(g(1).alias("book"), g(2).try_cast("int").alias("chapter"), first.alias("first"), F.coalesce(g(4).try_cast("int"), first).alias("last")),
    )


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: the name of the first rule that holds; null for rows that pass all."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def benchmark_bundle(spark: SparkSession, meta_csv: str, items_json: str, label: str = "label") -> DataFrame:
    """Task items (JSON lines with a task label) beside the tasks' metadata; a missing baseline is 0."""
    meta = spark.read.option("header", True).csv(meta_csv)
    items = spark.read.json(items_json)
    base = [c for c in meta.columns if c.lower() in ("random baseline", "baseline")]
    m = meta.withColumn("baseline", F.coalesce(F.col(f"`{base[0]}`").try_cast("double") if base else F.lit(None).cast("double"), F.lit(0.0)))
    return items.join(m, label, "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
