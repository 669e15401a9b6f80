"""Choosing and grouping of records: first of each, demonstrations, pairs, buckets, lists by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import running


def matching_tokens(hay: Column, tokens: list[str]) -> Column:
    """Whether a text holds one of the tokens, without regard to case; no tokens match all."""
    if not tokens:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(hay), F.lit(t.lower())) for t in tokens])


def included(df: DataFrame, hay: Column, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows that hold a token of `include` (any row without such) and none of `exclude`."""
    keep = matching_tokens(hay, include)
    return df.filter(keep & ~matching_tokens(hay, exclude) if exclude else keep)


def only_labels(df: DataFrame, label: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted labels; an error names wanted labels that no row has."""
    named = df.select(label).distinct().filter(F.col(label).isin(wanted)).collect()  # one row a wanted label at most
    unknown = sorted(set(wanted) - {r[0] for r in named})
    if unknown:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    return df.filter(F.col(label).isin(wanted))


def first_of_group(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each group in order; a hot group's rows are spread."""
    return running(df, [group], [order], "_nth", F.lit(1)).filter(F.col("_nth") <= most).drop("_nth")


def top_counts(df: DataFrame, column: str, k: int = 25) -> DataFrame:
    """(column, n): the k most frequent values, of equals the least."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def before_after(before: DataFrame, after: DataFrame, column: str, generic: Column) -> DataFrame:
    """(stage, rows, distinct_values, generic_rows) of a column before and after a change."""
    one = lambda d, s: d.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(column).alias("distinct_values"), F.count_if(generic).alias("generic_rows")
    ).select(F.lit(s).alias("stage"), "*")
    return one(before, "before").unionByName(one(after, "after"))


def demonstrations(seeds: DataFrame, machine: DataFrame, key: str, k: int, most_machine: int, seed: int) -> DataFrame:
    """(key, origin, place): k demonstrations in a seeded order: at most `most_machine` of the machine's, the rest seeds."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    m = machine.orderBy(h, key).limit(most_machine).select(key, F.lit("machine").alias("origin"))
    s = seeds.orderBy(h, key).limit(k).select(key, F.lit("seed").alias("origin"))
    chosen = m.unionByName(s).withColumn("_m", (F.col("origin") == "seed").cast("int")).orderBy("_m", h, key).limit(k).drop("_m")
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), F.col(key)).alias("h"), F.col(key), F.col("origin"))))
    return chosen.agg(order.alias("x")).select(F.posexplode("x").alias("place", "x")).select(f"x.{key}", "x.origin", "place")  # k rows


def disjoint_pairs(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """(group, a, b): neighbours 2i and 2i + 1 in a seeded order of each group, `most` pairs at most; an odd one is left out."""
    h = df.select(group, key).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    n = running(h, [group], ["_h", key], "_nth", F.lit(1)).filter(F.col("_nth") <= 2 * most)
    pair = n.groupBy(group, F.floor((F.col("_nth") - 1) / 2).alias("_p")).agg(
        F.min_by(key, "_nth").alias("a"), F.max_by(key, "_nth").alias("b"), F.count(F.lit(1)).alias("_n")
    )
    return pair.filter("_n = 2").select(group, "a", "b")


def common_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The keys that two runs have in common, once each."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys))


def compared_runs(a: DataFrame, b: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(group, n, mean, over_999, over_9, under_5): similarity of two runs' texts by key; group null for all."""
    from .dialogue import sequence_ratio

    other = b.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    both = a.join(other, F.col(key) == F.col("_k")).withColumn("s", sequence_ratio(F.col(text), F.col("_t")))
    return both.rollup(group).agg(
        F.count("s").alias("n"), F.avg("s").alias("mean"), F.count_if(F.col("s") > 0.999).alias("over_999"),
        F.count_if(F.col("s") > 0.9).alias("over_9"), F.count_if(F.col("s") < 0.5).alias("under_5"),
    )


def unambiguous(df: DataFrame, key: Column, owner: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """(key, owner): keys of one owner only, all or the first `most` in a seeded order."""
    one = df.groupBy(key.alias("key")).agg(F.countDistinct(owner).alias("n"), F.min(owner).alias("owner")).filter("n = 1")
    return (one if most is None else one.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(most)).select("key", "owner")


def listable(df: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """(group, members): groups of at least so many different members."""
    return df.groupBy(group).agg(F.countDistinct(member).alias("members")).filter(F.col("members") >= least)


#: Edges of the report on shards; the first three are open above, the others closed.
WORD_BUCKETS = (("<300", 300), ("300-400", 400), ("400-450", 450), ("450-500", 500), ("500-550", 550), ("550-600", 600), ("600-700", 700), (">700", None))
OPEN_BUCKETS = 3


def word_bucket(words: Column) -> Column:
    """The bucket of a number of words."""
    out = F.lit(WORD_BUCKETS[-1][0])
    for i, (name, edge) in reversed(list(enumerate(WORD_BUCKETS[:-1]))):
        out = F.when(words < edge if i < OPEN_BUCKETS else words <= edge, name).otherwise(out)
    return F.when(words.isNotNull(), out)


def bucket_report(df: DataFrame, words: str) -> DataFrame:
    """(bucket, shards): every bucket, with 0 for empty ones."""
    every = df.sparkSession.createDataFrame([(n,) for n, _ in WORD_BUCKETS], "bucket string")
    n = df.groupBy(word_bucket(F.col(words)).alias("bucket")).agg(F.count(F.lit(1)).alias("shards"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("shards", F.lit(0)).alias("shards"))


def rubric(correct: Column, style: Column, manner: Column) -> Column:
    """Weighted rubric: three times the first, twice the second, once the third."""
    return correct * 3 + style * 2 + manner


def lists_by_group(df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """(group, members, said): each group's first `most` different members, sorted, as a list in words."""
    from ..functions.text import oxford

    one = df.filter(F.col(member).isNotNull() & F.col(group).isNotNull()).select(group, member).distinct()
    first = first_of_group(one, group, member, most)
    g = first.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))  # `most` at most
    return g.select(group, "members", oxford(F.col("members")).alias("said"))


def mixed(parts: dict[str, DataFrame], key: str, seed: int) -> DataFrame:
    """The rows of several parts (of equal columns), with their part's name, numbered in a seeded order."""
    from .ordinal import with_ordinal

    rows = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(n)) for n, d in parts.items()])
    return with_ordinal(rows, F.xxhash64(F.lit(seed), "part", key), "part", key, name="place", start=0)


def sequence_facts(spark, names: list[str]) -> DataFrame:
    """(item, before, after) of a cycle of names, such as the days of the week."""
    n = len(names)
    rows = [(x, names[(i - 1) % n], names[(i + 1) % n]) for i, x in enumerate(names)]
    return spark.createDataFrame(rows, "item string, before string, after string")


def verse_questions(verses: DataFrame, template: str, book: str = "book", chapter: str = "chapter", verse: str = "verse", text: str = "text") -> DataFrame:
    """(book, chapter, verse, question, answer): a question on each verse by a template with {ref}; verses without text are left out."""
    from ..functions.text import rendered

    ref = F.concat_ws(" ", F.col(book), F.concat_ws(":", F.col(chapter).cast("string"), F.col(verse).cast("string")))
    return verses.filter(F.trim(text) != "").select(book, chapter, verse, rendered(F.lit(template), ref=ref).alias("question"), F.col(text).alias("answer"))


def rewriting_pairs(rows: DataFrame, order: str, modern: str, old: str, prefixes: list[str]) -> DataFrame:
    """(order, user, assistant): the modern text behind one of the prefixes, in turn by place, and the old one; rows lacking a text are left out."""
    from .ordinal import with_ordinal

    ok = (F.trim(F.coalesce(F.col(modern), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(old), F.lit(""))) != "")
    o = with_ordinal(rows.filter(ok), order, name="_n", start=0)
    prefix = F.element_at(F.array(*[F.lit(p) for p in prefixes]), (F.col("_n") % len(prefixes) + 1).cast("int"))
    return o.select(order, F.concat(prefix, F.lit(' "'), F.col(modern), F.lit('"')).alias("user"), F.col(old).alias("assistant"))
