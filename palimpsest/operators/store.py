"""A keyed collection of documents: lookups, upserts, merges, changes and estimates.

A collection is a DataFrame with a string key `id`; every change gives a new DataFrame,
which the caller writes where it belongs. Nothing here gathers a key's rows: winners are
found by aggregates that combine on the map side, so a key may hold any share of the rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .ordinal import quantiles, running


def by_key(store: DataFrame, key: str) -> DataFrame:
    """The records of one key."""
    return store.filter(F.col("id") == key)


def by_keys(store: DataFrame, keys: list[str] | DataFrame) -> DataFrame:
    """The records of a list of keys, or of a table's column id."""
    if isinstance(keys, DataFrame):
        return store.join(keys.select("id"), "id", "left_semi")
    wanted = store.sparkSession.createDataFrame([(k,) for k in sorted(set(keys))], "id string")
    return store.join(wanted, "id", "left_semi")


def navigate(store: DataFrame, key: str, to: str) -> DataFrame:
    """One record next to a key: first, last, next, prev, next10, prev10, or random.

    next10 is the tenth after the key, or the last of fewer. random takes `key` as a random
    key: the first record at or after it, or else the very first.
    """
    c = F.col("id")
    if to == "first":
        return store.orderBy(c).limit(1)
    if to == "last":
        return store.orderBy(c.desc()).limit(1)
    if to in ("next", "next10"):
        n = 10 if to == "next10" else 1
        return store.filter(c > key).orderBy(c).limit(n).orderBy(c.desc()).limit(1)
    if to in ("prev", "prev10"):
        n = 10 if to == "prev10" else 1
        return store.filter(c < key).orderBy(c.desc()).limit(n).orderBy(c).limit(1)
    if to == "random":
        after = store.filter(c >= key).orderBy(c).limit(1).withColumn("_o", F.lit(0))
        first = store.orderBy(c).limit(1).withColumn("_o", F.lit(1))
        return after.unionByName(first).orderBy("_o").limit(1).drop("_o")
    raise ValueError(to)


def estimate_count(store: DataFrame) -> DataFrame:
    """(estimate, exact): rows estimated from those whose key begins with 000, 00 or 0.

    The longest prefix with at least 100 rows is scaled up; without one the count is exact.
    """
    n = [F.count_if(F.col("id").startswith("0" * k)) for k in (3, 2, 1)]
    c = store.agg(n[0].alias("c3"), n[1].alias("c2"), n[2].alias("c1"), F.count(F.lit(1)).alias("n"))
    est = (
        F.when(F.col("c3") >= 100, F.col("c3") * 4096)
        .when(F.col("c2") >= 100, F.col("c2") * 256)
        .when(F.col("c1") >= 100, F.col("c1") * 16)
        .otherwise(F.col("n"))
    )
    return c.select(est.alias("estimate"), F.col("n").alias("exact"))


def upsert(store: DataFrame, batch: DataFrame, seq: str = "seq", weak_source: str = "cli") -> DataFrame:
    """The store with a batch taken in, as if row by row in the order of `seq`.

    The better conflict score wins and the later of equals, but a repeated text keeps its
    first record. A record of the weak source takes another source of its key. Both sides
    need id, text, source, the metrics and seq, which is unique on each side; the store's rows
    count as earlier. Winners are decided on hashes of the texts, so whole rows are moved once.
    """
    rows = store.withColumn("_late", F.lit(0)).unionByName(batch.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    slim = rows.select(
        "id", F.xxhash64("text").alias("h"), F.struct("_late", F.col(seq).alias("_seq")).alias("at"), M.conflict_score().alias("score"),
        F.when(~F.col("source").eqNullSafe(weak_source), F.col("source")).alias("strong"),
    )
    first = slim.groupBy("id", "h").agg(
        F.min("at").alias("at"), F.max("score").alias("score"),
        F.min(F.when(F.col("strong").isNotNull(), F.struct("at", "strong"))).alias("strong"),
    )
    best = first.groupBy("id").agg(F.max(F.struct("score", "at"))["at"].alias("at"), F.min("strong").alias("strong"))
    win = best.select(F.col("id").alias("_id"), "at._late", "at._seq", F.col("strong.strong").alias("_strong")).withColumnRenamed("_late", "_when")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_late") == F.col("_when")) & F.col(seq).eqNullSafe(F.col("_seq"))
    kept = rows.join(win, on)
    source = F.when(F.col("source").eqNullSafe(weak_source), F.coalesce("_strong", "source")).otherwise(F.col("source"))
    return kept.withColumn("source", source).drop("_strong", "_late", "_when", "_id", "_seq")


def merge_best(rows: DataFrame, rank: str, seq: str, score: Column | None = None) -> DataFrame:
    """One record per id of several collections: the best score, of equals the lowest rank, then seq.

    rank 0 is the target; others are the sources in their order. seq is unique within a rank.
    Winners are decided without the texts, so whole rows are moved once.
    """
    s = M.global_score() if score is None else score
    better = F.struct(s.alias("s"), (-F.col(rank)).alias("r"), (-F.col(seq)).alias("q"))
    best = rows.groupBy("id").agg(F.max(better).alias("_b")).select(
        F.col("id").alias("_id"), (-F.col("_b")["r"]).alias("_rank"), (-F.col("_b")["q"]).alias("_seq")
    )
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col(rank) == F.col("_rank")) & (F.col(seq) == F.col("_seq"))
    return rows.join(best, on).drop("_id", "_rank", "_seq")


def merge_report(rows: DataFrame, rank: str, score: Column | None = None) -> DataFrame:
    """(rank, scanned, collapsed, new, replaced, kept) of each source merged in order of rank.

    First the best score of a key in each collection, which combines on the map side; the
    running best over a key's collections then has as many rows as there are collections.
    """
    s = M.global_score() if score is None else score
    per = rows.groupBy("id", rank).agg(F.max(s).alias("s"), F.count(F.lit(1)).alias("n"))
    before = F.max("s").over(W.partitionBy("id").orderBy(rank).rowsBetween(W.unboundedPreceding, -1))
    out = per.withColumn("before", before)
    return (
        out.groupBy(rank)
        .agg(
            F.sum("n").alias("scanned"),
            F.sum(F.col("n") - 1).alias("collapsed"),
            F.count_if(F.col("before").isNull()).alias("new"),
            F.count_if(F.col("s") > F.col("before")).alias("replaced"),
            F.count_if(F.col("s") <= F.col("before")).alias("kept"),
        )
    )


def delete_where(store: DataFrame, condition: Column, limit: int | None = 100, dry: bool = False) -> DataFrame:
    """The store without the first `limit` matches in key order (all of them for None); a dry run
    gives the matching records instead."""
    hit = store.filter(condition).select("id")
    if limit is not None:
        hit = hit.distinct().orderBy("id").limit(limit)
    return store.join(hit.distinct(), "id", "left_semi" if dry else "left_anti")


def delete_key(store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(store without a key, where to go from there: the next key, else the one before, null in an empty store)."""
    near = store.agg(
        F.min(F.when(F.col("id") > key, F.col("id"))).alias("after"), F.max(F.when(F.col("id") < key, F.col("id"))).alias("before"),
        F.count_if(F.col("id") == key).alias("deleted"),
    )
    return store.filter(~F.col("id").eqNullSafe(key)), near.select(F.coalesce("after", "before").alias("id"), "deleted")


def edit_text(store: DataFrame, key: str, text: str, vocab: DataFrame | None = None) -> DataFrame:
    """The store with one record's text replaced: new key and metrics, extra dropped.

    If the new key is another record's, the store comes back unchanged. dicthit is computed
    from the vocabulary, and null without one.
    """
    new = T.content_id(F.lit(text))
    old = store.filter(F.col("id") == key)
    clash = store.join(old.limit(1).select(new.alias("id")), "id", "left_semi").filter(F.col("id") != key)
    t = F.col("text")
    made = (
        old.limit(1)
        .join(clash.select(F.lit(1).alias("_c")).limit(1), how="left")
        .filter("_c is null")
        .drop("_c")
        .withColumn("text", F.lit(text))
    )
    values = {
        "id": new, "len": F.length(T.normalized(t)), "tokens": F.greatest(F.lit(1), F.size(T.store_tokens(t))),
        "uniqchar": F.size(F.array_distinct(T.characters(T.normalized(t)))),
        "sentences": T.sentence_count(t), "quality": F.round(M.quality(t), 2), "entropy": F.round(M.entropy(t), 2),
        "compress": F.round(M.compress(t), 2), "alpha": F.round(M.alpha_share(t), 2),
        "vowel": F.round(M.vowel_share(t), 2), "ascii": F.round(M.ascii_share(t), 2),
        "dicthit": F.lit(None), "extra": F.lit(None),
    }
    if vocab is not None:
        one = store.sparkSession.createDataFrame([(0, text)], "k int, text string")
        share = M.dict_hits(one, "k", vocab).select("dict_hit").collect()
        values["dicthit"] = F.lit(round(share[0].dict_hit, 2) if share else 0.0)
    for c, v in values.items():
        if c in store.columns:
            made = made.withColumn(c, v.cast(store.schema[c].dataType))
    made = made.withColumn("_from", F.lit(key))
    replaced = store.join(made.select(F.col("_from").alias("id")), "id", "left_anti")
    return replaced.unionByName(made.drop("_from"))


def rename_sources(store: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The store with sources renamed by an exact mapping; others stay."""
    if not mapping:
        return store
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return store.withColumn("source", F.coalesce(F.element_at(m, F.col("source")), F.col("source")))


def set_source(store: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(store with one source for all, (changed, total))."""
    report = store.agg(
        F.count_if(~F.col("source").eqNullSafe(value)).alias("changed"), F.count(F.lit(1)).alias("total")
    )
    return store.withColumn("source", F.lit(value)), report


def compact(store: DataFrame, partitions: int) -> DataFrame:
    """The store in key ranges, sorted, for writing."""
    return store.repartitionByRange(partitions, "id").sortWithinPartitions("id")


def store_info(store: DataFrame) -> DataFrame:
    """(first_id, last_id, records)."""
    return store.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("records"))


_TOKENS = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|===|!==|==|!=|&&|\|\||!|\?\?|[^'\"=!&|?]+|.")


def expression(text: str) -> Column:
    """A filter in script spelling (doc.len > 100 && !(doc.source === 'x')) as a Column.

    Comparison, logic, arithmetic, ?., ??, .length, .includes, .startsWith, .endsWith and
    .toLowerCase() are understood; anything SQL understands passes as it is.
    """
    out = []
    for t in _TOKENS.findall(text):
        if t[:1] in "'\"":
            out.append("'" + t[1:-1].replace('\\"', '"').replace("\\'", "'").replace("'", "''") + "'")
            continue
        t = {"===": "=", "==": "=", "!==": "<>", "!=": "<>", "&&": " AND ", "||": " OR ", "!": " NOT "}.get(t, t)
        t = re.sub(r"\bdoc\??\.", "", t)
        t = re.sub(r"\bnull\b|\bundefined\b", "NULL", t)
        out.append(t)
    sql = "".join(out)
    sql = re.sub(r"(=|<>)\s*NULL", lambda m: " IS NULL" if m[1] == "=" else " IS NOT NULL", sql)
    sql = re.sub(r"(\w+)\.length\b", r"length(\1)", sql)
    for js, fn in (("includes", "contains"), ("startsWith", "startswith"), ("endsWith", "endswith")):
        sql = re.sub(rf"(\w+)\.{js}\(", rf"{fn}(\1, ", sql)
    sql = re.sub(r"(\w+)\.toLowerCase\(\)", r"lower(\1)", sql)
    while "??" in sql:
        sql = re.sub(r"(\w+)\s*\?\?\s*('[^']*'|[\w.-]+)", r"coalesce(\1, \2)", sql, count=1)
    return F.expr(sql)


def select_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in the order asked for; unknown names are skipped."""
    known = {c.lower(): c for c in df.columns}
    return df.select(*[known[n.lower()] for n in dict.fromkeys(names) if n.lower() in known])


def matching(df: DataFrame, condition: Column) -> DataFrame:
    """(matched, total, pct) of a condition; null is no match."""
    hit = F.count_if(F.coalesce(condition, F.lit(False)))
    n = F.count(F.lit(1))
    return df.agg(hit.alias("matched"), n.alias("total"), F.round(hit * 100.0 / F.nullif(n, F.lit(0)), 3).alias("pct"))


def metric_summary(df: DataFrame, metrics: list[str], exact: bool = True) -> DataFrame:
    """(metric, mean, min, p5, p95, max) with null and NaN as 0.

    Exact percentiles interpolate, from counts of equal values that are spread over tasks;
    without `exact` they come from sketches of bounded size.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), M.number(F.col(m).cast("double")).alias("x")) for m in metrics])
    rows = df.select(F.explode(pairs).alias("p")).select("p.metric", "p.x")
    ends = [F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")]
    if exact:
        per = rows.groupBy("metric").agg(*ends).join(quantiles(rows, "metric", "x", {"p5": 0.05, "p95": 0.95}), "metric")
        return per.select("metric", "mean", "min", "p5", "p95", "max")
    q = lambda p: F.percentile_approx("x", p, 10000)
    return rows.groupBy("metric").agg(ends[0], ends[1], q(0.05).alias("p5"), q(0.95).alias("p95"), ends[2])


def ingest_report(rows: DataFrame, file: str, order: str, offset: int = 0, limit: int | None = None, text: str = "text", key: str = "id") -> DataFrame:
    """(file, loaded, dropped, skipped, limited, duplicate, indexed) of an import of files.

    Of each file the first `offset` rows are skipped; of the others those that the ingest filter
    refuses are dropped, and fit ones beyond `limit` not taken; of taken rows of one key all but
    the first, by file and order, are duplicates. A file of any size is spread.
    """
    n = running(rows.withColumn("_fit", M.prefilter(F.col(text))), [file], [order], "_n", F.lit(1))
    late = F.col("_n") > offset
    k = running(n.drop(text), [file], [order], "_k", (late & F.col("_fit")).cast("int"))
    limited = F.lit(False) if limit is None else F.col("_k") > limit
    what = F.when(~late, "skipped").when(~F.col("_fit"), "dropped").when(limited, "limited").otherwise("taken")
    d = k.select(file, order, key, what.alias("what"))
    taken = d.filter("what = 'taken'")
    # the first of each key is indexed
    first = taken.groupBy(key).agg(F.min(F.struct(file, order))[file].alias("_f"))
    indexed = first.groupBy(F.col("_f").alias("_file")).agg(F.count(F.lit(1)).alias("indexed"))
    c = d.groupBy(file).agg(
        F.count(F.lit(1)).alias("loaded"), *[F.count_if(F.col("what") == w).alias(w) for w in ("dropped", "skipped", "limited")],
        F.count_if(F.col("what") == "taken").alias("_taken"),
    )
    out = c.join(indexed, F.col(file).eqNullSafe(F.col("_file")), "left").withColumn("indexed", F.coalesce("indexed", F.lit(0)))
    return out.select(file, "loaded", "dropped", "skipped", "limited", (F.col("_taken") - F.col("indexed")).alias("duplicate"), "indexed")


def mapped(store: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(store with columns set to new values, (changed, total)): a null value leaves the record's own."""
    new = {c: F.coalesce(v.cast(store.schema[c].dataType), F.col(c)) for c, v in values.items()}
    other = reduce(lambda a, b: a | b, [~n.eqNullSafe(F.col(c)) for c, n in new.items()], F.lit(False))
    return store.withColumns(new), store.agg(F.count_if(other).alias("changed"), F.count(F.lit(1)).alias("total"))
