"""Dialogue lines: coalescing turns, overlapping spans, offsets and speakers' names."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordinal import has_hot_group, running


def coalesce_turns(
    lines: DataFrame, group: str, speaker: str, pos: str, end: str, text: str, gap: int = 500, sep: str = " "
) -> DataFrame:
    """(group, island, speaker, pos, n, text): neighbouring lines of one known speaker joined.

    A line goes on the one before it if the speaker is the same and the gap is at most `gap`.
    """
    last = F.struct(F.col(speaker).alias("who"), F.col(end).alias("end"))
    hot = has_hot_group(lines, [group])
    d = running(lines, [group], [pos], "_last", last, "last", before=True, hot=hot)
    same = (F.col("_last")["who"] == F.col(speaker)) & ~T.is_unknown_speaker(F.col(speaker))
    d = d.withColumn("_new", F.when(same & (F.col(pos) - F.col("_last")["end"] <= gap), 0).otherwise(1))
    d = running(d, [group], [pos], "island", F.col("_new"), hot=hot)
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    joined = F.aggregate(F.transform(rows, lambda r: r["t"]), F.lit(""), lambda acc, x: T.join_turns(acc, x, sep))
    return d.groupBy(group, "island").agg(
        F.first(speaker).alias(speaker), F.min(pos).alias(pos), F.count(F.lit(1)).alias("n"), joined.alias(text)
    )


def overlap_islands(spans: DataFrame, group: str, start: str, end: str, tie: str, slack: int = 1) -> DataFrame:
    """spans with `island`: a span joins those before it if it begins at most `slack` past their furthest end."""
    order = [start, end, tie]
    hot = has_hot_group(spans, [group])
    d = running(spans, [group], order, "_far", F.col(end), "max", before=True, hot=hot)
    d = d.withColumn("_new", F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far") + slack), 1).otherwise(0))
    return running(d, [group], order, "island", F.col("_new"), hot=hot).drop("_new", "_far")


def interval_join(left: DataFrame, right: DataFrame, start: str, end: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping half-open intervals (l.start < r.end and r.start < l.end).

    Intervals are cut into buckets of `width`; a pair is kept in the bucket where the later of
    the two begins, so it comes once. Columns of the right get the prefix r_. Empty and null
    intervals overlap nothing.
    """
    keys = keys or []

    def cut(df: DataFrame) -> DataFrame:
        d = df.filter(F.col(start) < F.col(end))
        return d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))

    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    rc = r.filter(F.col(f"r_{start}") < F.col(f"r_{end}")).withColumn(
        "_rb", F.explode(F.sequence(F.floor(F.col(f"r_{start}") / width), F.floor((F.col(f"r_{end}") - 1) / width)))
    )
    on = (F.col("_b") == F.col("_rb")) & (F.col(start) < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(end))
    on = on & (F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / width) == F.col("_b"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return cut(left).join(rc, on).drop("_b", "_rb")


def global_offsets(lines: DataFrame, book: str, chunk: str, length: str) -> DataFrame:
    """lines with `offset`: the lengths of the book's chunks before."""
    return running(lines, [book], [chunk], "offset", F.col(length), before=True).withColumn("offset", F.coalesce("offset", F.lit(0)))


def common_casing(names: DataFrame, name: str, order: str) -> DataFrame:
    """(folded, name): the most frequent spelling of each name without case; of equals the first seen."""
    per = names.groupBy(F.lower(name).alias("folded"), F.col(name).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    return per.groupBy("folded").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))


def canonical_names(lines: DataFrame, name: str, chunk: str, per_chunk: DataFrame, overall: DataFrame, casing: DataFrame) -> DataFrame:
    """lines with `canonical`: the chunk's alias, else the overall one, else the common casing, else the name.

    per_chunk is (chunk, folded, canonical), overall and casing (folded, ...). The alias
    tables are joined; Spark broadcasts them while they are small.
    """
    d = lines.withColumn("_f", F.lower(name))
    d = d.join(per_chunk.select(F.col(chunk).alias("_c"), F.col("folded").alias("_f1"), F.col("canonical").alias("_p")), (F.col(chunk) == F.col("_c")) & (F.col("_f") == F.col("_f1")), "left")
    d = d.join(overall.select(F.col("folded").alias("_f2"), F.col("canonical").alias("_o")), F.col("_f") == F.col("_f2"), "left")
    d = d.join(casing.select(F.col("folded").alias("_f3"), F.col("name").alias("_n")), F.col("_f") == F.col("_f3"), "left")
    return d.withColumn("canonical", F.coalesce("_p", "_o", "_n", name)).drop("_f", "_f1", "_f2", "_f3", "_c", "_p", "_o", "_n")


def _by_block(source: str, t: str, least: float) -> int:
    """Where t would begin by its longest common block with the source, of at least the share `least`; else -1.

    A block of more than half of t holds the middle of t, so only the places of the middle are tried.
    """
    n, need = len(t), math.ceil(least * len(t))
    middle = t[n - need : need]
    if not middle:
        m = SequenceMatcher(None, source, t, autojunk=False).find_longest_match()
        return max(0, m.a - m.b) if m.size and m.size >= need else -1
    best, at = None, source.find(middle)
    while at >= 0:
        a, b = at, n - need
        while a and b and source[a - 1] == t[b - 1]:
            a, b = a - 1, b - 1
        x, y = at + len(middle), need
        while x < len(source) and y < n and source[x] == t[y]:
            x, y = x + 1, y + 1
        if x - a >= need and (best is None or (x - a, -a, -b) > best):
            best = (x - a, -a, -b)
        at = source.find(middle, at + 1)
    return max(0, best[2] - best[1]) if best else -1


def locate_lines(source: str, lines: list[str], least: float = 0.6) -> list[tuple[int, int, str]]:
    """(start, end, how) of each line in a source, from a cursor that only moves on.

    Tried in turn: after the cursor, anywhere, without case, by head and tail, by its first 28
    characters, by the longest common block with the whole source (of at least the share
    `least`); else (-1, -1, 'lost').
    """
    out, cursor, low = [], 0, source.lower()
    for line in lines:
        t = line.strip()
        hit, how = source.find(t, cursor), "next"
        if hit < 0 or not t:
            for how, find in (
                ("anywhere", lambda: source.find(t)),
                ("caseless", lambda: low.find(t.lower())),
                ("head_tail", lambda: source.find(t[:20]) if len(t) > 40 and source.find(t[-20:], max(0, source.find(t[:20]))) >= 0 else -1),
                ("prefix", lambda: source.find(t[:28]) if len(t) > 28 else -1),
            ):
                hit = find() if t else -1
                if hit >= 0:
                    break
            else:
                how = "lost"
                if t:
                    hit = _by_block(source, t, least)
                    how = "fuzzy" if hit >= 0 else how
        if hit < 0:
            out.append((-1, -1, "lost"))
            continue
        out.append((hit, hit + len(t), how))
        if how == "next":
            cursor = hit + len(t)
    return out


def located(lines: DataFrame, sources: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, start, end, how): every line of a chunk found in the chunk's source text."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("o")
        src = right["s"].iloc[0] if len(right) and right["s"].iloc[0] is not None else ""
        spans = locate_lines(src, [t or "" for t in left["t"]])
        return pd.DataFrame(
            {"k": left["k"].to_numpy(), "o": left["o"].to_numpy(), "start": [s[0] for s in spans], "end": [s[1] for s in spans], "how": pd.Series([s[2] for s in spans], dtype=object)}
        )

    a = lines.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
    b = sources.select(F.col(key).alias("k"), F.col("source_text").alias("s"))
    kind = lines.schema[key].dataType.simpleString()
    out = a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(run, f"k {kind}, o long, start long, end long, how string")
    return out.withColumnRenamed("k", key).withColumnRenamed("o", order)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings by their matching blocks, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(
            [None if p is None or q is None else SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)],
            dtype="float64",
        )

    return ratio(a, b)


def merge_segmentations(lines: DataFrame, group: str, source_texts: DataFrame | None = None) -> DataFrame:
    """(group, island, anchor, speaker, text, conflict, split): two segmentations of a text made one.

    lines are (group, source, seq, anchor, stop, speaker, text, probe) with sources 'd1' and 'd2';
    seq is unique. Lines whose spans overlap or touch form an island. In each island the
    finer segmentation is the base, d1 where both are as fine; of equal probes the first counts. A
    speaker is a known name of an overlapping line, of d1 before d2, else Unknown; two different
    names are a conflict. The text is that of the overlapping lines of about its length which is
    most like the source at the place (group, source_text), or else the base's own. Lines
    without an anchor are left out.
    """
    placed = overlap_islands(lines.filter(F.col("anchor").isNotNull()), group, "anchor", "stop", "seq")
    finer = placed.groupBy(group, "island").agg(F.count_if(F.col("source") == "d1").alias("n1"), F.count_if(F.col("source") == "d2").alias("n2"))
    base = F.when(F.col("n1") >= F.col("n2"), "d1").otherwise("d2")
    split = (F.col("n1") > 1) | (F.col("n2") > 1)
    of = placed.join(finer.select(group, "island", base.alias("base"), split.alias("split")), [group, "island"])
    own = of.filter(F.col("source") == F.col("base"))
    first = own.groupBy(group, "island", "probe").agg(F.min("seq").alias("_first"))
    seg = own.join(first, [group, "island", "probe"]).filter(F.col("seq") == F.col("_first")).drop("_first", "source", "base")
    if source_texts is None:
        seg = seg.withColumn("window", F.lit(None).cast("string"))
    else:
        at = source_texts.select(F.col(group).alias("_g"), "source_text")
        window = F.substring("source_text", (F.col("anchor") + 1).cast("int"), (F.col("stop") - F.col("anchor") + 8).cast("int"))
        seg = seg.join(at, F.col(group) == F.col("_g"), "left").withColumn("window", window).drop("_g", "source_text")
    other = placed.select(
        F.col(group).alias("_g"), F.col("island").alias("_i"), F.col("source").alias("o_source"), F.col("seq").alias("o_seq"), F.col("anchor").alias("o_anchor"),
        F.col("stop").alias("o_stop"), F.col("speaker").alias("o_speaker"), F.col("text").alias("o_text"), F.col("probe").alias("o_probe"),
    )
    on = (F.col(group) == F.col("_g")) & (F.col("island") == F.col("_i")) & (F.col("anchor") < F.col("o_stop")) & (F.col("o_anchor") < F.col("stop"))
    both = seg.join(other, on).drop("_g", "_i")
    n, m = F.length("probe"), F.length("o_probe")
    like = F.col("window").isNotNull() & ((F.col("o_seq") == F.col("seq")) | ((m >= n * 0.7) & (m <= n * 1.4)))
    both = both.withColumn("like", sequence_ratio(F.when(like, F.lower("window")), F.when(like, F.lower("o_probe"))))
    known = ~T.is_unknown_speaker(F.col("o_speaker"))
    names = lambda d: F.collect_set(F.when(known & (F.col("o_source") == d), F.lower("o_speaker")))  # noqa: E731 - of one line's neighbours
    g = both.groupBy(group, "island", "seq").agg(
        F.first("anchor").alias("anchor"), F.first("split").alias("split"), F.first("text").alias("own"),
        F.min_by(F.when(known, F.col("o_speaker")), F.when(known, F.struct("o_source", "o_anchor", "o_seq"))).alias("who"),
        F.max_by("o_text", F.when(F.col("like").isNotNull(), F.struct("like", F.col("o_seq") == F.col("seq"), -F.col("o_seq")))).alias("best"),
        names("d1").alias("d1"), names("d2").alias("d2"),
    )
    conflict = (F.size("d1") > 0) & (F.size("d2") > 0) & (F.array_sort("d1") != F.array_sort("d2"))
    out = g.select(group, "island", "anchor", F.coalesce("who", F.lit("Unknown")).alias("speaker"), F.coalesce("best", "own").alias("text"), conflict.alias("conflict"), "split")
    return out.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def merge_counters(lines: DataFrame, merged: DataFrame, group: str) -> DataFrame:
    """(group, lines, located, located_pct, islands, split_islands, conflicts, unknown, unknown_pct, merged); group null for all."""
    pct = lambda a, b: F.round(a * 100.0 / F.nullif(b, F.lit(0)), 1)
    a = lines.rollup(group).agg(F.count(F.lit(1)).alias("lines"), F.count("anchor").alias("located"))
    m = merged.rollup(F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("merged"), F.countDistinct(group, "island").alias("islands"),
        F.countDistinct(F.when(F.col("split"), F.struct(group, "island"))).alias("split_islands"), F.count_if("conflict").alias("conflicts"),
        F.count_if(T.is_unknown_speaker(F.col("speaker"))).alias("unknown"),
    )
    out = a.join(m, F.col(group).eqNullSafe(F.col("_g")), "left").na.fill(0, ["merged", "islands", "split_islands", "conflicts", "unknown"])
    return out.select(
        group, "lines", "located", pct(F.col("located"), F.col("lines")).alias("located_pct"), "islands", "split_islands", "conflicts", "unknown",
        pct(F.col("unknown"), F.col("merged")).alias("unknown_pct"), "merged",
    )
