"""Cutting texts into windows, chunks, shards and splits."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .lookup import slices
from .ordinal import with_ordinal

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=[A-Z\"'“‘(])")


def word_windows(df: DataFrame, key: str, size: int, text: str = "text") -> DataFrame:
    """(key, window, start_word, end_word, chunk): windows of `size` words, aligned at 0 and
    shifted by half; the last may be shorter. Texts without words give none."""
    w = df.select(key, T.space_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    parts = []
    for name, first in (("aligned", 0), ("shifted", size // 2)):
        src = w.filter(F.size("w") > first)
        at = F.explode(F.sequence(F.lit(first), F.size("w") - 1, F.lit(size))).alias("start_word")
        parts.append(src.select(key, F.lit(name).alias("window"), at, "w"))
    out = parts[0].unionByName(parts[1])
    return out.select(
        key, "window", "start_word", F.least(F.col("start_word") + size, F.size("w")).alias("end_word"),
        F.array_join(F.slice("w", F.col("start_word") + 1, size), " ").alias("chunk"),
    )


def char_chunks(df: DataFrame, key: str, size: int, most: int | None = None, text: str = "text") -> DataFrame:
    """(key, chunk_index, chunk): trimmed pieces of `size` characters that are not blank, the first `most`."""
    t = F.col(text)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t)), F.lit(size))
    pieces = F.filter(F.transform(at, lambda i: F.trim(F.substring(t, i, F.lit(size)))), lambda p: p != "")
    if most is not None:
        pieces = F.slice(pieces, 1, most)
    return df.filter(t.isNotNull()).select(key, F.posexplode(pieces).alias("chunk_index", "chunk"))


def token_windows(df: DataFrame, key: str, tokens: str, length: int, offset: int = 0) -> DataFrame:
    """(key, window, ids): windows of length + 1 tokens, one step of `length` apart, after an offset."""
    n = F.floor((F.size(tokens) - offset - 1) / length).cast("int")
    src = df.filter(n >= 1).select(key, F.col(tokens).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return src.select(key, "window", F.slice("t", F.col("window") * length + offset + 1, length + 1).alias("ids"))


#: Words between ASCII white space, as the built-in functions count them.
_WORD = re.compile(r"\S+\s*", re.ASCII)


def _words(s: str) -> int:
    return sum(1 for _ in _WORD.finditer(s))


def spans(text: str, low: int, high: int, target: int) -> list[tuple[int, int]]:
    """Contiguous spans of about `target` words that cover a text, cut at paragraphs, or at
    sentences within paragraphs above `high`, or at words within such sentences."""
    cuts = [m.end() for m in _PARAGRAPH.finditer(text)]
    units: list[tuple[int, int]] = []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if a == b:
            continue
        if _words(text[a:b]) <= high:
            units.append((a, b))
            continue
        inner = [a + m.end() for m in _SENTENCE.finditer(text[a:b])]
        for c, d in zip([a, *inner], [*inner, b], strict=True):
            if _words(text[c:d]) <= high:
                units.append((c, d))
                continue
            ends = [c + m.end() for m in _WORD.finditer(text[c:d])]
            marks = [c, *ends[target - 1 : -1 : target], d]
            units += list(zip(marks, marks[1:], strict=False))
    out: list[tuple[int, int]] = []
    start, n = (units[0][0] if units else 0), 0
    for a, b in units:
        k = _words(text[a:b])
        # go on while that comes nearer to the target, or the span is still too short
        if n and (n + k > high or (n >= low and abs(n + k - target) >= abs(n - target))):
            out.append((start, a))
            start, n = a, 0
        n += k
    if units:
        out.append((start, units[-1][1]))
    return out


def span_shards(
    df: DataFrame, key: str, low: int = 300, high: int = 700, target: int = 500, text: str = "text"
) -> DataFrame:
    """(key, shard, pos, words, shard_text): exact spans of each text; their texts together are the text.

    Null and empty texts give none.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    rows += [(k, i, x, _words(t[x:y]), t[x:y]) for i, (x, y) in enumerate(spans(t, low, high, target))]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["k", "shard", "pos", "words", "shard_text"]
                )

    src = df.filter(F.length(text) > 0).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, shard int, pos long, words int, shard_text string").withColumnRenamed("k", key)


def check_shards(shards: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, shards, contiguous, same_text, words_off): the invariants of exact spans."""
    w = W.partitionBy(key).orderBy("shard")
    end = F.col("pos") + F.length("shard_text")
    s = shards.withColumn("ok", F.col("pos") == F.coalesce(F.lag(end).over(w), F.lit(0)))
    s = s.join(docs.select(key, F.col(text).alias("_t")), key)
    same = F.substring(F.col("_t"), (F.col("pos") + 1).cast("int"), F.length("shard_text")) == F.col("shard_text")
    return s.groupBy(key).agg(
        F.count(F.lit(1)).alias("shards"),
        F.bool_and("ok").alias("contiguous"),
        (F.bool_and(same) & (F.sum(F.length("shard_text")) == F.max(F.length("_t")))).alias("same_text"),
        F.abs(F.sum("words") - F.max(F.size(T.space_words(F.col("_t"))))).alias("words_off"),
    )


def pack_units(units: list[tuple[str, int]], target: int, low: float, high: float) -> list[tuple[list[str], int]]:
    """Greedy chunks of (text, words) units: each ends at the boundary nearest to the target within the bounds."""
    out, i = [], 0
    while i < len(units):
        n, best, j = 0, None, i
        while j < len(units):
            n += units[j][1]
            j += 1
            if n > high * target and best is not None:
                break
            if best is None or abs(n - target) <= abs(best[0] - target) or best[0] < low * target:
                best = (n, j)
            if n >= high * target:
                break
        out.append(([u for u, _ in units[i : best[1]]], best[0]))
        i = best[1]
    return out


def lookahead_chunks(df: DataFrame, key: str, target: int = 400, low: float = 0.8, high: float = 1.05, text: str = "text") -> DataFrame:
    """(key, chunk_index, words, chunk): paragraphs joined to chunks near the target; oversized
    paragraphs are cut at sentences, oversized sentences at words."""

    def units(t: str) -> list[tuple[str, int]]:
        out = []
        for p in re.split(r"\n\s*\n", t):
            p = " ".join(p.split())
            if not p:
                continue
            parts = [p] if _words(p) <= high * target else _SENTENCE.split(p)
            for s in parts:
                w = s.split()
                step = max(1, target)
                out += [(" ".join(w[k : k + step]), len(w[k : k + step])) for k in range(0, len(w), step)] if len(w) > high * target else [(s, len(w))]
        return out

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(k, i, n, "\n\n".join(c)) for i, (c, n) in enumerate(pack_units(units(t), target, low, high))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                ["k", "chunk_index", "words", "chunk"],
            )

    src = df.filter(F.length(text) > 0).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, chunk_index int, words int, chunk string").withColumnRenamed("k", key)


def chunk_report(chunks: DataFrame, group: str, target: int, low: float = 0.8, high: float = 1.05) -> DataFrame:
    """Totals by group and over all (group null): chunks, words, mean, upper median, range, below/ok/above."""
    w = F.col("words")
    # the upper median: counts by value, not a list of all values
    upper = F.expr("percentile_disc(0.5) within group (order by words desc)").cast("int")
    return chunks.rollup(group).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("words").alias("words"), F.avg("words").alias("mean_words"),
        upper.alias("median_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"),
        F.count_if(w < low * target).alias("below"), F.count_if(w.between(low * target, high * target)).alias("ok"),
        F.count_if(w > high * target).alias("above"),
    )


def split_place(text: str, ratio: float, tolerance: float = 0.05) -> int:
    """Where to cut a text near a ratio: paragraph, else sentence, else word, else right there."""
    n = len(text)
    target, reach = int(n * ratio), int(n * tolerance)
    low, high = max(1, target - reach), min(n - 1, target + reach)
    for pattern in (r"\n\n+", r"[.!?…][\"')\]]*\s+", r"\s+"):
        ends = [m.end() for m in re.finditer(pattern, text)]
        near = ends[bisect_left(ends, low) : bisect_right(ends, high)]
        if near:
            return min(near, key=lambda p: abs(p - target))
    return target


def text_splits(df: DataFrame, key: str, ratio: float = 0.9, text: str = "text", least: int = 1000) -> DataFrame:
    """(key, train, valid): each text cut near the ratio; texts under `least` characters train only."""

    def run(batches):
        for b in batches:
            ts = b.column(1).to_pylist()
            at = [split_place(t, ratio) if len(t) >= least else len(t) for t in ts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t[:p] for t, p in zip(ts, at, strict=True)], pa.string()), pa.array([t[p:] for t, p in zip(ts, at, strict=True)], pa.string())],
                ["k", "train", "valid"],
            )

    src = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, train string, valid string").withColumnRenamed("k", key)


def middle_places(text: str, share: float = 0.1, tolerance: float = 0.05, least: int = 1000) -> tuple[int, int]:
    """(start, end) of the validation part of a single document: about `share` of it, from the middle.

    Both ends are cut at clean boundaries of their own; texts under `least` characters have none,
    others at least one character.
    """
    n = len(text)
    if n < least:
        return n, n
    start = split_place(text, (1 - share) / 2, tolerance)
    return start, max(start + 1, split_place(text, (1 + share) / 2, tolerance))


def middle_splits(df: DataFrame, key: str, share: float = 0.1, text: str = "text", least: int = 1000) -> DataFrame:
    """(key, train, valid, start): validation carved from the middle of each text, so that both ends
    train; `start` is where it stood. Null texts give no row."""

    def run(batches):
        for b in batches:
            ts = b.column(1).to_pylist()
            at = [middle_places(t, share, least=least) for t in ts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([t[:x] + t[y:] for t, (x, y) in zip(ts, at, strict=True)], pa.string()),
                    pa.array([t[x:y] for t, (x, y) in zip(ts, at, strict=True)], pa.string()), pa.array([x for x, _ in at], pa.int64()),
                ],
                ["k", "train", "valid", "start"],
            )

    src = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, "k long, train string, valid string, start long").withColumnRenamed("k", key)


def entry_split(df: DataFrame, order: str, ratio: float = 0.9, tolerance: float = 0.05, text: str = "text") -> DataFrame:
    """df with part 'train' or 'valid': entries in order, cut at the cleanest boundary near the ratio.

    Among the ends (but the last) within the tolerance the best boundary score wins, then the
    nearest; without one, the nearest of all. A single entry trains. Sums of ranges give the
    running total, so no task sees all rows. Null texts count as empty.
    """
    o = with_ordinal(df.withColumn("_n", F.coalesce(F.length(text), F.lit(0))), order, name="_ord")
    # running sums in blocks of the ordinal: block totals first, then within the block
    size = 10_000
    o = o.withColumn("_block", F.floor(F.col("_ord") / size))
    blocks = o.groupBy("_block").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_cnt"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = blocks.select("_block", before.alias("_before"))
    whole = blocks.agg(F.sum("_sum").alias("_total"), F.sum("_cnt").alias("_rows"))
    inside = F.sum("_n").over(W.partitionBy("_block").orderBy("_ord").rowsBetween(W.unboundedPreceding, 0))
    c = o.withColumn("_in", inside).join(totals, "_block").withColumn("_cum", F.col("_before") + F.col("_in"))
    c = c.crossJoin(F.broadcast(whole))
    dist = F.abs(F.col("_cum") - F.col("_total") * ratio)
    near = (dist <= F.col("_total") * tolerance).cast("int")
    score = F.when(near == 1, T.boundary_score(F.coalesce(F.col(text), F.lit("")))).otherwise(0)
    cut = c.filter("_ord < _rows").agg(F.max_by("_ord", F.struct(near, score, -dist, -F.col("_ord"))).alias("_cut"))
    out = o.crossJoin(F.broadcast(cut))
    part = F.when(F.col("_cut").isNull() | (F.col("_ord") <= F.col("_cut")), "train").otherwise("valid")
    return out.withColumn("part", part).drop("_n", "_ord", "_block", "_cut")


def hash_split(key: Column, seed: int, parts: dict[str, float]) -> Column:
    """The part a key falls in, by its hash and the parts' shares; the same whatever the rows."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    out, top = F.lit(list(parts)[-1]), 1.0
    for name, share in reversed(list(parts.items())[:-1]):
        top = sum(v for k, v in list(parts.items())[: list(parts).index(name) + 1])
        out = F.when(u < top, name).otherwise(out)
    return out
