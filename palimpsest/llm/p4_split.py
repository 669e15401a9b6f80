"""Problem 4: cutting oversized texts into pieces at natural boundaries, with overlap.

A text is laid out as tokens (words with the white space behind them); the prefix sums of
their lengths are the places where a cut is possible at all. Sorted arrays of paragraph,
sentence, line and word boundaries are searched by bisection for the last one under the
limit; where a text has no boundary in reach the cut is hard. The next piece begins about
`overlap` characters before the cut, at a word's beginning where there is one, and never
more than `most_overlap` before it.

Characters are Unicode code points. Null texts and texts within the limit give no pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .words import small_batches

LIMIT, OVERLAP, MOST_OVERLAP = 6000, 200, 300
#: A boundary of a better kind is preferred down to this share of the limit.
LEAST_FILL = 0.6
_PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+")
_LINE = re.compile(r"\r?\n")
_WORD = re.compile(r"\s+")


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, most: int = MOST_OVERLAP):
    """[(start, end, kind)] of the pieces; kind names the boundary at the end of each.

    The pieces cover the text; each after the first starts at most `most` characters
    before the end of the one before.
    """
    if not 0 <= overlap <= most < limit:
        raise ValueError("0 <= overlap <= most < limit is needed")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    kinds = [(k, [m.end() for m in p.finditer(text)]) for k, p in (("paragraph", _PARAGRAPH), ("sentence", _SENTENCE), ("line", _LINE), ("word", _WORD))]
    words = kinds[-1][1]
    out, start = [], 0
    while True:
        if n - start <= limit:
            out.append((start, n, "end"))
            return out
        top, kind, end = start + limit, "hard", start + limit
        for least in (start + int(limit * LEAST_FILL), start + most + 1):
            for k, ends in kinds:
                i = bisect_right(ends, top) - 1
                if i >= 0 and ends[i] >= least:
                    kind, end = k, ends[i]
                    break
            if kind != "hard":
                break
        if kind == "hard" and text[end - 1] == "\r" and text[end] == "\n":
            end -= 1
        out.append((start, end, kind))
        # the word beginning nearest to the wanted overlap, within the allowed one
        a, b = bisect_left(words, max(start + 1, end - most)), bisect_right(words, end - 1)
        near = words[a:b]
        start = min(near, key=lambda p: abs(end - overlap - p)) if near else max(start + 1, end - overlap)


def split_texts(
    df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, most: int = MOST_OVERLAP
) -> DataFrame:
    """(key, piece, start_char, end_char, cut, piece_text) of every text above the limit.

    piece counts from 0; start_char from 0, end_char is exclusive. Repeated rows give
    repeated pieces. Only oversized texts reach Python.
    """

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, 1):
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = [
                    (k, i, x, y, kind, t[x:y])
                    for k, t in zip(keys, texts, strict=True)
                    for i, (x, y, kind) in enumerate(cuts(t, limit, overlap, most))
                ]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["k", "piece", "start_char", "end_char", "cut", "piece_text"],
                )

    src = df.filter(F.length(text) > limit).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(
        run, "k long, piece int, start_char long, end_char long, cut string, piece_text string"
    ).withColumnRenamed("k", key)


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, piece, start_char, end_char, cut, piece_text of every text above 6,000 characters."""
    return split_texts(table(spark, folder, "docvalue"), "rec_id")


def p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id and what its pieces add up to: pieces, characters covered, longest piece and overlap
    within their limits, every piece equal to its place in the text."""
    docs = table(spark, folder, "docvalue")
    pieces = split_texts(docs, "rec_id").withColumn("next", F.col("piece") + 1)
    after = pieces.select("rec_id", F.col("piece").alias("next"), F.col("start_char").alias("next_start"))
    both = pieces.join(after, ["rec_id", "next"], "left").join(docs.select("rec_id", "text"), "rec_id")
    overlap = F.coalesce(F.col("end_char") - F.col("next_start"), F.lit(0))
    same = F.substring("text", (F.col("start_char") + 1).cast("int"), F.length("piece_text")) == F.col("piece_text")
    return both.groupBy("rec_id").agg(
        F.sum(F.length("piece_text") - overlap).alias("covered"),
        (F.max(F.length("piece_text")) <= LIMIT).alias("within_limit"),
        ((F.max(overlap) <= MOST_OVERLAP) & (F.min(overlap) >= 0)).alias("within_overlap"),
        F.bool_and(same).alias("same_text"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id of the records that were split."""
    return p4_pieces(spark, folder).filter("piece = 0").select("rec_id")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checked": p4_checked}
ORACLE = {
    "p4_found": "select rec_id from docvalue where length(text) > 6000",
    "p4_checked": """select rec_id, length(text)::bigint as covered, true as within_limit, true as within_overlap, true as same_text
    from docvalue where length(text) > 6000""",
}
