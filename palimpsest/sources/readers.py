"""Readers of corpora: JSON lines, raw records, whole texts, Markdown, pages, poems, quotes.

gzip and other codecs are read by their file extension. Malformed records are counted or
left out as each reader says; nothing stops at them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

ROW_SUFFIXES, TEXT_SUFFIXES = ("json", "jsonl", "ndjson"), ("txt", "md")


def file_kind(path: str) -> str:
    """rows or text, by the extension without .gz; other extensions are an error."""
    name = re.sub(r"\.(gz|bz2|zst)$", "", path.lower())
    ext = name.rsplit(".", 1)[-1]
    if ext in ROW_SUFFIXES:
        return "rows"
    if ext in TEXT_SUFFIXES:
        return "text"
    raise ValueError(f"unknown file type: {path}")


def read_jsonl(spark: SparkSession, path: str | list[str], text_key: str = "text", extra: list[str] = ()) -> DataFrame:
    """(file, line, text, status, extra MAP) of JSON lines; status is ok, malformed or no_text.

    Lines of 10 characters or fewer after trimming are no lines at all. extra holds the
    listed fields that are not null, and is null without any.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")
    ).filter(F.length("v") > 10)
    m = F.from_json("v", "map<string,string>", {"mode": "PERMISSIVE"})
    d = lines.withColumn("m", F.when(F.try_parse_json("v").isNotNull() & F.col("v").startswith("{"), m))
    t = F.try_element_at("m", F.lit(text_key))
    status = F.when(F.col("m").isNull(), "malformed").when(t.isNull() | (t == ""), "no_text").otherwise("ok")
    e = F.map_filter("m", lambda k, v: k.isin(*extra) & v.isNotNull()) if extra else F.lit(None).cast("map<string,string>")
    return d.select(
        "file", "line", F.when(status == "ok", t).alias("text"), status.alias("status"), F.when(F.size(e) > 0, e).alias("extra")
    )


def load_counters(rows: DataFrame) -> DataFrame:
    """(file, loaded, dropped) and the total with file null."""
    return rows.rollup("file").agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("status") != "ok").alias("dropped"))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines, of a JSON array, or of an object that wraps an array.

    A file is lines if its first line that is not blank is a whole JSON object; an array or an
    object over several lines is read whole. Of an object alone, the first array of objects
    counts, if it has one.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.select(F.trim("value").alias("v"), F.try_parse_json("value").isNotNull().alias("ok")).limit(2).collect()
    first = head[0].v if head else ""
    whole = first.startswith("[") or bool(head and not head[0].ok)
    df = spark.read.option("multiLine", whole).json(path)
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith("array<struct")]
    if not first.startswith("[") and arrays and (whole or len(head) == 1):
        return df.select(F.explode(arrays[0]).alias("r")).select("r.*")
    return df


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): schemaless JSON records by id, or by the hash of their text; the last of an id stays.

    JSON lines, or files that hold an array or a single object over several lines. Records
    without both are left out. value is the record's JSON.
    """
    head = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v"), F.try_parse_json("value").isNotNull().alias("ok")).limit(1).collect()
    if head and (head[0].v.startswith("[") or not head[0].ok):
        files = spark.read.text(path, wholetext=True)
        whole = F.when(F.try_parse_json("value").isNotNull(), F.trim("value"))
        items = F.when(whole.startswith("["), F.from_json(whole, "array<string>")).otherwise(F.array(whole))
        lines = files.select(F.explode(items).alias("value")).select(F.monotonically_increasing_id().alias("o"), "value")
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), "value")
    j = F.from_json("value", "struct<id:string,text:string>")
    sha = F.reflect(F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit("sha512_256Hex"), F.col("j.text"))
    d = lines.filter(F.try_parse_json("value").isNotNull()).withColumn("j", j)
    d = d.withColumn("id", F.coalesce("j.id", F.when(F.col("j.text") != "", sha))).filter("id is not null")
    return d.groupBy("id").agg(F.max_by("value", "o").alias("value"))


def read_texts(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    """(file, text): one row a file; Markdown without front matter. UTF-8, or Latin-1 where it is none."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    t = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    t = F.regexp_replace(F.regexp_replace(t, "^﻿", ""), "\r\n?", "\n")
    return d.select(F.col("path").alias("file"), (T.strip_front_matter(t) if markdown else t).alias("text"))


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text): JSON lines with a text field or plain lines, as the first line that is not blank tells."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    head = lines.orderBy("ord").limit(1).collect()
    is_json = bool(head) and head[0].value.strip().startswith("{")
    text = F.from_json("value", "struct<text:string>")["text"] if is_json else F.col("value")
    return lines.select("ord", text.alias("text")).filter("text is not null")


def seeds(rows: DataFrame, order: str, offset: int, limit: int, valid: Column) -> DataFrame:
    """The first `limit` valid rows from the place `offset` of all rows on."""
    from ..operators.ordinal import with_ordinal

    o = with_ordinal(rows, order, name="seed_index", start=0)
    return o.filter((F.col("seed_index") >= offset) & valid).orderBy("seed_index").limit(limit)


def page_words(spark: SparkSession, path: str, row_tag: str = "OBJECT") -> DataFrame:
    """(page, text): words of scanned-book XML by page, one text line a LINE; pages without words are left out."""
    d = spark.read.option("rowTag", row_tag).xml(path).withColumn("page", F.monotonically_increasing_id())
    lines = F.from_json(F.get_json_object(F.to_json(F.struct("*")), "$.LINE"), "array<struct<WORD:array<string>>>")
    return d.select("page", F.array_join(F.transform(lines, lambda x: F.array_join(x["WORD"], " ")), "\n").alias("text")).filter("text <> ''")


def parse_poems(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, poem, title, author, body) of texts with headings '# TITLE by AUTHOR' (the last by counts)."""
    lines = files.select("file", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    head = F.col("line").rlike("^# ")
    w = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    d = lines.withColumn("poem", F.sum(head.cast("int")).over(w)).filter("poem > 0")
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("n", "line")))), lambda x: x["line"]), "\n"
    )
    g = d.groupBy("file", "poem").agg(F.max(F.when(head, F.regexp_replace("line", "^# +", ""))).alias("h"), F.trim(body).alias("body"))
    title = F.regexp_extract("h", r"^(.*) by ([^\n]*?)$", 1)
    # greedy, so the last ' by ' splits
    return g.select(
        "file", "poem", F.when(title != "", title).otherwise(F.col("h")).alias("title"),
        F.when(title != "", F.regexp_extract("h", r"^.* by (.*)$", 1)).alias("author"), "body",
    )


def parse_quotes(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, n, quote): lines below a heading '## Quotes', without blanks, headings and bullets."""
    below = F.regexp_extract(text, r"(?s)## Quotes[^\n]*\n(.*)$", 1)
    d = files.select("file", F.posexplode(F.split(below, "\n")).alias("n", "q"))
    d = d.select("file", "n", F.trim(F.regexp_replace("q", r"^\s*[-*] +", "")).alias("quote"))
    return d.filter((F.col("quote") != "") & ~F.col("quote").startswith("#"))


def parse_verses(books: DataFrame, text: str = "text") -> DataFrame:
    """(book, chapter, verse, text) of texts marked 'chapter:verse' before each verse."""
    parts = F.split(F.regexp_replace(text, r"(?:^|\s)(\d{1,3}:\d{1,3})\s+", "\u0001$1\u0002"), "\u0001")
    d = books.select("book", F.explode(F.slice(parts, 2, F.size(parts))).alias("p"))
    ref, body = F.substring_index("p", "\u0002", 1), F.substring_index("p", "\u0002", -1)
    return d.select(
        "book", F.split_part(ref, F.lit(":"), F.lit(1)).cast("int").alias("chapter"),
        F.split_part(ref, F.lit(":"), F.lit(2)).cast("int").alias("verse"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"),
    )


def read_token_shards(spark: SparkSession, path: str, eos: int) -> DataFrame:
    """(file, doc, ids): documents of binary shards of unsigned 16-bit ids closed by the end mark."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[i].as_py(), np.uint16).astype(np.int32)
                stops = np.flatnonzero(ids == eos) + 1
                cut = [0, *stops.tolist()] + ([len(ids)] if len(ids) and (not len(stops) or stops[-1] != len(ids)) else [])
                docs = [ids[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([b.column(0)[i].as_py()] * len(docs), pa.string()),
                        "doc": pa.array(range(len(docs)), pa.int64()), "ids": pa.array(docs, pa.list_(pa.int32())),
                    }
                )

    src = spark.read.format("binaryFile").load(path).select("path", "content")
    return src.mapInArrow(run, "file string, doc long, ids array<int>")


def token_health(docs: DataFrame, ids: str, vocab_size: int, seq_len: int) -> DataFrame:
    """One row: documents, tokens, ids out of range, lengths least, median, mean, most, tiny, short, long, huge."""
    from ..operators.ordinal import quantiles

    n = F.size(ids)
    one = docs.select(F.lit(1).alias("_g"), n.alias("_n"))
    median = quantiles(one, "_g", "_n", {"median": 0.5}).select("median")  # one row
    stats = docs.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"),
        F.sum(F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocab_size)))).alias("bad_ids"),
        F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"),
        F.count_if(n < 16).alias("tiny"), F.count_if(n < seq_len).alias("short"), F.count_if(n >= seq_len).alias("long"),
        F.count_if(n > 100 * seq_len).alias("huge"),
    )
    return stats.join(F.broadcast(median), how="left").select(
        "docs", "tokens", "bad_ids", "least", "median", "mean", "most", "tiny", "short", "long", "huge"
    )


def markdown_urls(text: Column) -> Column:
    """Addresses of Markdown files in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)\"'<>]+\.md)"), F.lit(1)))


def dialogue_records(lines: DataFrame, column: str) -> DataFrame:
    """(speaker, text) of lenient dialogue lines: a trailing comma is allowed, and {Name: text} too."""
    bare = F.regexp_replace(F.trim(column), ",$", "")
    m = F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, "map<string,string>"))
    d = lines.select(m.alias("m")).filter("m is not null")
    two = F.map_contains_key("m", "speaker") & F.map_contains_key("m", "text")
    one = F.size("m") == 1
    return d.filter(two | one).select(
        F.when(two, F.try_element_at("m", F.lit("speaker"))).otherwise(F.map_keys("m")[0]).alias("speaker"),
        F.when(two, F.try_element_at("m", F.lit("text"))).otherwise(F.map_values("m")[0]).alias("text"),
    )


def resolved(paths: list[str]) -> list[str]:
    """The files that paths, globs and folders (with their subfolders) of a local or shared disk name: each once, sorted."""
    from glob import glob
    from pathlib import Path

    out: set[str] = set()
    for p in paths:
        for q in glob(p, recursive=True) or [p]:
            f = Path(q)
            out |= {str(x) for x in f.rglob("*") if x.is_file()} if f.is_dir() else {str(f)}
    return sorted(out)


def read_parquet_texts(spark: SparkSession, path: str, text: str = "text") -> tuple[DataFrame, bool]:
    """((text) of a Parquet source without null and empty texts, whether it has the column): none if it lacks it."""
    d = spark.read.parquet(path)
    if text not in d.columns:
        return spark.createDataFrame([], "text string"), False
    t = d.select(F.col(text).cast("string").alias("text"))
    return t.filter("text <> ''"), True


def read_shard_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, chunk_file, shard, words, text) of shard files: a JSON object with a source and an array of
    shards in each file, or one such object a line."""
    head = spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").isNotNull().alias("ok")).limit(1).collect()
    d = spark.read.option("multiLine", bool(head) and not head[0].ok).schema("source string, shards array<struct<shard:int,words:int,text:string>>").json(path)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return d.select("source", name.alias("chunk_file"), F.explode("shards").alias("s")).select("source", "chunk_file", "s.shard", "s.words", "s.text")


def fresh(files: DataFrame, now: Column, age: str) -> DataFrame:
    """Files (with modificationTime, as binaryFile gives) that were changed less than an age such as '1 day' ago."""
    return files.filter(F.col("modificationTime") > now - F.expr(f"interval {age}"))


def plain_characters(text: Column) -> Column:
    """A text without byte-order mark, with one kind of line end, and without control, private and replacement characters."""
    t = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    return F.regexp_replace(t, r"[\p{Cc}\p{Co}\p{Cn}\ufffd&&[^\n\t]]", "")


def book_body(text: Column, heading: str, next_heading: Column) -> Column:
    """The part of a text from the last line that is a book's heading to the next book's heading, or its end; null without.

    Contents lists name the books too, so the last such line is the book's beginning.
    """
    begin = rf"(?is)^.*(?:^|\n)[ \t]*{heading}[ \t]*\r?\n"
    rest = F.when(text.rlike(begin), F.regexp_replace(text, begin, ""))
    end = F.regexp_instr(rest, F.concat(F.lit(r"(?i)\n[ \t]*"), next_heading, F.lit(r"[ \t]*(\r?\n|$)")))
    return F.when(next_heading.isNull() | (end == 0), rest).otherwise(F.substring(rest, F.lit(1), end - 1))


def book_pages(spark: SparkSession, path: str, most: int | None = None, least_markup: int = 32) -> DataFrame:
    """(page, name, text) of scanned-book XML: the first `most` pages that have words, with the name of their PARAM PAGE;
    pages of less markup than `least_markup` characters count as blank."""
    d = spark.read.option("rowTag", "OBJECT").xml(path).withColumn("page", F.monotonically_increasing_id())
    j = F.to_json(F.struct(*[c for c in d.columns if c != "page"]))
    lines = F.flatten(F.transform(F.regexp_extract_all(j, F.lit(r'("WORD":(?:\[[^\]]*\]|"(?:[^"\\]|\\.)*"))'), F.lit(1)), lambda x: F.array(x)))
    words = F.transform(
        lines, lambda x: F.array_join(F.regexp_extract_all(F.regexp_replace(x, '^"WORD":', ""), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), " ")
    )
    name = F.nullif(F.regexp_extract(j, r'"_name":"PAGE","_value":"([^"]*)"', 1), F.lit(""))
    p = d.select("page", name.alias("name"), F.array_join(F.filter(words, lambda w: w != ""), "\n").alias("text"), F.length(j).alias("_n"))
    p = p.filter((F.col("text") != "") & (F.col("_n") >= least_markup)).drop("_n")
    return p if most is None else p.orderBy("page").limit(most)
