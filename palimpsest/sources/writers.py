"""Writers: JSON lines whole or in shards of exact size, token shards, chunk files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import with_ordinal
from ..operators.store import select_fields


def write_jsonl(df: DataFrame, path: str, fields: list[str] | None = None, limit: int | None = None) -> None:
    """JSON lines of the fields asked for (the key id is not among the fields of a plain export)."""
    out = select_fields(df, fields) if fields else df.drop("id")
    (out.limit(limit) if limit else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_shards(df: DataFrame, path: str, order: str, records: int, base: str = "out") -> DataFrame:
    """Shards of exactly `records` rows each (the last may have fewer) in folders shard=base-0001.jsonl.

    Returns (shard, records). records of 0 makes one shard.
    """
    o = with_ordinal(df, order, name="_o", start=0)
    n = F.lit(1) if records <= 0 else F.floor(F.col("_o") / records) + 1
    s = o.withColumn("shard", F.format_string(f"{base}-%04d.jsonl", n.cast("int"))).drop("_o")
    s.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("records"))


def assign_token_shards(docs: DataFrame, order: str, tokens: str, cap: int) -> DataFrame:
    """docs with `shard`: in order, a shard is closed before a document would take it above `cap` tokens.

    A document above the cap goes alone. The fold over sizes runs in one stream of (place,
    size) pairs, 12 bytes a document, never of documents.
    """
    o = with_ordinal(docs, order, name="_o", start=0)
    sizes = o.select("_o", F.size(tokens).alias("n")).repartition(1).sortWithinPartitions("_o")

    def run(batches):
        shard, used = 0, 0
        for b in batches:
            out = []
            for n in b.column(1).to_pylist():
                if used and used + n > cap:
                    shard, used = shard + 1, 0
                used += n
                out.append(shard)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], ["_o", "shard"])

    return o.join(sizes.mapInArrow(run, "_o long, shard int"), "_o").drop("_o")


def write_token_shards(docs: DataFrame, path: str, order: str, tokens: str, cap: int) -> DataFrame:
    """Binary shards of unsigned 16-bit ids, one file each, as a table (shard, content BINARY).

    Returns (shard, docs, tokens). Ids above 65,535 are an error.
    """
    a = assign_token_shards(docs, order, tokens, cap)

    def run(batches):
        now, parts = None, []
        for b in batches:
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != now and parts:
                    yield _shard(now, parts)
                    parts = []
                now = s
                x = np.asarray(ids, np.int64)
                if len(x) and (x.min() < 0 or x.max() > 65535):
                    raise ValueError("an id does not fit 16 bits")
                parts.append(x.astype(np.uint16).tobytes())
        if parts:
            yield _shard(now, parts)

    def _shard(s, parts):
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ["shard", "content"])

    src = a.select("shard", F.col(tokens).alias("t"), F.col(order).alias("o")).repartition("shard").sortWithinPartitions("shard", "o")
    src.select("shard", "t").mapInArrow(run, "shard int, content binary").write.mode("overwrite").parquet(path)
    return a.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(tokens)).alias("tokens"))


def write_split(train_valid: DataFrame, path: str) -> tuple[int, int]:
    """Two folders of JSON lines by `part`; raises if characters were lost. Returns characters of both."""
    n = {r["part"]: r["n"] for r in train_valid.groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()}
    for part in ("train", "valid"):
        train_valid.filter(F.col("part") == part).select("text").write.mode("overwrite").json(f"{path}/{part}")
    spark = train_valid.sparkSession
    back = sum(spark.read.schema("text string").json(f"{path}/{p}").agg(F.sum(F.length("text"))).first()[0] or 0 for p in ("train", "valid"))
    if back != sum(v or 0 for v in n.values()):
        raise RuntimeError("the split lost text")
    return n.get("train") or 0, n.get("valid") or 0


def append_results(df: DataFrame, path: str) -> None:
    """Append JSON lines to a result log."""
    df.write.mode("append").json(path)


def write_shard_files(shards: DataFrame, path: str, source: str, order: str, *fields: str) -> DataFrame:
    """One JSON record a source: {source, total, shards: [...]} in order; returns (source, total). A source's shards are one text's."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    g = shards.groupBy(source).agg(F.count(F.lit(1)).alias("total"), rows.alias("shards"))
    g.write.mode("overwrite").json(path)
    return shards.groupBy(source).agg(F.count(F.lit(1)).alias("total"))


def write_chunk_files(chunks: DataFrame, path: str, book: str, place: str, text: str) -> DataFrame:
    """Chunk texts in folders file=book_chunk_0001.txt; returns the report (book, chunks, words, least, most)."""
    from ..functions.text import space_words

    name = F.format_string("%s_chunk_%04d.txt", F.col(book).cast("string"), (F.col(place) + 1).cast("int"))
    chunks.select(name.alias("file"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)
    n = F.size(space_words(F.col(text)))
    return chunks.groupBy(book).agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("words"), F.min(n).alias("least"), F.max(n).alias("most"))


def report_lines(df: DataFrame, *order: str) -> DataFrame:
    """(place, line): a table as lines of text, a heading first, columns padded to their widest value."""
    from ..operators.ordinal import with_ordinal

    s = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    wide = s.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(c) for c in df.columns]).first()
    head = "  ".join(c.ljust(wide[c]) for c in df.columns).rstrip()
    line = F.rtrim(F.concat_ws("  ", *[F.rpad(c, wide[c], " ") for c in df.columns]))
    o = with_ordinal(s, *[f"_o{i}" for i in range(len(order))], name="place")
    return s.sparkSession.createDataFrame([(0, head)], "place long, line string").unionByName(o.select("place", line.alias("line")))
