"""Incremental ingest and windows over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import metrics as M
from ..operators.store import upsert


def ingest_new_files(
    spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
) -> StreamingQuery:
    """Append what is new in a folder to a table, once each: files seen and rows written are in the
    checkpoint, so a restart goes on where it stopped. Texts go through the ingest filter."""
    d = spark.readStream.format(fmt).schema(schema).load(source)
    d = prepare(d) if prepare else d.filter(M.prefilter(F.col("text")))
    return (
        d.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def upsert_stream(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Upsert every batch of new rows into a versioned table; the newest version is target/v=<batch>.

    Each batch writes a whole new version and is safe to repeat: it reads the version before.
    """

    def step(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        # only the very first version has none before it; a read that fails is an error
        jvm, path = s.sparkContext._jvm, f"{target}/v={n - 1}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(p)
        old = s.read.parquet(path) if there else s.createDataFrame([], batch.schema)
        upsert(old, batch, seq).write.mode("overwrite").parquet(f"{target}/v={n}")

    d = spark.readStream.schema(schema).parquet(source)
    return d.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n): sessions of a key with gaps of less than `gap`; on a stream late rows wait `late`."""
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def window_counts(events: DataFrame, ts: str, key: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, key, n): tumbling or sliding windows."""
    d = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return d.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of a query's latest batches, as far as the engine keeps them."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
