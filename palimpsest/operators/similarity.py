"""Cosine similarity of dense vectors: a stated query set against all rows, in blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 4096
#: Blocks that share a scan of the rows.
SCAN_BLOCKS = 8


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, with 1e-12 added to the product of the norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


class Best:
    """The k best rows of each query so far, as arrays; of equal cosines the least key."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q = vectors.astype(np.float64)
        self.norm = np.sqrt((self.q * self.q).sum(1))
        self.sim = np.full((len(ids), k), -np.inf)
        self.key = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        sim = (self.q @ rows.T) / (self.norm[:, None] * np.sqrt((rows * rows).sum(1))[None, :] + 1e-12)
        sim[self.ids[:, None] == keys[None, :]] = -np.inf
        sim = np.concatenate([self.sim, sim], axis=1)
        key = np.concatenate([self.key, np.broadcast_to(keys, (len(self.ids), len(keys)))], axis=1)
        at = np.argpartition(-sim, self.k - 1, axis=1)[:, : self.k]
        least = np.take_along_axis(sim, at, 1).min(1)
        # rows where equal cosines at the end leave a choice
        for i in np.flatnonzero((sim >= least[:, None]).sum(1) > self.k):
            some = np.flatnonzero(sim[i] >= least[i])
            at[i] = some[np.lexsort((key[i, some], -sim[i, some]))[: self.k]]
        self.sim, self.key = np.take_along_axis(sim, at, 1), np.take_along_axis(key, at, 1)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(q_id, key, cosine, rank): the k nearest rows of every query, itself excepted; ties by key.

    The queries are a stated set: they are broadcast in blocks of QUERY_BLOCK, SCAN_BLOCKS of which share
    a scan of the rows, and the driver holds one block at a time. Every task keeps its k best of
    each query, so that at most tasks * queries * k rows are shuffled. Null vectors are left out.
    """
    spark = rows.sparkSession
    src = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))

    def search(shared: list) -> DataFrame:
        def run(batches):
            some = [Best(*b.value, k) for b in shared]
            for batch in batches:
                keys = np.asarray(batch.column(0))
                if len(keys):
                    flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(keys), -1)
                    for b in some:
                        b.add(keys, flat)
            for b in some:
                i, j = np.nonzero(np.isfinite(b.sim))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[i]), pa.array(b.key[i, j]), pa.array(b.sim[i, j])], ["q_id", "k", "cosine"])

        return src.mapInArrow(run, "q_id long, k long, cosine double")

    parts, shared, ids, vectors = [], [], [], []

    def close() -> None:
        if ids:
            shared.append(spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vectors, np.float32 if kind == "float" else np.float64))))
            ids.clear(), vectors.clear()

    kind = queries.schema[vector].dataType.elementType.simpleString()
    for r in queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v")).toLocalIterator():
        ids.append(r.q), vectors.append(r.v)
        if len(ids) == QUERY_BLOCK:
            close()
            if len(shared) == SCAN_BLOCKS:
                parts.append(search(shared))
                shared = []
    close()
    if shared or not parts:
        parts.append(search(shared))
    w = W.partitionBy("q_id").orderBy(F.desc("cosine"), "k")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("k", key)


def vector_statistics(rows: DataFrame, vector: str) -> DataFrame:
    """(n, mean_norm, mean_cosine): the mean cosine of all pairs of different rows, without pairs.

    With unit vectors u, the sum over all pairs is |sum u|^2 - n, so one pass suffices.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    d = rows.filter(F.col(vector).isNotNull()).select(norm.alias("norm"), F.posexplode(vector).alias("i", "x"))
    per = d.groupBy("i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"))
    sq = per.agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    n = rows.filter(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("mean_norm"))
    return n.crossJoin(sq).select(
        "n", "mean_norm", ((F.col("sq") - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("mean_cosine")
    )
