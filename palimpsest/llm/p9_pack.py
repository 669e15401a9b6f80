"""Problem 9: filling containers of fixed capacity with texts of varying length.

Bounded-space online best fit: OPEN_BINS containers are open at a time, kept in a bitset
by free space, so that the best fit (the least free space that still suffices) is one
shift and one lowest-bit operation. If an item fits nowhere and all are open, the fullest
closes first. Items are dealt to shards by a hash of their key; each shard packs by
itself, in key order, thus the same again after a lost executor. A shard leaves at most
OPEN_BINS containers unfilled, among some thousands.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..tables import spread, table
from .p8_encode import VOCAB_PATH, token_counts

CAPACITY = 2048
#: Containers open at a time in a shard.
OPEN_BINS = 64
#: Items of a shard, about.
SHARD_ITEMS = 20_000


class Packer:
    """Online best fit over a bounded number of open bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.mask = 0  # bit f: an open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.used: dict[int, int] = {}
        self.next = 0
        self.open = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return b

    def put(self, size: int) -> tuple[int, int]:
        """(bin, position within it) of an item of 1..capacity."""
        fit = self.mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.open_bins:
                del self.used[self._take((self.mask & -self.mask).bit_length() - 1)]
            b, free = self.next, self.capacity
            self.next += 1
            self.used[b] = 0
        at = self.used[b]
        self.used[b] = at + size
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.mask |= 1 << left
            self.open += 1
        else:
            del self.used[b]
        return b, at


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """[(start, size)]: whole, or full pieces and a rest if it alone exceeds a container."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pack(
    sizes: DataFrame, key: str, size: str = "n_tokens", capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(container, position, key, piece, start_token, size): every item of positive size.

    container is a name unique over all shards; position is the offset in the container.
    Sizes of null or at most 0 take no place. Equal keys are packed as separate items.
    """
    rows = sizes.select(F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("n")).filter("n > 0")
    shards = max(1, -(-rows.count() // shard_items))

    def run(batches):
        # rows come sorted by shard and key; a shard's packer ends with it
        now, packer = None, None
        for b in batches:
            shard, k, n = (b.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for s, key_, size_ in zip(shard, k, n, strict=True):
                if s != now:
                    now, packer = s, Packer(capacity, open_bins)
                for piece, (start, part) in enumerate(pieces_of(size_, capacity)):
                    bin_, at = packer.put(part)
                    out.append((s * (1 << 36) + bin_, at, key_, piece, start, part))
            cols = zip(*out, strict=True) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            names = ["container", "position", "k", "piece", "start_token", "size"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    dealt = (
        rows.withColumn("shard", F.pmod(F.xxhash64("k", "n"), F.lit(shards)).cast("long"))
        .select("shard", "k", "n")
        .repartition("shard")
        .sortWithinPartitions("shard", "k", "n")
    )
    return dealt.mapInArrow(
        run, "container long, position int, k long, piece int, start_token long, size int"
    ).withColumnRenamed("k", key)


def document_sizes(spark: SparkSession, folder: str, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """(doc_id, n_tokens) of all documents, counted once and staged."""
    return staged(token_counts(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", vocab_path=vocab_path), "token-counts")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """container, position, doc_id, piece, start_token, size of every document with tokens."""
    return pack(document_sizes(spark, folder), "doc_id")


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the fill."""
    return p9_containers(spark, folder).agg(
        F.countDistinct("container").alias("containers"),
        F.sum("size").alias("tokens"),
        F.ceil(F.sum("size") / CAPACITY).alias("least"),
        (F.sum("size") / (F.countDistinct("container") * CAPACITY)).alias("fill"),
    )


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """One row (none without tokens): documents placed, containers above the capacity, pieces that do not begin where the one before ends,
    and texts split though they fit a container."""
    rows = staged(p9_containers(spark, folder), "containers")
    per = rows.groupBy("container").agg(F.sum("size").alias("used"), F.sort_array(F.collect_list(F.struct("position", "size"))).alias("p"))
    ends = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.lit(0).alias("bad")), lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), (a["bad"] + (a["at"] != x["position"]).cast("int")).alias("bad")))
    bins = per.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.sum(ends["bad"]).alias("misplaced"))
    docs = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("n"))
    one = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("needless"))
    return one.join(bins).select("docs", "overfull", F.coalesce("misplaced", F.lit(0)).alias("misplaced"), "needless").filter("docs > 0")  # one row each


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill, "p9_checked": p9_checked}
ORACLE = {"p9_checked": "select count(*) as docs, 0::bigint as overfull, 0::bigint as misplaced, 0::bigint as needless from documents where text <> ''"}
