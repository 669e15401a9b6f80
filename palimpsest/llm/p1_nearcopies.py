"""Problem 1: records that are nearly the same text.

Every text gets a 128-bit SimHash of its word shingles and MinHash bands. A band's value
names the shard a text belongs to; each shard holds a BK-tree of fingerprints, children
keyed by their integer Hamming distance to the parent, and a search follows only the edges
within RADIUS. What the trees return is verified by the exact Jaccard similarity of the
shingle sets. Shard trees stand where their shard lies: fingerprints of all texts have no
bound and are never broadcast. A shard above BLOCK texts is cut into blocks, and every
pair of blocks has its own tree, so no task holds more than two blocks.

Exact copies (equal word sequences) are one class; trees, candidates and verification see
only the class's representative, its smallest id.

Null, empty and short texts (under min_words) are in no class and no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..tables import spread, table
from .words import mix, shingle_hashes, small_batches, word_hashes, words

#: Fixed by the problem: word triples, similarity, least number of words.
SHINGLE, SIMILARITY, MIN_WORDS = 3, 0.6, 20
#: 48 bands of 4 values: two texts share a shard with probability 0.9987 at similarity 0.6,
#: 0.9999 at 0.65; texts of a similarity of 0.02, as any two have here, with 0.000008.
BANDS, ROWS = 48, 4
#: Hamming radius over 128 bits: at similarity 0.6 the expected distance is 29 and its
#: deviation 4.8, so 0.9997 lie within it; of unlike texts (62, 5.6) it lets pass one in some hundreds.
RADIUS = 46
#: Texts of a shard that share a tree.
BLOCK = 2048
#: The filter that spares texts without candidates the verification's shingling has so many
#: bits for each id; where that is more than BLOOM_MOST bits (8 MB), a semi-join is made instead.
BLOOM_PER_ID, BLOOM_MOST, BLOOM_SEEDS = 16, 1 << 26, (1, 2, 3)
#: Bytes of the filter that are put together in one place.
BLOOM_CHUNK = 1 << 16


class BKTree:
    """Fingerprints under their Hamming distance."""

    def __init__(self):
        self.fps: list[int] = []
        self.ids: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, fp: int, id_: int) -> None:
        new = len(self.fps)
        if new:
            at = 0
            while True:
                d = (self.fps[at] ^ fp).bit_count()
                nxt = self.kids[at].get(d)
                if nxt is None:
                    self.kids[at][d] = new
                    break
                at = nxt
        self.fps.append(fp)
        self.ids.append(id_)
        self.kids.append({})

    def within(self, fp: int, radius: int) -> list[int]:
        """Ids of all fingerprints at most `radius` away."""
        out, todo = [], [0] if self.fps else []
        while todo:
            at = todo.pop()
            d = (self.fps[at] ^ fp).bit_count()
            if d <= radius:
                out.append(self.ids[at])
            for edge, kid in self.kids[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(kid)
        return out


def _signatures(shingles: np.ndarray, n: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band values (texts, bands), SimHash (texts, 2)); every text has a shingle."""
    starts = np.cumsum(n) - n
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    # 32 bits suffice for a minimum over one text's shingles, and are twice as fast
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    values = np.zeros((len(n), bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat(short * a[k] + b[k], starts)
        values[:, k // rows] = mix(values[:, k // rows] * np.uint64(31) + low)
    sim = np.zeros((len(n), 2), np.uint64)
    for k, h in enumerate((shingles, mix(shingles))):
        ones = np.zeros((len(n), 64), np.int64)
        # some 30 MB of bits at a time, however long a text is
        for low in range(0, len(h), 500_000):
            part = h[low : low + 500_000]
            first = np.searchsorted(starts, low, "right") - 1
            last = np.searchsorted(starts, low + len(part) - 1, "right") - 1
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.maximum(starts[first : last + 1] - low, 0)
            ones[first : last + 1] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        sim[:, k] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return values, sim


def features(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k1, k2, s1, s2, bands) of every text of enough words."""

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, 1, 2_000_000):
                ws = [words(t) for t in b.column(1).to_pylist()]
                keep = [i for i, w in enumerate(ws) if len(w) >= max(min_words, shingle)]
                if not keep:
                    continue
                ws = [ws[i] for i in keep]
                h, counts = word_hashes(ws)
                sh, n = shingle_hashes(h, counts, shingle)
                values, sim = _signatures(sh, n, BANDS, ROWS)
                key128 = [xxhash.xxh3_128_digest("\n".join(w)) for w in ws]
                k = np.frombuffer(b"".join(key128), np.int64).reshape(-1, 2)
                off = pa.array(np.arange(len(ws) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(keep)),
                        pa.array(k[:, 0]),
                        pa.array(k[:, 1]),
                        pa.array(np.ascontiguousarray(sim[:, 0]).view(np.int64)),
                        pa.array(np.ascontiguousarray(sim[:, 1]).view(np.int64)),
                        pa.ListArray.from_arrays(off, pa.array(values.view(np.int64).ravel())),
                    ],
                    ["id", "k1", "k2", "s1", "s2", "bands"],
                )

    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).filter("t is not null and id is not null")
    return src.mapInArrow(run, "id long, k1 long, k2 long, s1 long, s2 long, bands array<long>")


def _shard_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: pairs within the radius in rows (bucket, bi, bj, own, id, s1, s2) by tree."""

    def run(batches):
        # groups are contiguous within the partition; the last one of a batch may go on
        rest = None
        for b in batches:
            t = np.stack([np.asarray(b.column(i)) for i in range(7)], axis=1)
            if rest is not None:
                t = np.concatenate([rest, t])
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(1)) + 1
            last = cut[-1] if len(cut) else 0
            rest = t[last:]
            yield pairs(t[:last], cut[:-1] if len(cut) else cut)
        if rest is not None:
            yield pairs(rest, np.zeros(0, np.int64))

    def pairs(t, cut):
        starts = np.concatenate([[0], cut]).astype(np.int64) if len(t) else np.zeros(0, np.int64)
        ends = np.concatenate([cut, [len(t)]]).astype(np.int64) if len(t) else starts
        size = ends - starts
        # a shard of two texts: the tree is its root
        two = starts[size == 2]
        two = two[t[two, 1] == t[two, 2]] if len(two) else two
        d = np.bitwise_count((t[two, 5:7] ^ t[two + 1, 5:7]).view(np.uint64)).sum(1)
        two = two[d <= radius]
        out_a, out_b = [t[two, 4]], [t[two + 1, 4]]
        for s, e in zip(starts[size > 1].tolist(), ends[size > 1].tolist(), strict=True):
            if e - s == 2 and t[s, 1] == t[s, 2]:
                continue
            tree, a, c = BKTree(), [], []
            same = t[s, 1] == t[s, 2]
            ids, own = t[s:e, 4].tolist(), t[s:e, 3].tolist()
            halves = t[s:e, 5:7].astype(np.int64).view(np.uint64).tolist()
            fps = [(x << 64) | y for x, y in halves]
            if same:
                for fp, i in zip(fps, ids, strict=True):
                    near = tree.within(fp, radius)
                    a += [i] * len(near)
                    c += near
                    tree.add(fp, i)
            else:
                for fp, i, o in zip(fps, ids, own, strict=True):
                    if o == t[s, 1]:
                        tree.add(fp, i)
                for fp, i, o in zip(fps, ids, own, strict=True):
                    if o != t[s, 1]:
                        near = tree.within(fp, radius)
                        a += [i] * len(near)
                        c += near
            out_a.append(np.array(a, np.int64))
            out_b.append(np.array(c, np.int64))
        x, y = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _heavy_buckets(hits: DataFrame, texts: int, block: int) -> DataFrame | None:
    """(bucket, n) of the buckets of more than `block` rows; None if there are none.

    Rows are first counted by hash cells, few enough for map-side counting to pay; a cell
    bounds all its buckets. Only rows of overfull cells are counted by bucket.
    """
    cells = 1 << max(10, (texts * BANDS // 64).bit_length())
    cell = F.pmod("bucket", F.lit(cells)).cast("int").alias("cell")
    full = hits.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("cell")
    full = staged(full, "near-cells")
    if full.isEmpty():
        return None
    inside = hits.select("bucket", cell).join(full, "cell", "left_semi")
    heavy = staged(inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "near-heavy")
    return None if heavy.isEmpty() else heavy


def candidate_pairs(reps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, distinct: representatives that meet in a shard's tree within the radius."""
    hits = reps.select("id", "s1", "s2", F.posexplode("bands").alias("pos", "v")).select(
        F.xxhash64("pos", "v").alias("bucket"), "id", "s1", "s2"
    )
    zero = F.lit(0).cast("long")
    heavy = _heavy_buckets(hits, reps.count(), block)
    if heavy is None:
        rows = hits.select("bucket", zero.alias("bi"), zero.alias("bj"), zero.alias("own"), "id", "s1", "s2")
        return _shard_pairs(rows.repartition("bucket").sortWithinPartitions("bucket"), radius).distinct()
    cut = hits.join(heavy, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = cut.select(
        "bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", "s1", "s2"
    )
    rows = rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    return _shard_pairs(rows, radius).distinct()


def _bloom(ids: DataFrame, bits: int) -> bytes:
    """A Bloom filter of `bits` bits over a column of ids, its chunks put together by the executors."""
    step = min(BLOOM_CHUNK, bits // 8)

    def mark(batches):
        seen = np.zeros(bits, bool)
        for b in batches:
            for seed in BLOOM_SEEDS:
                seen[_bloom_cells(np.asarray(b.column(0)), seed, bits)] = True
        packed = np.packbits(seen)
        some = [k for k in range(0, len(packed), step) if packed[k : k + step].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([packed[k : k + step].tobytes() for k in some], pa.binary())], ["at", "bits"]
        )

    def unite(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts[k] = parts.get(k, np.uint8(0)) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["at", "bits"]
        )

    schema = "at long, bits binary"
    out = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(mark, schema).repartition("at").mapInArrow(unite, schema).collect():
        out[r["at"] : r["at"] + step] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def _bloom_cells(ids: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed)) % np.uint64(bits)).astype(np.int64)


def shingle_sets(df: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, shingles ARRAY<INT>) of rows (id, t): the distinct shingles, as 32-bit hashes.

    Rows whose id is surely not in wanted (id) are left out; a few others may remain. The
    filter grows with the ids up to its bound; beyond, the texts are semi-joined to them.
    """
    bits = max(BLOOM_CHUNK, 1 << (BLOOM_PER_ID * wanted.count()).bit_length())
    if bits > BLOOM_MOST:
        df, bits = df.join(wanted.toDF("id").distinct(), "id", "left_semi").select("id", "t"), 0
    bloom = df.sparkSession.sparkContext.broadcast(_bloom(wanted, bits) if bits else b"")

    def run(batches):
        seen = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool)
        for all_ in batches:
            ids = np.asarray(all_.column(0))
            keep = np.ones(len(ids), bool)
            for seed in BLOOM_SEEDS if bits else ():
                keep &= seen[_bloom_cells(ids, seed, bits)]
            whole = all_.filter(pa.array(keep))
            for b in small_batches(whole, 1, 2_000_000) if whole.num_rows else ():
                h, counts = word_hashes([words(t) for t in b.column(1).to_pylist()])
                sh, n = shingle_hashes(h, counts, shingle)
                low = (sh >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ends = np.cumsum(n)
                sets = [np.unique(low[e - k : e]) for e, k in zip(ends, n, strict=True)]
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["id", "shingles"]
                )

    return df.mapInArrow(run, "id long, shingles array<int>")


def near_copies(
    df: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS, radius: int = RADIUS, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of class representatives of at least the
    similarity, and members (id, rep), one row for each text of enough words.

    Ids must be unique; a repeated id with another text would be one record.
    """
    feats = staged(features(df, key, text, shingle, min_words), "near-features")
    classes = feats.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    first = F.col("id") == F.col("rep")
    members = staged(
        feats.join(classes.hint("merge"), ["k1", "k2"]).select(
            "id", "rep", *[F.when(first, F.col(c)).alias(c) for c in ("s1", "s2", "bands")]
        ),
        "near-members",
    )
    reps = members.filter("id = rep").select("id", "s1", "s2", "bands")
    cand = staged(candidate_pairs(reps, radius, block), "near-candidates")
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null")
    sets = staged(shingle_sets(texts, cand.select(F.explode(F.array("a", "b"))), shingle), "near-sets")
    # the sides grow with the data, so none is broadcast
    both = cand.join(sets.hint("merge").select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.hint("merge").select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    sim = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n")).select(
        "a", "b", (F.col("c") / (F.col("n") - F.col("c"))).alias("similarity")
    )
    return staged(sim.filter(F.col("similarity") >= similarity), "near-pairs"), members.select("id", "rep")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, similarity: pairs of class representatives of at least 0.6."""
    return near_copies(spread(table(spark, folder, "docvalue").select("rec_id", "text")), "rec_id")[0]


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id, class_id: one row for each record of at least 20 words; copies share a class."""
    members = near_copies(spread(table(spark, folder, "docvalue").select("rec_id", "text")), "rec_id")[1]
    return members.select(F.col("id").alias("rec_id"), F.col("rep").alias("class_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id_a < rec_id_b of every pair of records, copies included."""
    pairs, members = near_copies(spread(table(spark, folder, "docvalue").select("rec_id", "text")), "rec_id")
    left = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    other = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    same = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return other.unionByName(same).select(
        F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")
    )


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_members": p1_members}
ORACLE = {
    "p1_found": r"""
with w as (select rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from docvalue where text is not null),
t as (select distinct rec_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select rec_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 20)),
n as (select rec_id, count(*) as n from t group by 1),
c as (select a.rec_id as a, b.rec_id as b, count(*) as c from t a join t b on a.t = b.t and a.rec_id < b.rec_id group by 1, 2)
select c.a as rec_id_a, c.b as rec_id_b from c join n x on x.rec_id = c.a join n y on y.rec_id = c.b where c.c >= 0.6::double * (x.n + y.n - c.c) - 1e-9"""
}
