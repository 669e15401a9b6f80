"""Problem 3: a score cutoff per source that keeps a target fraction of its records.

Scores are coded as order-preserving 64-bit integers. A dyadic count tree holds, for every
source, the number of records under each node; of the 64 halvings every eighth level down
to LEAF_BITS is stored, so that a node has at most 256 stored children. The tree is a table
at a path: each batch appends its own node counts (`append_batch`), and reading sums them
(`stored_tree`), so cutoffs after a batch cost no second look at the batches before. A target
rank is found by descending from the root; the leaf that holds it is refined to its distinct
scores, again by eight halvings at a time down to 64 bits. Each step looks at no more than
256 rows of a source, so no group of records ever meets in one task, however much of the
data one source holds.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir, staged
from ..tables import table

#: Stored levels, in leading bits of the code; the last is the leaf level.
LEVELS = (8, 16, 24, 32)
LEAF_BITS = LEVELS[-1]


def source_key(c: Column) -> Column:
    """Sources are compared without outer white space and case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def score_code(c: Column) -> Column:
    """Order-preserving BIGINT of a double (-0.0 is 0.0); null and NaN give null."""
    d = F.when(F.isnan(c), F.lit(None)).otherwise(F.abs(c))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), d).cast("long")
    return F.when(d.isNotNull(), F.when(c < 0.0, -bits).otherwise(bits))


def node(code: Column, bits: int) -> Column:
    """The tree node of a code at a level: its leading bits, as a signed number."""
    return F.shiftright(code, 64 - bits)


def coded(docs: DataFrame, id_col: str, source: str = "source", score: str = "score") -> DataFrame:
    """(id, src, score, code) of the records that count: source known, score neither null nor NaN."""
    return (
        docs.select(
            F.col(id_col).alias("id"),
            source_key(F.col(source)).alias("src"),
            F.col(score).cast("double").alias("score"),
            score_code(F.col(score).cast("double")).alias("code"),
        )
        .filter(F.col("src").isNotNull() & F.col("code").isNotNull())
    )


def build_tree(rows: DataFrame) -> DataFrame:
    """(src, level, node, cnt): the count tree of coded rows; one shuffle of leaf counts."""
    leaf = rows.groupBy("src", node(F.col("code"), LEAF_BITS).alias("leaf")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node")),
        *[
            F.struct(F.lit(b).alias("level"), F.shiftright("leaf", LEAF_BITS - b).alias("node"))
            for b in LEVELS
        ],
    )
    return (
        leaf.select("src", "cnt", F.explode(levels).alias("x"))
        .groupBy("src", "x.level", "x.node")
        .agg(F.sum("cnt").alias("cnt"))
    )


def add_batch(tree: DataFrame, batch: DataFrame) -> DataFrame:
    """The tree with another batch's node counts added."""
    return (
        tree.select("src", "level", "node", "cnt")
        .unionByName(batch.select("src", "level", "node", "cnt"))
        .groupBy("src", "level", "node")
        .agg(F.sum("cnt").alias("cnt"))
    )


def append_batch(rows: DataFrame, path: str) -> None:
    """Add the node counts of a batch of coded rows to the tree kept at a path (made if it is not there)."""
    build_tree(rows).write.mode("append").parquet(path)


def stored_tree(spark: SparkSession, path: str) -> DataFrame:
    """The tree kept at a path: the sums of its batches' node counts."""
    parts = spark.read.schema("src string, level int, node long, cnt long").parquet(path)
    return parts.groupBy("src", "level", "node").agg(F.sum("cnt").alias("cnt"))


def targets(sources: DataFrame) -> DataFrame:
    """(src, pct): sources with a share; of equal keys the largest share counts."""
    return (
        sources.select(source_key(F.col("source")).alias("src"), F.col("keep_pct").cast("long").alias("pct"))
        .filter(F.col("src").isNotNull() & F.col("pct").isNotNull())
        .groupBy("src")
        .agg(F.max("pct").alias("pct"))
    )


def _descend(level: DataFrame, wanted: DataFrame) -> DataFrame:
    """One step: children (src, node, cnt, up) of the nodes wanted (src, rank), to the child
    holding the rank counted from the top, with the rank left inside of it."""
    w = W.partitionBy("src").orderBy(F.col("node").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        level.join(wanted, ["src", "up"])
        .withColumn("cum", F.sum("cnt").over(w))
        .filter((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("cnt") < F.col("rank")))
        .select("src", "node", (F.col("rank") - F.col("cum") + F.col("cnt")).alias("rank"))
    )


def cutoffs(rows: DataFrame, tree: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, pct, n, k, cutoff, code): one row per source with a share.

    n counts the records, k = ceil(n * pct / 100) held within 0..n; cutoff is the k-th
    highest score and null if k is 0 (a source without records, or a share of 0).
    """
    t = targets(sources)
    root = tree.filter("level = 0").select("src", F.col("cnt").alias("n"))
    plan = t.join(root, "src", "left").select(
        "src",
        "pct",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
    plan = plan.withColumn("k", F.expr("greatest(0L, least(n, (n * pct + 99) div 100))"))
    at = plan.filter("k > 0").select("src", F.lit(0).cast("long").alias("up"), F.col("k").alias("rank"))
    for i, bits in enumerate(LEVELS):
        step = bits - (LEVELS[i - 1] if i else 0)
        up = F.shiftright("node", step) if i else F.lit(0).cast("long")
        level = tree.filter(F.col("level") == bits).select("src", "node", "cnt", up.alias("up"))
        at = _descend(level, at).select("src", F.col("node").alias("up"), "rank")
    inside = rows.select("src", "code", node(F.col("code"), LEAF_BITS).alias("leaf"))
    codes = staged(
        inside.join(at.select("src", F.col("up").alias("leaf")), ["src", "leaf"], "left_semi").groupBy("src", "code").agg(F.count(F.lit(1)).alias("cnt")),
        "score-leaves",
    )
    for bits in range(LEAF_BITS + 8, 65, 8):
        level = codes.groupBy("src", node(F.col("code"), bits).alias("node")).agg(F.sum("cnt").alias("cnt"))
        at = _descend(level.withColumn("up", F.shiftright("node", 8)), at).select("src", F.col("node").alias("up"), "rank")
    cut = at.select("src", F.col("up").alias("code"))
    cut = (
        cut.join(rows.select("src", "code", "score"), ["src", "code"])
        .groupBy("src", "code")
        .agg(F.max("score").alias("cutoff"))
    )
    return plan.join(cut, "src", "left").select("src", "pct", "n", "k", "cutoff", "code")


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, folder, "docvalue").select("rec_id", "source", "score", "batch_no")
    rows = coded(docs, "rec_id")
    sources = table(spark, folder, "sources")
    # the tree is the table that later batches are added to
    tree = staged(build_tree(rows), "score-tree")
    return rows, tree, staged(cutoffs(rows, tree, sources), "score-cutoffs")


def p3_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """source, keep_pct, n, k, cutoff, kept of every source with a keep_pct."""
    rows, _, cuts = _parts(spark, folder)
    kept = (
        rows.join(cuts.filter("code is not null").select("src", F.col("code").alias("least")), "src")
        .filter("code >= least")
        .groupBy("src")
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    return cuts.join(kept, "src", "left").select(
        F.col("src").alias("source"),
        F.col("pct").alias("keep_pct"),
        "n",
        "k",
        "cutoff",
        F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id of the kept records."""
    rows, _, cuts = _parts(spark, folder)
    least = cuts.filter("code is not null").select("src", F.col("code").alias("least"))
    return rows.join(least, "src").filter("code >= least").select(F.col("id").cast("long").alias("rec_id"))


def p3_tree_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The tree kept at a path, batch by batch (even, then odd batch numbers), as source, level, node, cnt."""
    docs = table(spark, folder, "docvalue").select("rec_id", "source", "score", "batch_no")
    odd = F.coalesce(F.pmod("batch_no", F.lit(2)), F.lit(0)) == 1
    path = f"{shared_dir(spark)}/score-tree-{uuid4().hex}"
    for p in (~odd, odd):
        append_batch(coded(docs.filter(p), "rec_id"), path)
    return stored_tree(spark, path).select(F.col("src").alias("source"), "level", "node", "cnt")


def p3_cutoffs_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """source, k, cutoff after all batches, from the tree kept at a path that each batch was appended to."""
    docs = table(spark, folder, "docvalue").select("rec_id", "source", "score", "batch_no")
    rows = coded(docs, "rec_id")
    path = f"{shared_dir(spark)}/score-tree-{uuid4().hex}"
    half = F.coalesce(F.col("batch_no"), F.lit(0)) < 5
    for p in (half, ~half):
        append_batch(coded(docs.filter(p), "rec_id"), path)
    out = cutoffs(rows, stored_tree(spark, path), table(spark, folder, "sources"))
    return out.select(F.col("src").alias("source"), "k", "cutoff")


_RANKED = r"""
with r as (
  select rec_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as src, score
  from docvalue where score is not null and not isnan(score)
), t as (
  select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as src, max(keep_pct)::bigint as pct
  from sources where keep_pct is not null and source is not null group by 1
), n as (select src, count(*) as n from r where src is not null group by 1),
k as (
  select t.src, t.pct, coalesce(n.n, 0)::bigint as n,
    greatest(0, least(coalesce(n.n, 0), (coalesce(n.n, 0) * t.pct + 99) // 100))::bigint as k
  from t left join n using (src)
), o as (
  select r.*, row_number() over (partition by src order by score desc) as rn from r where src is not null
), c as (select k.*, o.score as cutoff from k left join o on o.src = k.src and o.rn = k.k)
"""
ORACLE = {
    "p3_found": _RANKED + "select r.rec_id from r join c using (src) where r.score >= c.cutoff",
    "p3_cutoffs": _RANKED
    + """select c.src as source, c.pct as keep_pct, c.n, c.k, c.cutoff,
    (select count(*) from r where r.src = c.src and r.score >= c.cutoff) as kept from c""",
}
ORACLE["p3_cutoffs_by_batch"] = _RANKED + "select src as source, k, cutoff from c"
ORACLE["p3_tree_by_batch"] = r"""
with c as (
  select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as source,
    case when score < 0 then -1 else 1 end * (abs(score)::double)::bit::bigint as code
  from docvalue where source is not null and score is not null and not isnan(score)
)""" + " union all ".join(
    f"select source, {b} as level, {f'code >> {64 - b}' if b else '0'}::bigint as node, count(*) as cnt from c group by all" for b in (0, *LEVELS)
)
QUERIES = {"p3_found": p3_found, "p3_cutoffs": p3_cutoffs, "p3_tree_by_batch": p3_tree_by_batch, "p3_cutoffs_by_batch": p3_cutoffs_by_batch}
