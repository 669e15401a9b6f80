"""Queries on the document collection: filters, summaries, upserts, merges and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import store as S
from ..operators.ordinal import with_ordinal
from .base import query
from .documents import _GLOBAL, _metric

_C = f"({_metric('quality')} - 100 - abs({_metric('compress')} - 100) - abs({_metric('entropy')} - 100))"
_ALL = ("len", "uniqchar", "tokens", "sentences", "quality", *M.METRICS)


@query("docvalue", sql="""select rec_id, source, len, quality from docvalue where len > 1000 and quality >= 100
  and (source = 'harbour-gazette' or not contains(text, 'captain'))""")
def expr_filter(spark, docvalue):
    e = S.expression("doc.len > 1000 && doc.quality >= 100 && (doc.source === \"harbour-gazette\" || !(doc.text.includes('captain')))")
    return S.select_fields(docvalue.filter(e), ["rec_id", "source", "nothing", "len", "quality"])


@query("docvalue", sql=f"select count(*) filter (where {_GLOBAL} > 80) as matched, count(*) as total, round(count(*) filter (where {_GLOBAL} > 80) * 100.0::double / count(*), 3) as pct from docvalue")
def count_match_pct(spark, docvalue):
    return S.matching(docvalue, M.global_score() > 80)


@query("docvalue", sql=" union all ".join(f"""select '{m}' as metric, round(avg({_metric(m)}), 6) as mean, round(min({_metric(m)})::double, 6) as min,
  round(quantile_cont({_metric(m)}::double, 0.05), 6) as p5, round(quantile_cont({_metric(m)}::double, 0.95), 6) as p95,
  round(max({_metric(m)})::double, 6) as max from (select {m}::double as {m} from docvalue)""" for m in _ALL))
def stats_table(spark, docvalue):
    out = S.metric_summary(docvalue, list(_ALL))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "min", "p5", "p95", "max")])


@query("docvalue")
def stats_sketch(spark, docvalue):
    """The summary with sketched percentiles, for sizes where exact ones cost too much."""
    return S.metric_summary(docvalue, list(_ALL), exact=False)


@query("docvalue", sql="select source, count(*) as docs from docvalue where source <> '' group by source")
def source_counts(spark, docvalue):
    return docvalue.filter("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"))


@query("docvalue", sql="""select (least(127, floor(length(text) / 78.125)))::int as bin, count(*) as docs from docvalue
  where length(text) <= 10000 group by 1""")
def len_histogram(spark, docvalue):
    n = F.length("text")
    return docvalue.filter(n <= 10000).groupBy(F.least(F.lit(127), F.floor(n / 78.125)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("docs"))


@query("docvalue", sql="""select case when c3 >= 100 then c3 * 4096 when c2 >= 100 then c2 * 256 when c1 >= 100 then c1 * 16 else n end as estimate,
  n as exact from (select count(*) filter (where id like '000%') c3, count(*) filter (where id like '00%') c2,
  count(*) filter (where id like '0%') c1, count(*) n from docvalue)""")
def estimate_count(spark, docvalue):
    return S.estimate_count(docvalue)


@query("docvalue", sql="""select 'next10' as nav, id from (select * from (select distinct id from docvalue where id > '4' order by id limit 10) order by id desc limit 1)
  union all select 'prev', id from (select distinct id from docvalue where id < '4' order by id desc limit 1)
  union all select 'first', min(id) from docvalue union all select 'last', max(id) from docvalue
  union all select 'random', coalesce((select min(id) from docvalue where id >= 'fff8'), (select min(id) from docvalue))""")
def key_nav(spark, docvalue):
    ids = docvalue.filter("id is not null").select("id").distinct()
    steps = {"next10": "4", "prev": "4", "first": "", "last": "", "random": "fff8"}
    out = None
    for nav, key in steps.items():
        r = S.navigate(ids, key, nav).select(F.lit(nav).alias("nav"), "id")
        out = r if out is None else out.unionByName(r)
    return out


@query("docvalue", sql="select rec_id, id from docvalue where id in (select id from docvalue where batch_no = 3)")
def multi_get(spark, docvalue):
    keys = docvalue.filter("batch_no = 3 and id is not null").select("id").distinct()
    return S.by_keys(docvalue, keys).select("rec_id", "id")


@query("docvalue", sql="select rec_id, id, quality from docvalue where quality > 100 order by id, rec_id limit 100")
def first_by_key(spark, docvalue):
    return docvalue.filter("quality > 100").orderBy("id", "rec_id").limit(100).select("rec_id", "id", "quality")


@query("docvalue", sql="""select case source when 'harbour-gazette' then 'gazette' when 'hymn-sheets' then 'hymns' else source end as source,
  count(*) as docs, sum(case when source in ('harbour-gazette', 'hymn-sheets') then 1 else 0 end)::bigint as changed from docvalue group by 1""")
def rename_sources(spark, docvalue):
    mapping = {"harbour-gazette": "gazette", "hymn-sheets": "hymns"}
    before = docvalue.withColumn("old", F.col("source"))
    return S.rename_sources(before, mapping).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(~F.col("source").eqNullSafe(F.col("old"))).alias("changed")
    )


@query("docvalue", sql="select count(*) filter (where source is distinct from 'x') as changed, count(*) as total from docvalue")
def set_source(spark, docvalue):
    return S.set_source(docvalue, "x")[1]


@query("documents", sql=r"""select regexp_replace(text, '\W+', ' ', 'g') as normalized, count(*) as copies, min(doc_id) as first_id
  from documents where text is not null group by 1 having count(*) > 1""")
def dedup_exact(spark, documents):
    from ..functions.text import normalized

    # the text itself is only carried for the groups of more than one
    d = documents.filter("text is not null").select("doc_id", normalized(F.col("text")).alias("normalized"))
    groups = d.groupBy(F.sha2("normalized", 256).alias("h")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")
    ).filter("copies > 1")
    return groups.join(d, groups["first_id"] == d["doc_id"]).select("normalized", "copies", "first_id")


@query("docvalue", sql=f"""with b as (select *, (batch_no >= 5)::int as late, {_C} as cs from docvalue
    where id is not null and text is not null and batch_no is not null),
  f as (select * from b qualify row_number() over (partition by id, text order by late, rec_id) = 1),
  m as (select id, text, max(cs) as ms from b group by 1, 2),
  w as (select f.id, f.rec_id, f.source from f join m using (id, text)
    qualify row_number() over (partition by f.id order by m.ms desc, f.late desc, f.rec_id desc) = 1)
  select id, rec_id, source from w""")
def upsert_resolve(spark, docvalue):
    d = docvalue.filter("id is not null and text is not null and batch_no is not null").withColumn("seq", F.col("rec_id"))
    late = F.col("batch_no") >= 5
    return S.upsert(d.filter(~late), d.filter(late)).select("id", "rec_id", "source")


@query("docvalue", sql=f"""select id, rec_id, rec_id % 3 as src from docvalue where id is not null
  qualify row_number() over (partition by id order by {_GLOBAL} desc, rec_id % 3, rec_id) = 1""")
def merge_best(spark, docvalue):
    d = docvalue.filter("id is not null").withColumn("src", F.col("rec_id") % 3)
    return S.merge_best(d, "src", "rec_id").select("id", "rec_id", "src")


@query("docvalue", sql=f"""with p as (select id, rec_id % 3 as src, max({_GLOBAL}) as s, count(*) as n from docvalue where id is not null group by 1, 2),
  q as (select *, max(s) over (partition by id order by src rows between unbounded preceding and 1 preceding) as b from p)
  select src, sum(n)::bigint as scanned, sum(n - 1)::bigint as collapsed, count(*) filter (where b is null) as new,
  count(*) filter (where s > b) as replaced, count(*) filter (where s <= b) as kept from q group by src""")
def merge_report(spark, docvalue):
    d = docvalue.filter("id is not null").withColumn("src", F.col("rec_id") % 3)
    return S.merge_report(d, "src")


@query("docvalue", sql="""with h as (select distinct id from docvalue where dicthit < 50 and not isnan(dicthit) and id is not null order by id limit 100)
  select count(*) as left_over, count(distinct id) as ids from docvalue where id is null or id not in (select id from h)""")
def delete_by_expr(spark, docvalue):
    out = S.delete_where(docvalue, (F.col("dicthit") < 50) & ~F.isnan("dicthit") & F.col("id").isNotNull())
    return out.agg(F.count(F.lit(1)).alias("left_over"), F.countDistinct("id").alias("ids"))


@query("docvalue")
def edit_rekey(spark, docvalue):
    """One record's text replaced; the new record with its metrics (checked in tests)."""
    ids = docvalue.filter("id is not null").dropDuplicates(["id"])
    key = ids.agg(F.min("id")).first()[0] or ""
    text = "The mill stood by the river, and the miller praised it. It was a fine day!"
    return S.edit_text(ids, key, text).filter(F.col("text") == text).select("id", "len", "tokens", "sentences", "quality", "entropy")


@query("documents", sql="""select doc_id, format('documents-{:04d}.jsonl', ((row_number() over (order by doc_id) - 1) // 300 + 1)::int) as shard from documents""")
def export_shards(spark, documents):
    d = with_ordinal(documents.select("doc_id"), "doc_id")
    shard = F.floor((F.col("ordinal") - 1) / 300) + 1
    return d.select("doc_id", F.format_string("documents-%04d.jsonl", shard.cast("int")).alias("shard"))


@query("documents", sql="""with o as (select *, row_number() over (order by doc_id) as n from documents),
  v as (select *, row_number() over (order by n) as k from o where n > 50 and length(text) > 100)
  select doc_id, k::bigint as place from v where k <= 200""")
def offset_limit(spark, documents):
    """Offset counts raw rows, the limit valid ones."""
    o = with_ordinal(documents.select("doc_id", F.length("text").alias("n_text")), "doc_id").filter("ordinal > 50 and n_text > 100")
    return with_ordinal(o.select("doc_id"), "doc_id", name="place").filter("place <= 200")


@query("docvalue", sql="select min(id) as first_id, max(id) as last_id, count(*) as records from docvalue")
def store_info(spark, docvalue):
    return S.store_info(docvalue)


@query("docvalue", sql="""select coalesce(source, 'ALL') as source, count(*) as loaded, count(*) filter (where text is null) as dropped,
  count(*) filter (where length(text) <= 100) as short from docvalue where source is not null group by rollup(source)""")
def ingest_counters(spark, docvalue):
    return (
        docvalue.filter("source is not null")
        .rollup("source")
        .agg(
            F.count(F.lit(1)).alias("loaded"),
            F.count_if(F.col("text").isNull()).alias("dropped"),
            F.count_if(F.length("text") <= 100).alias("short"),
        )
        .withColumn("source", F.coalesce("source", F.lit("ALL")))
    )


@query("docvalue", sql="""select rec_id, json_extract_string(extra, '$.title') as title, json_extract_string(extra, '$.year') as year
  from docvalue where extra is not null and (json_extract_string(extra, '$.title') is not null or json_extract_string(extra, '$.year') is not null)""")
def extra_fields(spark, docvalue):
    """Whitelisted extra fields; rows without any are left out."""
    m = F.from_json("extra", "map<string,string>")
    kept = F.map_filter(m, lambda k, v: k.isin("title", "year") & v.isNotNull())
    out = docvalue.filter("extra is not null").select("rec_id", kept.alias("m")).filter(F.size("m") > 0)
    return out.select("rec_id", F.col("m")["title"].alias("title"), F.col("m")["year"].alias("year"))
