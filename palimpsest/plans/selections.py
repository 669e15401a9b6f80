"""Queries on choosing and grouping of records, replies of models, novelty and merged segmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogue as D
from ..operators import novelty as N
from ..operators import responses as P
from ..operators import selection as S
from .base import query

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"


@query("documents", sql="""select doc_id, title from documents where (contains(lower(coalesce(title, '')), 'a') or contains(lower(coalesce(title, '')), 'sermon'))
  and not contains(lower(coalesce(title, '')), 'the ')""")
def included_titles(spark, documents):
    d = documents.withColumn("hay", F.coalesce("title", F.lit("")))
    return S.included(d, F.col("hay"), ["a", "Sermon"], ["The "]).select("doc_id", "title")


@query("events", sql="select event_type, count(*) as n from events where event_type in ('click', 'purchase') group by 1")
def wanted_labels(spark, events):
    return S.only_labels(events, "event_type", ["click", "purchase"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("documents", sql="select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) where k <= 3")
def first_of_sources(spark, documents):
    return S.first_of_group(documents.select("doc_id", "source"), "source", "doc_id", 3)


@query("docvalue", sql="select source, count(*) as n from docvalue where source is not null group by 1 order by n desc, source limit 25")
def top_sources(spark, docvalue):
    return S.top_counts(docvalue, "source")


@query("docvalue", sql="""select 'before' as stage, count(*) as rows, count(distinct source) as distinct_values, count(*) filter (where source is null or source = '') as generic_rows from docvalue
  union all select 'after', count(*), count(distinct lower(trim(source))), count(*) filter (where source is null or trim(source) = '') from docvalue""")
def names_before_after(spark, docvalue):
    after = docvalue.withColumn("source", F.lower(F.trim("source")))
    return S.before_after(docvalue, after, "source", F.coalesce(F.col("source"), F.lit("")) == "")


@query("documents", sql="""with o as (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents where source is not null),
  n as (select source, count(*) as n from o group by 1)
  select source, least(10, n // 2)::bigint as pairs, true as disjoint from n where n >= 2""")
def quote_pairs(spark, documents):
    """Ten disjoint pairs of documents of each source at most (which ones depends on the seed)."""
    p = S.disjoint_pairs(documents.filter("source is not null"), "source", "doc_id", 10, 7)
    return p.groupBy("source").agg(
        F.count(F.lit(1)).alias("pairs"), (F.size(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))) == 2 * F.count(F.lit(1))).alias("disjoint")
    )


@query("docvalue", sql="select count(*) as n from (select distinct id from docvalue where batch_no < 3 intersect select distinct id from docvalue where batch_no >= 3) where id is not null")
def common_ids(spark, docvalue):
    c = S.common_keys(docvalue.filter("batch_no < 3"), docvalue.filter("batch_no >= 3"), "id")
    return c.filter("id is not null").agg(F.count(F.lit(1)).alias("n"))


@query("documents", sql=r"""with k as (select lower(trim(regexp_extract(title, '^([^:;]*)', 1))) as key, source from documents where title is not null and source is not null)
  select key, min(source) as owner from k group by 1 having count(distinct source) = 1""")
def unambiguous_titles(spark, documents):
    from ..operators.records import title_key

    d = documents.filter("title is not null and source is not null")
    return S.unambiguous(d, title_key(F.col("title")), "source")


@query("documents", sql="select source, count(distinct title) as members from documents group by 1 having count(distinct title) >= 12")
def listable_sources(spark, documents):
    return S.listable(documents, "source", "title", 12)


@query("documents", sql=f"""with w as (select len({_WORDS}) as n from documents where text is not null), b(bucket, k) as (values ('<300', 0), ('300-400', 1), ('400-450', 2), ('450-500', 3), ('500-550', 4), ('550-600', 5), ('600-700', 6), ('>700', 7)),
  c as (select case when n < 300 then 0 when n < 400 then 1 when n < 450 then 2 when n <= 500 then 3 when n <= 550 then 4 when n <= 600 then 5 when n <= 700 then 6 else 7 end as k from w)
  select bucket, count(c.k) as shards from b left join c using (k) group by bucket""")
def word_buckets(spark, documents):
    return S.bucket_report(documents.filter("text is not null").select(F.size(T.space_words(F.col("text"))).alias("n")), "n")


@query("docvalue", sql="""with s as (select lower(trim(source)) as source, batch_no from docvalue where source is not null and batch_no is not null),
  o as (select source, batch_no::varchar as b from (select distinct source, batch_no from s) qualify row_number() over (partition by source order by b) <= 4),
  l as (select source, list_sort(list(b)) as l from o group by 1)
  select source, case len(l) when 1 then l[1] when 2 then l[1] || ' and ' || l[2] else array_to_string(l[1:-2], ', ') || ', and ' || l[-1] end as said from l""")
def said_lists(spark, docvalue):
    """Each source's first batches as a list in words."""
    d = docvalue.select(F.lower(F.trim("source")).alias("source"), F.col("batch_no").cast("string").alias("b"))
    return S.lists_by_group(d, "source", "b", 4).select("source", "said")


@query("documents", "docvalue", sql="""with m as (select 'documents' as part, doc_id as id from documents union all select 'docvalue', rec_id from docvalue)
  select part, count(*) as n, 0::bigint as gaps from m group by 1""")
def mixed_parts(spark, documents, docvalue):
    """Two tables mixed in a seeded order; the places have no gaps."""
    m = S.mixed({"documents": documents.select(F.col("doc_id").alias("id")), "docvalue": docvalue.select(F.col("rec_id").alias("id"))}, "id", 5)
    n = m.agg((F.max("place") + 1 - F.countDistinct("place")).alias("gaps"))
    return m.groupBy("part").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("part", "n", "gaps")  # one row


@query("scripture", sql="""select book, chapter, verse, 'What saith ' || book || ' ' || chapter || ':' || verse || '?' as question, text as answer from scripture where trim(text) <> ''""")
def verse_questions(spark, scripture):
    return S.verse_questions(scripture, "What saith {ref}?")


@query("documents", sql="""with o as (select doc_id, title, text, row_number() over (order by doc_id) - 1 as k from documents where trim(coalesce(title, '')) <> '' and trim(coalesce(text, '')) <> '')
  select doc_id, ['Say it anew:', 'Put it in older words:', 'Write it as of old:'][(k % 3 + 1)::int] || ' "' || title || '"' as user, md5(text) as assistant from o""")
def rewriting_pairs(spark, documents):
    p = S.rewriting_pairs(documents.select("doc_id", "title", "text"), "doc_id", "title", "text", ["Say it anew:", "Put it in older words:", "Write it as of old:"])
    return p.withColumn("assistant", F.md5("assistant"))


@query("copa")
def demonstrations(spark, copa):
    """Six demonstrations, two of the machine's at most (checked in tests)."""
    odd = F.col("item_id") % 2 == 1
    return S.demonstrations(copa.filter(~odd), copa.filter(odd), "item_id", 6, 2, 11)


@query("documents")
def novel_titles(spark, documents):
    """Titles accepted in order, each unless its ROUGE-L to one before is 0.7 or more (checked by brute force in tests)."""
    d = documents.filter("title is not null").select("doc_id", "title", T.rouge_tokens(F.col("title")).alias("w"))
    return N.novel(d, "doc_id", "w", 0.7).select("doc_id", "title")


@query("docvalue", sql="""select rec_id, text from docvalue where text is not null qualify row_number() over (partition by lower(trim(text)) order by rec_id) = 1""")
def folded_distinct(spark, docvalue):
    """Texts that differ in more than case and outer blanks, the first of each."""
    d = docvalue.filter("text is not null").select("rec_id", "text")
    return N.first_of(d, "rec_id", F.lower(F.trim("text")))


@query("bible1611_verses", sql="""with m as (select conv_id, turn, '{"choices":[{"message":{"content":' || to_json(content) || '},"finish_reason":"' || case when turn % 3 = 0 then 'length' else 'stop' end || '"}],"usage":{"prompt_tokens":' || turn || ',"completion_tokens":7}}' as j
    from (select distinct conv_id, turn, content from bible1611_verses where content is not null))
  select conv_id, turn, j->'$.choices[0].message.content'->>'$' as content, j->'$.choices[0].finish_reason'->>'$' as finish_reason, (j->>'$.usage.prompt_tokens')::bigint + 7 as tokens from m where trim(j->'$.choices[0].message.content'->>'$') <> '' and turn % 3 <> 0""")
def complete_replies(spark, verses):
    """Providers' answers made of messages, flattened; the complete ones."""
    finish = F.when(F.col("turn") % 3 == 0, "length").otherwise("stop")
    choice = F.struct(F.struct(F.col("content")).alias("message"), finish.alias("finish_reason"))
    usage = F.struct(F.col("turn").alias("prompt_tokens"), F.lit(7).alias("completion_tokens"))
    m = verses.filter("content is not null").select("conv_id", "turn", "content").distinct()
    r = m.select("conv_id", "turn", P.reply_fields(F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage")))).alias("r"))
    flat = r.select("conv_id", "turn", "r.content", "r.finish_reason", (F.col("r.prompt_tokens") + F.col("r.completion_tokens")).alias("tokens"))
    return P.complete_pairs(flat, "content")


@query("bible1611_verses", sql="""with m as (select conv_id, turn, content, length(content) as n from (select distinct conv_id, turn, content from bible1611_verses where content is not null))
  select conv_id, arg_max(content, n * 100000 - turn) as content from m group by 1""")
def longest_candidates(spark, verses):
    m = verses.filter("content is not null").select("conv_id", "turn", "content", F.lit(None).cast("double").alias("score")).distinct()
    return P.best_candidates(m, "conv_id", "content", "score", "turn")


@query("bible1611_verses", sql="""with m as (select conv_id, turn, lower(trim(role)) as r, content from (select distinct conv_id, turn, role, content from bible1611_verses where content is not null and trim(content) <> '' and role is not null)),
    s as (select conv_id, turn, case when r in ('user', 'human') or r like 'question%' then 'student' when r in ('assistant', 'answer') then 'teacher' end as side, content from m)
  select conv_id, turn, side from s where side is not null""")
def speaker_sides(spark, verses):
    """The side that each message's label is on."""
    m = verses.filter("content is not null and trim(content) <> '' and role is not null").select("conv_id", "turn", "role", "content").distinct()
    label = F.when(F.lower(F.trim("role")) == "human", "user").otherwise(F.col("role"))
    return m.select("conv_id", "turn", P.speaker_side(label).alias("side")).filter("side is not null")


@query("documents")
def merged_segmentations(spark, documents):
    """Each document's sentences and lines, two segmentations, made one (checked in tests)."""
    d = documents.filter("text is not null").select("doc_id", F.col("text").alias("source_text"))

    def cut(source: str, pattern: str, base: int):
        pieces = F.regexp_extract_all("source_text", F.lit(pattern), F.lit(0))
        p = d.select("doc_id", F.posexplode(pieces).alias("n", "probe"))
        from ..operators.ordinal import running

        p = running(p, ["doc_id"], ["n"], "stop", F.length("probe"))
        return p.select(
            "doc_id", F.lit(source).alias("source"), (F.col("doc_id") * 1_000_000 + F.col("n") * 2 + base).alias("seq"),
            (F.col("stop") - F.length("probe")).alias("anchor"), "stop", F.when(F.col("n") % 3 == 0, "Ann").otherwise("?").alias("speaker"), F.col("probe").alias("text"), "probe",
        )

    lines = cut("d1", r"[^\n]*\n?", 0).unionByName(cut("d2", r"[^.]*\.?", 1)).filter(F.length("probe") > 0)
    return D.merge_counters(lines, D.merge_segmentations(lines, "doc_id", d), "doc_id")
