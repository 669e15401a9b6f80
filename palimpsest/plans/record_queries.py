"""Queries on records of titles, tasks and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from .base import query

_KEY = r"lower(trim(regexp_extract(title, '^([^:;]*)', 1)))"


@query("documents", sql="select doc_id, source, n_chars from documents qualify n_chars = max(n_chars) over (partition by source) and source is not null")
def best_with_ties(spark, documents):
    return R.best_with_ties(documents.select("doc_id", "source", "n_chars"), "source", "n_chars")


@query("documents", sql=f"""with d as (select doc_id, title, {_KEY} as k, row_number() over (partition by {_KEY} order by doc_id) as n from documents where title is not null)
  select doc_id, title from d where n = 1""")
def ordered_titles(spark, documents):
    d = documents.filter("title is not null").select("doc_id", "title")
    return R.ordered_distinct(d, R.title_key(F.col("title")), "doc_id")


@query("documents", sql=r"""select doc_id, coalesce(length(title) between 3 and 60 and not regexp_matches(title, '^[a-zà-ÿ]') and not
  regexp_matches(title, '(?i)\b(index|contents|preface|introduction|appendix|chapter|volume|page|illustrated by|edition)\b'), false) as ok from documents""")
def plausible_titles(spark, documents):
    return documents.select("doc_id", R.plausible_title(F.col("title")).alias("ok"))


@query("documents", sql=f"""select {_KEY} as key, array_to_string(list_sort(list(distinct source)), '|') as owners, count(distinct source)::int as n
  from documents where title is not null and source is not null group by 1""")
def title_owners(spark, documents):
    d = documents.filter("title is not null and source is not null")
    return R.owners(d, R.title_key(F.col("title")), "source").select("key", F.array_join("owners", "|").alias("owners"), "n")


@query("copa", sql="""select item_id, 'Question: ' || query || chr(10) || array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr(64 + i::int) || '. ' || choices[i]), chr(10)) || chr(10) || 'Answer:' as prompt
  from copa where query is not null and choices is not null""")
def choice_prompts(spark, copa):
    return copa.filter("query is not null and choices is not null").select("item_id", R.choice_prompt(F.col("query"), F.col("choices")).alias("prompt"))


@query("copa")
def few_shots(spark, copa):
    """Three other items for each (checked in tests)."""
    return R.few_shot(copa, "item_id", 3)


@query("documents", sql="""select source, count(*) as centuries from (select distinct source, unnest(range((floor((lo - 1) / 100) + 1)::int, (floor((hi - 1) / 100) + 2)::int)) as c
  from (select source, min(year_est) as lo, max(year_est) as hi from documents where year_est between 1500 and 2000 and source is not null group by 1)) group by 1""")
def source_centuries(spark, documents):
    d = documents.filter("year_est between 1500 and 2000 and source is not null").groupBy("source").agg(F.min("year_est").alias("lo"), F.max("year_est").alias("hi"))
    return R.centuries_of(d, "lo", "hi").groupBy("source").agg(F.count(F.lit(1)).alias("centuries"))


@query("docvalue", sql="""select coalesce(case when text is null then 'no_text' when length(text) < 100 then 'short' when quality < 90 and not isnan(quality) then 'poor' end, 'ok') as reason, count(*) as docs from docvalue group by 1""")
def ordered_rules(spark, docvalue):
    rules = [("no_text", F.col("text").isNull()), ("short", F.length("text") < 100), ("poor", (F.col("quality") < 90) & ~F.isnan("quality"))]
    r = R.reject_reasons(docvalue, rules).withColumn("reason", F.coalesce("reason", F.lit("ok")))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("docs"))
