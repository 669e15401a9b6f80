"""Queries on answers, metrics, vectors and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evals as E
from ..operators import planning as P
from ..operators import similarity as S
from .base import query


def _norm(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+'), lambda t: t not in ('', 'a', 'an', 'the'))"


# answers made from the items: a letter, a cue, a choice's words, an unclear one
_GEN = "case item_id % 4 when 0 then 'I think B. Or A' when 1 then 'the ANSWER is: (a)' when 2 then choices[gold + 1] else 'well, ' || choices[1] || ' it is' end"


def _answers(copa):
    g = F.col("gold")
    m = F.col("item_id") % 4
    gen = (
        F.when(m == 0, F.lit("I think B. Or A")).when(m == 1, F.lit("the ANSWER is: (a)"))
        .when(m == 2, F.try_element_at("choices", g + 1)).otherwise(F.concat(F.lit("well, "), F.try_element_at("choices", F.lit(1)), F.lit(" it is")))
    )
    return copa.withColumn("gen", gen)


@query("copa", sql=f"select item_id, array_to_string({_norm('query')}, ' ') as normalized from copa where query is not null")
def answer_normalize(spark, copa):
    return copa.filter("query is not null").select("item_id", F.array_join(T.answer_tokens(F.col("query")), " ").alias("normalized"))


@query("copa", sql=r"""with g as (select item_id, len(choices) as n, """ + _GEN + r""" as gen from copa),
  x as (select *, upper(regexp_extract(gen, '(?i)answer\s*(?:is)?\s*[:\-]?\s*\(?([A-H])(?:[^A-Za-z]|$)', 1)) as cue,
    list_filter(regexp_extract_all(' ' || gen || ' ', '(?:^|[^A-Za-z])([A-H])(?:[^A-Za-z]|$)', 1), lambda c: ascii(c) - 65 < n) as alone from g)
  select item_id, coalesce(case when cue <> '' and ascii(cue) - 65 < n then ascii(cue) - 65 else ascii(alone[1]) - 65 end, -1) as pred from x where gen is not null""")
def parse_letter(spark, copa):
    a = _answers(copa).filter("gen is not null")
    return a.select("item_id", F.coalesce(E.parse_letter(F.col("gen"), F.size("choices")), F.lit(-1)).alias("pred"))


@query("copa", sql=f"""with g as (select item_id, gold, choices, {_GEN} as gen from copa where choices is not null),
  x as (select item_id, array_to_string({_norm('gen')}, ' ') as o, unnest(range(0, len(choices))) as i, unnest(choices) as c from g where gen is not null),
  y as (select item_id, o, i, array_to_string({_norm('c')}, ' ') as t, len({_norm('c')}) as n from x),
  z as (select item_id, o, i, t, n, t = o as same, t <> o and (contains(o, t) or contains(t, o)) as part from y where n > 0 and o <> ''),
  s as (select item_id, count(*) filter (where same) as ns, min(i) filter (where same) as si, max(n) filter (where part) as top from z group by 1),
  p as (select z.item_id, count(*) as np, min(i) as pi from z join s using (item_id) where part and n = top group by 1)
  select g.item_id, coalesce(case when ns = 1 then si when ns > 1 then null when np = 1 then pi end, -1)::int as pred from g left join s using (item_id) left join p using (item_id)""")
def choice_match(spark, copa):
    a = _answers(copa).filter("choices is not null")
    return a.select("item_id", F.coalesce(E.match_choice(F.col("gen"), F.col("choices")), F.lit(-1)).alias("pred"))


@query("copa", sql=f"""select item_id, case when len({_norm('choices[1]')}) = 0 then len({_norm('query')}) = 0
  else ({_norm('query')})[1:len({_norm('choices[1]')})] = {_norm('choices[1]')} end as ok,
  least(200, greatest(8, greatest(1, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))) * 3 + 8))::int as budget from copa where query is not null and choices[1] is not null""")
def prefix_match(spark, copa):
    d = copa.filter("query is not null").withColumn("c", F.try_element_at("choices", F.lit(1))).filter("c is not null")
    return d.select("item_id", E.begins_with_answer(F.col("query"), F.col("c")).alias("ok"), E.token_budget(F.col("query")).alias("budget"))


_REC = """(select event_type as task, event_id as idx, coalesce(value > 40, false) as correct, event_id % 5 <> 0 as answered,
  case when event_id % 11 = 0 then 'e' || event_id end as error from events)"""


def _records(events):
    return events.select(
        F.col("event_type").alias("task"), F.col("event_id").alias("idx"), F.coalesce(F.col("value") > 40, F.lit(False)).alias("correct"),
        (F.col("event_id") % 5 != 0).alias("answered"), F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("e"), F.col("event_id"))).alias("error"),
    )


@query("events", sql=f"""select task, count(*) as n, round(avg(correct::int), 4) as accuracy, round(avg((not answered)::int), 4) as unparsed,
  round(avg((error is not null)::int), 4) as errors, arg_min(error, idx) filter (where error is not null) as first_error from {_REC} group by task""")
def task_accuracy(spark, events):
    a = E.accuracy(_records(events))
    return a.select("task", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "unparsed", "errors")], "first_error")


@query("events", sql=f"""with a as (select task, avg(correct::int) as acc, (length(task) * 5) % 60 as b from {_REC} group by task),
  c as (select (acc - b / 100.0::double) / (1 - b / 100.0::double) as x from a) select round(avg(x), 4) as core, count(*) as tasks from c""")
def centered_core(spark, events):
    a = E.accuracy(_records(events)).withColumn("b", (F.length("task") * 5) % 60)
    return a.agg(F.round(F.avg(E.centred(F.col("accuracy"), F.col("b"))), 4).alias("core"), F.count(F.lit(1)).alias("tasks"))


@query("events", sql="""with s as (select event_type, list_sort(list(value) filter (where value is not null)) as v from events group by 1)
  select event_type, round(v[least(len(v), floor(len(v) * 0.5::double)::int + 1)], 4) as p50, round(v[least(len(v), floor(len(v) * 0.99::double)::int + 1)], 4) as p99,
  round(list_avg(v), 4) as mean from s""")
def latency_pctl(spark, events):
    e = events.filter("value is not null")
    ranks = E.nearest_ranks(e, "event_type", "value", {"p50": 0.5, "p99": 0.99})
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    return ranks.select("event_type", F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99")).join(mean, "event_type")


@query("docvalue", sql="""with d as (select rec_id, """ + ", ".join(f"case when {c} is null or isnan({c}) then null else {c} end as {c}" for c in ("quality", "entropy", "dicthit")) + """ from docvalue)
  select rec_id, round((coalesce(quality * 0.5::double, 0) + coalesce(entropy * 0.3::double, 0) + coalesce(dicthit * 0.2::double, 0)) /
    nullif(case when quality is null then 0 else 0.5::double end + case when entropy is null then 0 else 0.3::double end + case when dicthit is null then 0 else 0.2::double end, 0), 6) as composite,
  round(case when coalesce(quality, 0) <= 0 then 0 when quality <= 90 then quality / 90 * 50 when quality <= 110 then 50 + (quality - 90) / 20 * 50 else 100 end, 4) as points,
  case when coalesce(quality, 0) >= 105 then 'gold' when coalesce(quality, 0) >= 90 then 'silver' else 'none' end as tier from d""")
def weighted_composite(spark, docvalue):
    q = F.coalesce(F.when(~F.isnan("quality"), F.col("quality")), F.lit(0.0))
    return docvalue.select(
        "rec_id", F.round(E.composite({"quality": 0.5, "entropy": 0.3, "dicthit": 0.2}), 6).alias("composite"),
        F.round(E.ladder(q, [(0.0, 0.0), (90.0, 50.0), (110.0, 100.0)]), 4).alias("points"),
        E.tier(q, [(105.0, "gold"), (90.0, "silver")], "none").alias("tier"),
    )


@query("events", sql="""select event_type, round(avg(exp(-value / 50)), 4) as mean_p, round(median(exp(-value / 50)), 4) as median_p, round(quantile_cont(exp(-value / 50), 0.1), 4) as p10,
  round(avg((exp(-value / 50) < 0.01)::int), 4) as rare, round(exp(avg(value / 50)), 4) as perplexity, round(sum(value / 50) / ln(2) / sum(length(event_type)), 4) as bpb from events where value is not null group by 1""")
def token_stats(spark, events):
    e = events.filter("value is not null").withColumn("lp", -F.col("value") / 50)
    s = E.token_statistics(e, "event_type", "lp").drop("min_p")
    b = e.groupBy("event_type").agg(E.bits_per_byte(F.sum(-F.col("lp")), F.sum(F.octet_length("event_type"))).alias("bpb"))
    return s.join(b, "event_type").select("event_type", *[F.round(c, 4).alias(c) for c in ("mean_p", "median_p", "p10", "rare", "perplexity", "bpb")])


_EW = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"


@query("documents", sql=rf"""with w as (select doc_id, {_EW} as w from documents where text is not null),
  g as (select doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from w where len(w) >= 2)
  select doc_id, round(len(list_distinct(g)) / len(g)::double, 4) as distinct2,
    round(len(list_filter(range(1, len(w) + 1), lambda i: list_contains(w[greatest(1, i - 4):i - 1], w[i]))) / len(w)::double, 4) as echo from g""")
def ngram_distinct(spark, documents):
    w = documents.filter("text is not null").select("doc_id", T.space_words(F.col("text")).alias("w")).filter(F.size("w") >= 2)
    return w.select("doc_id", F.round(E.distinct_share(F.col("w"), 2), 4).alias("distinct2"), F.round(E.echo_rate(F.col("w")), 4).alias("echo"))


@query("documents", "copa")
def rouge_pool(spark, documents, copa):
    """The best ROUGE-L of each document title against the held-out queries (checked in tests)."""
    pool = copa.filter("query is not null").select(T.rouge_tokens(F.col("query")).alias("w"))
    d = documents.filter("title is not null").select("doc_id", T.rouge_tokens(F.col("title")).alias("w"))
    return E.best_rouge(d, pool, "doc_id", "w").select("doc_id", F.round("best", 4).alias("best"))


@query("documents", sql="select doc_id, case when instr(text, '. ') > 0 then substring(text, 1, instr(text, '. ') - 1) else text end as head from documents where text is not null")
def stop_cut(spark, documents):
    return documents.filter("text is not null").select("doc_id", E.cut_at_stop(F.col("text"), [". "]).alias("head"))


_COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-12::double)"


@query("embeddings", sql=f"""with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
  c as (select a.vec_id as q_id, b.vec_id, {_COS} as cosine from e a join e b on a.vec_id <> b.vec_id and a.vec_id % 50 = 0)
  select q_id, vec_id, round(cosine, 4) as cosine, (row_number() over (partition by q_id order by cosine desc, vec_id))::int as rank from c qualify rank <= 5""")
def cosine_topk(spark, embeddings):
    """Five nearest of every vector whose id is divisible by 50, against all."""
    q = embeddings.filter("vec_id % 50 = 0")
    return S.nearest(q, embeddings, "vec_id", "embedding", 5).select("q_id", "vec_id", F.round("cosine", 4).alias("cosine"), "rank")


@query("embeddings", sql=f"""with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null)
  select (select count(*) from e) as n, (select round(avg(sqrt(list_inner_product(v, v))), 4) from e) as mean_norm,
  (select round(avg(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))), 4) + 0.0 from e a join e b on a.vec_id <> b.vec_id) as mean_cosine""")
def embedding_stats(spark, embeddings):
    s = S.vector_statistics(embeddings, "embedding")
    return s.select("n", F.round("mean_norm", 4).alias("mean_norm"), (F.round("mean_cosine", 4) + 0.0).alias("mean_cosine"))


_TEMPLATES = [("summary", "Sum up: {text}"), ("title", "Name it: {text} ({era})")]


@query("documents", sql="""with t(prompt, template) as (values ('summary', 'Sum up: {text}'), ('title', 'Name it: {text} ({era})'))
  select doc_id, prompt, replace(replace(template, '{text}', coalesce(text, '')), '{era}', coalesce(year_est::varchar, '?')) as task from documents, t
  where not (coalesce(year_est, 0) < 1800 and prompt = 'summary')""")
def plan_whole(spark, documents):
    """Every document with every template, less what is done, rendered with the whole text."""
    t = spark.createDataFrame(_TEMPLATES, "prompt string, template string")
    done = documents.filter("coalesce(year_est, 0) < 1800").select("doc_id", F.lit("summary").alias("prompt"))
    tasks = P.plan_tasks(documents.select("doc_id", F.col("text").alias("t"), "year_est"), t, done, ["doc_id", "prompt"])
    text, era = F.coalesce("t", F.lit("")), F.coalesce(F.col("year_est").cast("string"), F.lit("?"))
    return tasks.select("doc_id", "prompt", T.rendered(F.col("template"), text=text, era=era).alias("task"))


@query("documents", sql="select doc_id, ((row_number() over (order by doc_id) - 1) % 6)::int as slot from documents")
def round_robin(spark, documents):
    return P.round_robin(documents.select("doc_id"), "doc_id", 6)


@query("documents", sql="""select a::int as a, op, b::int as b, round(case op when '+' then (a + b)::double when '-' then (a - b)::double when '*' then (a * b)::double
  else a / b::double end, 3) + 0.0 as answer from range(-2, 13) t(a), range(-2, 13) u(b), (values ('+'), ('-'), ('*'), ('/')) v(op) where op <> '/' or b <> 0""")
def arith_grid(spark, documents):
    return P.arithmetic(spark)


@query("events", sql="""with l as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p,
    row_number() over (partition by user_id order by event_id) as n from events)
  select event_id, user_id, event_type from l where n = 1 or p is distinct from event_type""")
def recipe_changes(spark, events):
    return P.changes(events.select("event_id", "user_id", "event_type"), "user_id", "event_id", ["event_type"])


@query("events", sql="""with g as (select user_id, arg_min(value, event_id) as first, arg_max(value, event_id) as last from events where value is not null group by 1)
  select user_id, round(first, 4) as first, round(last, 4) as last, case when last - first > 0.2 then 'rising' when last - first < -0.2 then 'falling' else 'steady' end as drift from g""")
def drift_classes(spark, events):
    d = P.drift(events.filter("value is not null"), "user_id", "event_id", "value")
    return d.select("user_id", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), "drift")
