"""Queries on evaluation runs, provenance, ingest counters, and files of shards and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import runs as R
from ..operators import store as S
from ..session import staged
from ..sources import readers, writers
from .base import query
from .flows import _folder

# token losses made of a text: the length of each word over ten
_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"
_NLL = f"list_transform({_W}, lambda w: length(w) / 10.0::double)"


def _losses(documents):
    w = T.space_words(F.col("text"))
    return documents.filter("text is not null").select(
        "doc_id", "text", w.alias("w"), F.transform(w, lambda x: F.length(x) / 10.0).alias("nll"), F.transform(w, F.octet_length).alias("n_bytes")
    )


@query("documents", sql=f"""with w as (select {_W} as w from documents where text is not null), x as (select w[1:1024] as w from w where len(w) >= 8)
  select count(*) as texts, round(sum(list_sum(list_transform(w, lambda t: length(t) / 10.0::double))) / ln(2.0::double) / sum(list_sum(list_transform(w, lambda t: strlen(t)))), 6) as bits_per_byte from x""")
def held_out_bits(spark, documents):
    b = R.held_out_bits(_losses(documents), "nll", "n_bytes")
    return b.select("texts", F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query("documents", sql=f"""with w as (select doc_id, text, {_W} as w from documents where text is not null)
  select doc_id, case when len(w) > 3 then round(list_sum(list_transform(w[4:], lambda t: length(t) / 10.0::double)) / ln(2.0::double) / strlen(array_to_string(w[4:], ' ')), 6) end as bits from w""")
def tail_bits(spark, documents):
    """Bits per byte after each document's first three words."""
    d = _losses(documents)
    tail = F.array_join(F.slice("w", F.lit(4), F.greatest(F.size("w") - 3, F.lit(0))), " ")
    return d.select("doc_id", F.round(R.span_bits(F.slice("w", 1, 3), F.col("w"), F.col("nll"), tail), 6).alias("bits"))


@query("documents", sql=f"""with w as (select doc_id, {_W} as t, list_filter(regexp_split_to_array(coalesce(title, ''), '\\s+'), lambda t: t <> '') as c from documents where text is not null),
  b as (select doc_id, t, c[greatest(len(c) - (64 - least(len(t), 32)), 0) + 1:] as c from w where len(t) >= 4)
  select doc_id, len(c)::int as context, least(len(t), 64 - len(c))::int as target from b""")
def fitted_turns(spark, documents):
    """Titles and texts that share 64 tokens."""
    d = documents.filter("text is not null").select("doc_id", R.fitted_turn(T.space_words(F.coalesce("title", F.lit(""))), T.space_words(F.col("text")), 64).alias("f"))
    return d.filter("f is not null").select("doc_id", F.size("f.context").alias("context"), F.size("f.target").alias("target"))


@query("documents", sql=f"""with w as (select year_est, {_W} as w from documents where text is not null and year_est is not null),
  x as (select year_est < 1800 as old, w[1:1024] as v, len(w) as n from w where len(w) >= 8),
  b as (select old, sum(list_sum(list_transform(v, lambda t: length(t) / 10.0::double))) / ln(2.0::double) / sum(list_sum(list_transform(v, lambda t: strlen(t)))) as b from x where old or n >= 20 group by 1)
  select round((select b from b where old), 6) as real, round((select b from b where not old), 6) as made, round(abs((select b from b where not old) - (select b from b where old)), 6) as deviation""")
def judge_deviation(spark, documents):
    """Texts before 1800 as the real ones, later ones as made."""
    d = _losses(documents).join(documents.select("doc_id", "year_est"), "doc_id").withColumn("n", F.size("w"))
    j = R.judge_deviation(d.filter("year_est < 1800"), d.filter("year_est >= 1800"), "nll", "n_bytes", "n")
    return j.select(*[F.round(c, 6).alias(c) for c in j.columns])


_RUN = """(select 'run-' || user_id || '/checkpoint-' || (event_id // 10 * 10) as name, user_id, event_id, case when event_id % 7 = 0 then event_id // 2 else event_id // 10 * 10 end as step, value * 1e15::double as flos, 1e6::double as params, value from events)"""


def _runs(events):
    ten = (F.floor(F.col("event_id") / 10) * 10).cast("long")
    return events.select(
        F.concat(F.lit("run-"), "user_id", F.lit("/checkpoint-"), ten.cast("string")).alias("name"), "user_id", "event_id", "value",
        F.when(F.col("event_id") % 7 == 0, F.floor(F.col("event_id") / 2)).otherwise(ten).cast("long").alias("step"),
        (F.col("value") * 1e15).alias("flos"), F.lit(1e6).alias("params"), ten.alias("named"),
    )


@query("events", sql=f"""select event_id, round(case when flos > 0 then flos / (6 * params) end, 3) as tokens_seen, round(case when flos > 0 then flos / (6 * params) / params end, 6) as tokens_per_param,
  step <> 0 and regexp_extract(name, '([0-9]+)$', 1)::bigint <> step as restarted from {_RUN}""")
def run_provenance(spark, events):
    p = R.provenance(_runs(events), "name", "step", "flos", "params")
    return p.select("event_id", F.round("tokens_seen", 3).alias("tokens_seen"), F.round("tokens_per_param", 6).alias("tokens_per_param"), "restarted")


@query("events", sql="select event_id from events where event_id % 7 = 0 and event_id // 2 < 0.9::double * (event_id // 10 * 10)")
def run_restarts(spark, events):
    return R.restarts(_runs(events), "step", "named").select("event_id")


@query("documents", sql=rf"""with w as (select doc_id, {_W} as w from documents where text is not null),
  g as (select doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as g from w where len(w) >= 2)
  select doc_id from g where len(list_filter(range(1, len(w) + 1), lambda i: list_contains(w[greatest(1, i - 4):i - 1], w[i]))) / len(w)::double > 0.3::double or len(list_distinct(g)) / len(g)::double < 0.6::double""")
def looping_texts(spark, documents):
    from ..operators import evals as E

    w = documents.filter("text is not null").select("doc_id", T.space_words(F.col("text")).alias("w")).filter(F.size("w") >= 2)
    # staged, or the filter would be pushed below and count the words again for each of its conditions
    shares = staged(w.select("doc_id", E.echo_rate(F.col("w")).alias("echo"), E.distinct_share(F.col("w"), 2).alias("distinct2")), "echoes")
    return R.loopers(shares, "echo", "distinct2").select("doc_id")


@query("events", sql="""with e as (select user_id, event_id, value from events where value is not null and not isnan(value))
  select user_id, arg_min(event_id, struct_pack(a := -value, b := event_id)) as best, arg_min(event_id, struct_pack(a := value, b := event_id)) as worst, min(value) as lowest, max(value) as highest from e group by 1""")
def run_extremes(spark, events):
    return R.extremes(events, "user_id", "value", "event_id")


@query("events", sql="select event_type || '-' || event_id as name, event_id as step, (props->>'$.k')::double as k from events where event_id % 2 = 0 union all select event_type || '-x', null, (props->>'$.k')::double from events where event_id % 2 = 1")
def suite_rows(spark, events):
    name = F.concat_ws("-", "event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x"))
    return R.suite_rows(events.select(name.alias("name"), "props"), "name", "props", {"k": "$.k"})


@query("docvalue", sql="""with j as (select rec_id, extra from docvalue where extra is not null and json_valid(extra)), k as (select rec_id, extra, unnest(json_keys(extra)) as name from j)
  select rec_id, name, json_extract_string(extra, '$.' || name) as value from k where json_type(extra, '$.' || name) not in ('ARRAY', 'OBJECT')""")
def flat_extras(spark, docvalue):
    return R.flat_config(docvalue, "rec_id", "extra")


@query("documents", sql=f"""select doc_id, strlen(array_to_string(({_W})[2:], ''))::int as bytes from documents where text is not null""")
def scored_bytes(spark, documents):
    return documents.filter("text is not null").select("doc_id", R.scored_bytes(T.space_words(F.col("text"))).alias("bytes"))


@query("events", sql="select user_id, event_id as step, value as loss from events where value is not null and event_id % 3 <> 0")
def log_entries(spark, events):
    """Trainer logs of each user, in which every third entry lacks its rate."""
    entry = F.struct(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.when(F.col("event_id") % 3 != 0, F.lit(0.5)).alias("learning_rate"))
    logs = events.groupBy("user_id", "event_type").agg(F.to_json(F.struct(F.collect_list(entry).alias("log_history"))).alias("j"))
    return R.log_entries(logs, "user_id", "j").select("user_id", "step", "loss")


@query("events", sql="""select event_type, count(*) as n, round(avg((value > 30)::int), 4) as accuracy, round(avg(value - 30), 4) as mean_margin from events where value is not null group by rollup(event_type)""")
def choice_margins(spark, events):
    m = R.margins(events.withColumn("thirty", F.lit(30.0)), "event_type", "value", "thirty")
    return m.select("event_type", "n", F.round("accuracy", 4).alias("accuracy"), F.round("mean_margin", 4).alias("mean_margin"))


@query("events", sql="""select count(*) as n, round(avg(value - 20), 4) as mean_shock, round(min(value - 20), 4) as least_shock, count(*) filter (where value <= 20) as leaks,
  arg_min(event_id, struct_pack(a := value - 20, b := event_id)) as least_key from events where value is not null""")
def trap_shocks(spark, events):
    s = R.shocks(events.withColumn("twenty", F.lit(20.0)), "event_id", "value", "twenty")
    return s.select("n", F.round("mean_shock", 4).alias("mean_shock"), F.round("least_shock", 4).alias("least_shock"), "leaks", "least_key")


@query("events", sql="""select user_id, event_id, value, before from (select user_id, event_id, value, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events where value is not null) where value >= before + 50""")
def rising_losses(spark, events):
    return R.worse_than_before(events.filter("value is not null").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 50.0)


_FIT = r"""coalesce(length(text) > 100 and length(text) <= 10000000 and len(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) between 11 and 132
  and len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) > 2, false)"""


@query("docvalue", sql=f"""with o as (select batch_no, rec_id, id, text, row_number() over (partition by batch_no order by rec_id) as n from docvalue),
  v as (select *, {_FIT} as fit from o), w as (select *, sum((n > 10 and fit)::int) over (partition by batch_no order by rec_id rows unbounded preceding) as k from v),
  s as (select *, case when n <= 10 then 'skipped' when not fit then 'dropped' when k > 150 then 'limited' else 'taken' end as what from w),
  d as (select *, what = 'taken' and row_number() over (partition by what = 'taken', id order by batch_no nulls first, rec_id) > 1 as again from s)
  select batch_no, count(*) as loaded, count(*) filter (where what = 'dropped') as dropped, count(*) filter (where what = 'skipped') as skipped, count(*) filter (where what = 'limited') as limited,
    count(*) filter (where again) as duplicate, count(*) filter (where what = 'taken' and not again) as indexed from d group by batch_no""")
def ingest_report(spark, docvalue):
    """All counters of an import: ten rows of each batch skipped, 150 fit ones taken, repeated ids counted."""
    return S.ingest_report(docvalue.select("batch_no", "rec_id", "id", "text"), "batch_no", "rec_id", offset=10, limit=150)


@query("documents", sql="""select doc_id::varchar as source, 'all' as chunk_file, (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')))::bigint as words from documents where length(text) > 0""")
def shard_files(spark, documents):
    """Exact spans written as one record a document and read again."""
    from ..operators.chunks import span_shards

    path = _folder(spark, "shard-files")
    s = span_shards(documents, "doc_id", 60, 140, 100).select(F.col("doc_id").cast("string").alias("source"), "shard", "words", F.col("shard_text").alias("text"))
    writers.write_shard_files(s, path, "source", "shard", "words", "text")
    r = readers.read_shard_rows(spark, path)
    return r.groupBy("source").agg(F.lit("all").alias("chunk_file"), F.sum("words").alias("words"))


@query("documents", sql="""select count(*) as texts, count(distinct text) as kinds, true as has_text, false as has_other from documents where text <> ''""")
def parquet_texts(spark, documents):
    """The text column of a Parquet source, and a source without the column asked for."""
    path = _folder(spark, "parquet-texts")
    documents.select("text", "doc_id").write.parquet(path)
    t, ok = readers.read_parquet_texts(spark, path)
    _, other = readers.read_parquet_texts(spark, path, "body")
    return t.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("text").alias("kinds")).select("*", F.lit(ok).alias("has_text"), F.lit(other).alias("has_other"))


@query("documents", sql=r"""select doc_id, md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b-\x1f\x7f-\x9f\x{E000}-\x{F8FF}\x{FFFD}\x{FEFF}]', '', 'g')) as plain from documents where text is not null""")
def plain_texts(spark, documents):
    t = F.regexp_replace(readers.plain_characters(F.col("text")), "﻿", "")
    return documents.filter("text is not null").select("doc_id", F.md5(t).alias("plain"))


@query("documents", sql=r"""select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z"''“”‘’])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''))::int as sentences from documents where text is not null""")
def split_sentences(spark, documents):
    return documents.filter("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query("docvalue", sql="""select rec_id, case when n >= 1024 then format('{:.1f} KiB', n / 1024.0::double) else n || ' B' end as size, case when substr(id, 1, 2) = 'ff' then null when substr(id, 2, 1) = 'f' then
  substr('123456789abcdef', ('0x' || substr(id, 1, 1))::int + 1, 1) else substr(id, 1, 1) || substr('123456789abcdef', ('0x' || substr(id, 2, 1))::int + 1, 1) end as next_prefix
  from (select rec_id, id, strlen(text) as n from docvalue where text is not null and id is not null)""")
def sizes_and_prefixes(spark, docvalue):
    d = docvalue.filter("text is not null and id is not null")
    return d.select("rec_id", T.human_bytes(F.octet_length("text")).alias("size"), T.hex_successor(F.left("id", F.lit(2))).alias("next_prefix"))


@query("copa")
def alike_answers(spark, copa):
    """Whether each item's query and right choice are alike by the stems of their words (checked in tests)."""
    from ..operators import evals as E

    gold = F.try_element_at("choices", F.col("gold") + 1)
    return copa.select("item_id", E.answers_alike(F.col("query"), gold, 0.3).alias("alike"))


@query("docvalue", sql="""select count(*) filter (where source is distinct from coalesce(case when batch_no < 3 then lower(trim(source)) end, source)) as changed, count(*) as total from docvalue""")
def mapped_sources(spark, docvalue):
    """Sources of the first batches trimmed and in lower case; others left."""
    return S.mapped(docvalue, {"source": F.when(F.col("batch_no") < 3, F.lower(F.trim("source")))})[1]


@query("copa", sql="""select item_id, (list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1)::int as best from copa where len(choices) > 0""")
def longest_choice(spark, copa):
    from ..operators import evals as E

    return copa.filter(F.size("choices") > 0).select("item_id", E.best_choice(F.transform("choices", lambda c: F.length(c))).alias("best"))


@query("events", sql="select event_type, count(*) as n, round(max(value), 4) as top, count(distinct user_id) as users from events group by rollup(event_type)")
def metric_suite(spark, events):
    from ..operators import evals as E

    return E.suite(events, "event_type", {"n": F.count(F.lit(1)), "top": F.round(F.max("value"), 4), "users": F.countDistinct("user_id")})
