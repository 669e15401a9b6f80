"""Queries on chunks, splits, turns and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import dialogue as D
from .base import query

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"


@query("documents", sql=rf"""with w as (select doc_id, {_W} as w from documents where text is not null),
  s as (select doc_id, 'aligned' as win, unnest(range(0, len(w), 120))::int as s, w from w where len(w) > 0 union all
        select doc_id, 'shifted', unnest(range(60, len(w), 120))::int, w from w where len(w) > 60)
  select doc_id, win as window, s as start_word, least(s + 120, len(w))::int as end_word, array_to_string(w[s + 1:s + 120], ' ') as chunk from s""")
def word_windows(spark, documents):
    return C.word_windows(documents, "doc_id", 120)


@query("documents", sql="""with c as (select doc_id, list_filter(list_transform(range(1, greatest(1, length(text)) + 1, 700), lambda i: trim(substring(text, i, 700))), lambda p: p <> '')[1:3] as p
  from documents where text is not null) select doc_id, (unnest(range(1, len(p) + 1)) - 1)::int as chunk_index, unnest(p) as chunk from c""")
def char_chunks(spark, documents):
    return C.char_chunks(documents, "doc_id", 700, most=3)


@query("documents", sql=rf"""with t as (select doc_id, list_transform({_W}, lambda w: length(w)) as t from documents where text is not null),
  n as (select doc_id, t, unnest(range(0, ((len(t) - 1) // 64)::int))::int as win from t where len(t) > 64)
  select doc_id, win as window, array_to_string(t[win * 64 + 1:win * 64 + 65], ',') as ids from n""")
def token_windows(spark, documents):
    from ..functions.text import space_words

    d = documents.filter("text is not null").select("doc_id", F.transform(space_words(F.col("text")), F.length).alias("t"))
    return C.token_windows(d, "doc_id", "t", 64).select("doc_id", "window", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("documents", sql=rf"""select doc_id, true as contiguous, true as same_text, 0::bigint as words_off from documents where length(text) > 0""")
def span_shards_check(spark, documents):
    """The exact spans of all documents, held against the texts."""
    s = C.span_shards(documents, "doc_id", 60, 140, 100)
    return C.check_shards(s, documents, "doc_id").drop("shards")


@query("documents")
def span_shards(spark, documents):
    return C.span_shards(documents, "doc_id", 60, 140, 100)


@query("documents")
def lookahead_chunks(spark, documents):
    return C.lookahead_chunks(documents, "doc_id", 100)


@query("documents")
def lookahead_report(spark, documents):
    d = C.lookahead_chunks(documents, "doc_id", 100).join(documents.select("doc_id", "source"), "doc_id")
    return C.chunk_report(d, "source", 100)


@query("documents")
def text_splits(spark, documents):
    return C.text_splits(documents, "doc_id")


@query("documents", sql="""select doc_id, md5(text) as whole, length(text) < 1000 as trains_only, true as about_a_tenth from documents where text is not null""")
def middle_splits(spark, documents):
    """Validation carved from the middle: put back, it gives the text; about a tenth, or none of short texts."""
    s = C.middle_splits(documents, "doc_id")
    n = F.length("train") + F.length("valid")
    back = F.concat(F.left("train", F.col("start").cast("int")), "valid", F.substring("train", F.col("start").cast("int") + 1, F.length("train")))
    share = F.length("valid") / F.greatest(n, F.lit(1))
    return s.select(
        "doc_id", F.md5(back).alias("whole"), (F.col("valid") == "").alias("trains_only"),
        ((F.col("valid") == "") | ((share > 0) & (share < 0.21))).alias("about_a_tenth"),
    )


@query("documents", sql=r"""select doc_id, md5(replace(replace(text, chr(13), ''), ' ', '')) as letters, true as in_order from documents where length(text) > 0""")
def span_texts(spark, documents):
    """The exact spans of each document put together again."""
    s = C.span_shards(documents, "doc_id", 60, 140, 100)
    rows = F.array_sort(F.collect_list(F.struct("shard", "pos", "shard_text")))
    g = s.groupBy("doc_id").agg(rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["shard_text"]), "")
    order = F.transform("r", lambda x: x["pos"])
    bare = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit(" "), F.lit(""))
    return g.select("doc_id", F.md5(bare).alias("letters"), (F.array_sort(order) == order).alias("in_order"))


@query("documents", sql=r"""with o as (select doc_id, text, row_number() over (order by doc_id) as n, sum(coalesce(length(text), 0)) over (order by doc_id rows unbounded preceding) as cum,
    sum(coalesce(length(text), 0)) over () as total, count(*) over () as rows from documents),
  c as (select *, abs(cum - total * 0.9::double) as dist, case when regexp_matches(coalesce(text, ''), '(?:\n\n|\r\n\r\n)\s*$') then 3
    when regexp_matches(coalesce(text, ''), '[.!?…]["'')\]]*\s*$') then 2 when regexp_matches(trim(coalesce(text, '')), '[^\p{L}]$') then 1 else 0 end as score from o),
  b as (select n as cut from c where n < rows order by (dist <= total * 0.05::double)::int desc,
    case when dist <= total * 0.05::double then score else 0 end desc, dist, n limit 1)
  select case when n <= (select cut from b) then 'train' else 'valid' end as part, count(*) as docs, sum(coalesce(length(text), 0))::bigint as chars from o group by 1""")
def train_valid_split(spark, documents):
    s = C.entry_split(documents.select("doc_id", "text"), "doc_id")
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


@query("documents")
def hash_split(spark, documents):
    """Shares of a split by hash (the share is checked in tests)."""
    p = C.hash_split(F.col("doc_id"), 7, {"train": 0.95, "valid": 0.05}).alias("part")
    return documents.groupBy(p).agg(F.count(F.lit(1)).alias("docs"))


_EV = "(select event_id, user_id, event_type, epoch_us(ts) // 1000000 as s from events)"


@query("events", sql=f"""with l as (select *, lag(event_type) over w as pt, lag(s) over w as ps from {_EV} window w as (partition by user_id order by s, event_id)),
  i as (select *, sum(case when pt = event_type and s - ps <= 86400 then 0 else 1 end) over (partition by user_id order by s, event_id rows unbounded preceding) as island from l)
  select user_id, island::bigint as island, min(event_type) as event_type, min(s)::bigint as s, count(*) as n, string_agg(event_id::varchar, ' ' order by s, event_id) as ids from i group by 1, 2""")
def coalesce_turns(spark, events):
    """Runs of one event type of a user with gaps of a day at most."""
    s = F.unix_timestamp("ts")
    # the place breaks ties of the same second by the event's number
    e = events.select("user_id", "event_type", s.alias("s"), F.col("event_id").cast("string").alias("ids"), (s * 100000000 + F.col("event_id")).alias("p"), (s * 100000000 + F.col("event_id")).alias("e"))
    out = D.coalesce_turns(e.select("user_id", "event_type", "p", "e", "ids", "s"), "user_id", "event_type", "p", "e", "ids", gap=86400 * 100000000 + 99999999)
    return out.select("user_id", "island", "event_type", F.expr("p div 100000000").alias("s"), "n", "ids")


@query("events", sql="""with s as (select event_id, user_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + (value * 1000)::bigint % 100000 as b from events where value is not null),
  m as (select *, max(b) over (partition by user_id order by a, b, event_id rows between unbounded preceding and 1 preceding) as f from s),
  i as (select *, sum(case when f is null or a > f + 1 then 1 else 0 end) over (partition by user_id order by a, b, event_id rows unbounded preceding) as island from m)
  select user_id, island::bigint as island, count(*) as n, min(a)::bigint as a, max(b)::bigint as b from i group by 1, 2""")
def overlap_islands(spark, events):
    a = F.unix_timestamp("ts")
    s = events.filter("value is not null").select("event_id", "user_id", a.alias("a"), (a + F.round(F.col("value") * 1000).cast("long") % 100000).alias("b"))
    out = D.overlap_islands(s, "user_id", "a", "b", "event_id")
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))


@query("events", sql="""with s as (select event_id, user_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + 7200 as b, event_type from events)
  select l.event_id, r.event_id as r_event_id from s l join s r on l.user_id = r.user_id and l.a < r.b and r.a < l.b and l.event_type = 'purchase' and r.event_type = 'click'""")
def interval_join(spark, events):
    a = F.unix_timestamp("ts")
    s = events.select("event_id", "user_id", "event_type", a.alias("a"), (a + 7200).alias("b"))
    left, right = s.filter("event_type = 'purchase'"), s.filter("event_type = 'click'")
    return D.interval_join(left, right, "a", "b", 7200, ["user_id"]).select("event_id", "r_event_id")


@query("documents", sql="""select doc_id, coalesce(sum(length(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from documents where source is not null""")
def global_offset(spark, documents):
    d = documents.filter("source is not null").select("doc_id", "source", F.length("text").alias("n"))
    return D.global_offsets(d, "source", "doc_id", "n").select("doc_id", F.col("offset").cast("long"))


@query("docvalue", sql="""with c as (select lower(source) as folded, source as name, count(*) as n, min(rec_id) as f from docvalue where source is not null group by 1, 2)
  select folded, name from c qualify row_number() over (partition by folded order by n desc, f) = 1""")
def casing_mode(spark, docvalue):
    return D.common_casing(docvalue.filter("source is not null"), "source", "rec_id")


@query("docvalue", sql="""with c as (select lower(source) as folded, source as name, count(*) as n, min(rec_id) as f from docvalue where source is not null group by 1, 2),
  m as (select folded, name from c qualify row_number() over (partition by folded order by n desc, f) = 1)
  select d.rec_id, case when d.batch_no = 3 and lower(d.source) = 'hymn-sheets' then 'Hymns of batch three' when lower(d.source) = 'penny-weekly' then 'The Penny Weekly' else m.name end as canonical
  from docvalue d left join m on lower(d.source) = m.folded""")
def speaker_canon(spark, docvalue):
    """A chain of aliases: of the batch, overall, by the common casing."""
    per = spark.createDataFrame([(3, "hymn-sheets", "Hymns of batch three")], "batch_no int, folded string, canonical string")
    over = spark.createDataFrame([("penny-weekly", "The Penny Weekly")], "folded string, canonical string")
    cas = D.common_casing(docvalue.filter("source is not null"), "source", "rec_id")
    return D.canonical_names(docvalue.select("rec_id", "source", "batch_no"), "source", "batch_no", per, over, cas).select("rec_id", "canonical")


@query("documents")
def located_lines(spark, documents):
    """Every line of a document found again in it (all of them, in order; checked in tests)."""
    d = documents.filter("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    return D.located(lines, d.select("doc_id", F.col("text").alias("source_text")), "doc_id", "n", "line")


@query("documents")
def located_altered(spark, documents):
    """Lines of each document, last first, every second of three in capitals, every third with a
    letter changed, found again in it (checked in tests)."""
    d = documents.filter("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    changed = F.overlay("line", F.lit("~"), (F.length("line") / 4).cast("int") + 1)
    line = F.when(F.col("n") % 3 == 1, F.upper("line")).when(F.col("n") % 3 == 2, changed).otherwise(F.col("line"))
    lines = lines.select("doc_id", (-F.col("n")).alias("n"), line.alias("line"))
    return D.located(lines, d.select("doc_id", F.col("text").alias("source_text")), "doc_id", "n", "line")
