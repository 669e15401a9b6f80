"""Queries on sources, sinks and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers as R
from ..sources import writers as X
from ..streaming import ingest as I
from .base import query


def _folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("documents", sql="""select count(*) as loaded, count(*) filter (where text = '') as no_text, count(distinct text) filter (where text <> '') as texts
  from documents where text is not null""")
def jsonl_round_trip(spark, documents):
    """Documents written as JSON lines and read back with counters."""
    path = _folder(spark, "jsonl")
    X.write_jsonl(documents.filter("text is not null"), path, ["doc_id", "text", "nothing"])
    r = R.read_jsonl(spark, path, extra=["doc_id"])
    return r.agg(F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("status") == "no_text").alias("no_text"), F.countDistinct("text").alias("texts"))


@query("documents", sql="""with o as (select doc_id, length(text) as n, row_number() over (order by doc_id) - 1 as k from documents)
  select format('docs-{:04d}.jsonl', (k // 400 + 1)::int) as shard, count(*) as records from o group by 1""")
def sharded_export(spark, documents):
    """Exact shards of 400 records, written and counted."""
    return X.write_shards(documents.select("doc_id", "text"), _folder(spark, "shards"), "doc_id", 400, "docs")


@query("documents", sql="select count(*) as records, count(distinct id) as ids from (select text as id from documents where text <> '')")
def raw_records(spark, documents):
    """Raw records by the hash of their text, the last of each kept."""
    path = _folder(spark, "raw")
    documents.filter("text <> ''").select("text", "source").write.json(path)
    n = documents.filter("text <> ''").agg(F.count(F.lit(1)).alias("records"))
    return n.crossJoin(R.read_raw(spark, path).agg(F.count(F.lit(1)).alias("ids")))


@query("documents")
def token_shards(spark, documents):
    """Token shards of at most 20,000 ids, written, read and summed (tests check the round trip)."""
    from ..functions.text import space_words

    ids = F.concat(F.transform(space_words(F.col("text")), lambda w: F.length(w) % 1000), F.array(F.lit(65000)))
    d = documents.filter("text is not null").select("doc_id", ids.alias("ids"))
    return X.write_token_shards(d, _folder(spark, "tokens"), "doc_id", "ids", 20_000)


@query("documents", sql=r"""with n as (select len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) as n from documents where text is not null)
  select count(*) as docs, sum(n)::bigint as tokens, 0::bigint as bad_ids, min(n)::int as least, median(n)::double as median, round(avg(n), 4) as mean, max(n)::int as most,
  count(*) filter (where n < 16) as tiny, count(*) filter (where n < 256) as short, count(*) filter (where n >= 256) as long, count(*) filter (where n > 25600) as huge from n""")
def token_health(spark, documents):
    from ..functions.text import space_words

    d = documents.filter("text is not null").select(F.transform(space_words(F.col("text")), F.length).alias("ids"))
    return R.token_health(d, "ids", 1_000_000, 256).withColumn("mean", F.round("mean", 4))


@query("scripture", sql="select book, count(*) as verses, sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::bigint as chars from scripture group by book")
def parsed_verses(spark, scripture):
    """Books joined to marked texts and parsed again into verses."""
    line = F.concat(F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("chapter", "verse", line.alias("l"))))
    books = scripture.groupBy("book").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("text"))
    v = R.parse_verses(books)
    return v.groupBy("book").agg(F.count(F.lit(1)).alias("verses"), F.sum(F.length("text")).alias("chars"))


@query("documents", sql="""select doc_id::varchar as file, 1::bigint as poem, coalesce(title, 'Untitled') as title, 'A. Nonymous' as author, trim(text) as body
  from documents where text is not null""")
def poems(spark, documents):
    """Poems under headings of title and author, parsed from one text a document."""
    block = F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit(" by A. Nonymous\n"), F.col("text"))
    files = documents.filter("text is not null").select(F.col("doc_id").cast("string").alias("file"), block.alias("text"))
    return R.parse_poems(files)


_SESSION = """with l as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
  i as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l)
  select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from i group by user_id, k"""


@query("events", sql=_SESSION)
def session_windows(spark, events):
    return I.session_counts(events, "ts", "user_id", "6 hours")


@query("events", sql="select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by 1, 2")
def day_windows(spark, events):
    return I.window_counts(events, "ts", "event_type", "1 day")


@query("documents", sql="""select source, count(*) as docs from documents where length(text) > 100
  and len(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) between 11 and 132
  and len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) > 2 group by source""")
def stream_ingest(spark, documents):
    """The documents read as a stream of files, filtered, and appended once."""
    src, out, chk = (_folder(spark, t) for t in ("stream-in", "stream-out", "stream-checkpoint"))
    documents.select("doc_id", "text", "source").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        I.ingest_new_files(spark, src, "doc_id long, text string, source string", out, chk).awaitTermination()
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
