"""Queries on the features of documents and the stored metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .base import query

_CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"
_TOKENS = (
    r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), "
    r"lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: t <> '')"
)
_SPACE = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"
_ALPHA = "list_filter(" + _TOKENS + r", lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z''’\-]*$'))"


def _metric(c: str) -> str:
    return f"coalesce(case when isnan({c}) then null else {c} end, 0)"


_GLOBAL = _metric("quality") + "".join(f" - abs({_metric(m)} - 100)" for m in M.METRICS)


@query("documents", sql=f"""select doc_id from documents where length(text) > 100 and length(text) <= 10000000
  and len(list_distinct({_CHARS})) > 10 and len(list_distinct({_CHARS})) <= 132 and len({_SPACE}) > 2""")
def prefilter_docs(spark, documents):
    return documents.filter(M.prefilter(F.col("text"))).select("doc_id")


@query("documents", sql=f"select doc_id, len({_TOKENS})::int as tokens from documents where text is not null")
def doc_tokens(spark, documents):
    return documents.filter("text is not null").select("doc_id", F.size(T.store_tokens(F.col("text"))).alias("tokens"))


@query("documents", sql=r"""select doc_id, len(regexp_extract_all(lower(replace(replace(text, '’', ''''), '‘', '''')),
  '[a-z]+(?:''[a-z]+)*'))::int as words, len(regexp_extract_all(lower(text), '[a-z0-9'']+'))::int as rouge_words,
  len(""" + _SPACE + """)::int as space_words from documents where text is not null""")
def word_counts(spark, documents):
    t = F.col("text")
    return documents.filter("text is not null").select(
        "doc_id",
        F.size(T.word_tokens(t)).alias("words"),
        F.size(T.rouge_tokens(t)).alias("rouge_words"),
        F.size(T.space_words(t)).alias("space_words"),
    )


@query("documents", sql=r"""select doc_id, greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text,
  '([.!?]["'']?\s+)([A-Z"''])', '\1' || chr(1) || '\2', 'g'), '([\n\r]{2,}\s*)([a-zA-Z"''])', '\1' || chr(1) || '\2', 'g'),
  chr(1)), lambda s: trim(s) <> '')))::int as sentences from documents where text is not null""")
def doc_sentences(spark, documents):
    return documents.filter("text is not null").select("doc_id", T.sentence_count(F.col("text")).alias("sentences"))


@query("documents", sql=rf"""with c as (select doc_id, length(text) n,
    length(text) - length(regexp_replace(text, '[{T.QUALITY_LETTERS}]', '', 'g')) l,
    length(text) - length(regexp_replace(text, '[0-9 \n]', '', 'g')) d,
    length(text) - length(regexp_replace(text, '[.,;!?''"_\-]', '', 'g')) p from documents where text <> '')
  select doc_id, round((((l * 2.0::double + d + p * 0.5::double - (n - l - d - p) * 0.5::double) / n) - 0.75::double) * 100, 4) as quality from c""")
def doc_quality(spark, documents):
    return documents.filter("text <> ''").select("doc_id", F.round(M.quality(F.col("text")), 4).alias("quality"))


@query("documents", sql=f"""select doc_id, round(list_aggregate({_CHARS}, 'entropy') / 4.4::double * 100, 2) as entropy
  from documents where text <> ''""")
def doc_entropy(spark, documents):
    return documents.filter("text <> ''").select("doc_id", F.round(M.entropy(F.col("text")), 2).alias("entropy"))


@query("documents", sql=rf"""select doc_id, round(len({_ALPHA}) * 100.0::double / greatest(1, len({_TOKENS})), 4) as alpha,
  round(case when len({_ALPHA}) > 0 then len(list_filter({_ALPHA}, lambda t: regexp_matches(t, '(?i)[aeiouy]'))) * 100.0::double
    / len({_ALPHA}) else 0 end, 4) as vowel,
  round(greatest(0.0::double, (1 - (length(text) - length(regexp_replace(text, '[{T.noise_class()}]', '', 'g'))) * 5.0::double
    / nullif(length(regexp_replace(text, '\W+', ' ', 'g')), 0)) * 100), 4) as ascii_share
  from documents where text <> ''""")
def doc_shares(spark, documents):
    t = F.col("text")
    return documents.filter("text <> ''").select(
        "doc_id",
        F.round(M.alpha_share(t), 4).alias("alpha"),
        F.round(M.vowel_share(t), 4).alias("vowel"),
        F.round(M.ascii_share(t), 4).alias("ascii_share"),
    )


@query("documents", "vocab", sql=f"""with t as (select doc_id, replace(lower(unnest({_ALPHA})), '’', '''') as t from documents
    where text is not null), v as (select distinct word from vocab where cnt >= 3 and word <> '__total__')
  select doc_id, count(*) as alpha_n,
    sum(case when t in (select word from v) or (t like '%''s' and substring(t, 1, length(t) - 2) in (select word from v))
      then 1 else 0 end)::bigint as hit_n,
    round(sum(case when t in (select word from v) or (t like '%''s' and substring(t, 1, length(t) - 2) in (select word from v))
      then 1 else 0 end) * 100.0::double / count(*), 4) as dict_hit from t group by doc_id""")
def dict_hit(spark, documents, vocab):
    out = M.dict_hits(documents, "doc_id", vocab)
    return out.select("doc_id", "alpha_n", "hit_n", F.round("dict_hit", 4).alias("dict_hit"))


@query("documents", sql=r"""select doc_id, sha256(regexp_replace(text, '\W+', ' ', 'g')) as content_hash,
  length(regexp_replace(text, '\W+', ' ', 'g'))::int as len from documents where text is not null""")
def content_hash(spark, documents):
    n = T.normalized(F.col("text"))
    return documents.filter("text is not null").select("doc_id", F.sha2(n, 256).alias("content_hash"), F.length(n).alias("len"))


@query("documents")
def content_ids(spark, documents):
    """SHA-512/256 ids, which DuckDB lacks; tests hold them against hashlib."""
    t = F.col("text")
    return documents.filter("text is not null").select(
        "doc_id", T.content_id(t).alias("id"), T.content_id(t, "unicode").alias("unicode_id")
    )


@query("documents")
def doc_compress(spark, documents):
    """Deflate ratios; tests hold them against zlib."""
    return documents.select("doc_id", F.round(M.compress("text"), 2).alias("compress"))


@query("docvalue", sql=f"select rec_id, round({_GLOBAL}, 4) + 0.0 as global_score from docvalue")
def global_score(spark, docvalue):
    return docvalue.select("rec_id", (F.round(M.global_score(), 4) + 0.0).alias("global_score"))


@query("docvalue", sql=f"""select rec_id, round({_metric('quality')} - 100 - abs({_metric('compress')} - 100)
  - abs({_metric('entropy')} - 100), 4) + 0.0 as conflict_score from docvalue""")
def conflict_score(spark, docvalue):
    return docvalue.select("rec_id", (F.round(M.conflict_score(), 4) + 0.0).alias("conflict_score"))


@query("docvalue", sql=f"""select source, count(*) as docs, round(avg({_GLOBAL}), 3) as avg_score,
    round(max({_GLOBAL}), 4) as best_score from docvalue where length(text) > 100
    and len(list_distinct({_CHARS})) > 10 and len(list_distinct({_CHARS})) <= 132 and len({_SPACE}) > 2
    group by source""")
def score_by_source(spark, docvalue):
    """Flagship: prefilter, score and summary by source."""
    kept = docvalue.filter(M.prefilter(F.col("text")))
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.round(F.avg(M.global_score()), 3).alias("avg_score"),
        F.round(F.max(M.global_score()), 4).alias("best_score"),
    )


@query("documents", sql=r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(\w)[-¬]\s*\n\s*(\w)', '\1\2', 'g'), '[\^|•~¬■□▪●◦♦†‡¤¢∎_]', '', 'g'), '\s+([;:,.!?])', '\1', 'g'), '\s+', ' ', 'g'))) as cleaned
  from documents where text is not null""")
def scan_clean(spark, documents):
    return documents.filter("text is not null").select("doc_id", F.md5(T.scan_clean(F.col("text"))).alias("cleaned"))


@query("documents", sql=r"""select doc_id, trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug,
  left(text, 300) as preview,
  case when length(text) > 1000 then left(text, 500) || '...' || right(text, 500) else text end as short_text
  from documents where text is not null and title is not null""")
def previews(spark, documents):
    t = F.col("text")
    return documents.filter("text is not null and title is not null").select(
        "doc_id", T.slug(F.col("title")).alias("slug"), F.left(t, F.lit(300)).alias("preview"),
        T.shortened(t, 1000, "...").alias("short_text"),
    )


@query("documents", sql=r"""select doc_id, case when regexp_matches(text, '(?:\n\n|\r\n\r\n)\s*$') then 3
  when regexp_matches(text, '[.!?…]["'')\]]*\s*$') then 2 when regexp_matches(trim(text), '[^\p{L}]$') then 1 else 0 end as score
  from documents where text is not null""")
def boundary_scores(spark, documents):
    return documents.filter("text is not null").select("doc_id", T.boundary_score(F.col("text")).alias("score"))


@query("documents", sql=r"""select doc_id, case when c = '' then null else c end as century from (select doc_id,
  case when year_est is null then '' else (floor((year_est - 1) / 100) + 1)::int::varchar || (case
    when (floor((year_est - 1) / 100) + 1)::int between 11 and 13 then 'th'
    when (floor((year_est - 1) / 100) + 1)::int % 10 = 1 then 'st' when (floor((year_est - 1) / 100) + 1)::int % 10 = 2 then 'nd'
    when (floor((year_est - 1) / 100) + 1)::int % 10 = 3 then 'rd' else 'th' end) || ' century' end as c from documents)""")
def centuries(spark, documents):
    return documents.select("doc_id", T.century_ordinal(F.col("year_est")).alias("century"))
