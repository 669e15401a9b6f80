"""Queries on vocabulary, out-of-period terms and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import era as E
from ..session import staged
from .base import query

_WORDS = "unnest(regexp_extract_all(lower(replace(replace(text, '’', ''''), '‘', '''')), '[a-z]+(?:''[a-z]+)*')) as word"
#: Words and phrases of the test tables; a real list is a file.
_LIST = ("galvanometer", "microscope", "telescope", "evil hour", "parish book", "great frost", "thatch")
#: Of a later time than the test tables; `railway` is allowed again by the query.
_LATER = (
    "computer", "internet", "website", "television", "radio", "aeroplane", "airplane", "automobile", "world war",
    "nuclear bomb", "software", "email", "video", "astronaut", "penicillin", "antibiotic", "smartphone",
    "steam engine", "railway", "telegraph", "c++", *_LIST[:2],
)
_TERMS = "(values " + ", ".join(f"('{t}')" for t in _LIST) + ") as b(term)"
_OLD = "year_est between 1 and 1799"
_NEW = "year_est >= 1800"
_RATIO = f"""o as (select word, count(*) as o from (select {_WORDS} from documents where {_OLD}) group by 1),
  m as (select word, count(*) as m from (select {_WORDS} from documents where {_NEW}) group by 1),
  b as (select coalesce(o.word, m.word) as word, coalesce(o, 0) as o, coalesce(m, 0) as m from o full join m on o.word = m.word),
  t as (select sum(o) as so, sum(m) as sm, count(*) as v from b),
  r as (select word, o, ln(((m + 0.5::double) / (sm + 0.5::double * v)) / ((o + 0.5::double) / (so + 0.5::double * v))) as lr from b, t),
  z as (select ln((0.5::double / (sm + 0.5::double * v)) / (0.5::double / (so + 0.5::double * v))) as lr0 from t)"""


def _ratios(documents):
    """The log ratios of the documents of either side of 1800, whose words are counted in one pass."""
    side = F.when(F.expr(_OLD), "old").when(F.expr(_NEW), "new")
    f = staged(E.word_frequencies(documents, by=side), "words-by-side")
    return E.log_ratios(f.filter("period = 'old'"), f.filter("period = 'new'"))


@query("documents", sql=f"select word, count(*) as cnt from (select {_WORDS} from documents) group by 1 having count(*) >= 3")
def vocab_min3(spark, documents):
    return E.word_frequencies(documents, least=3)


@query("documents", sql=r"""with y as (select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b((?:19|20)\d\d)\b'), lambda y: y <> '1900'))) as ys from documents
  where text is not null and not regexp_matches(text, '(?i)B\.?\s*C\.')) select doc_id, array_to_string(ys, ',') as years from y where len(ys) > 0""")
def year_hits(spark, documents):
    # where a text has no B.C. at all, the plain pattern is the same
    d = documents.filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?i)B\.?\s*C\."))
    out = d.select("doc_id", E.late_years(F.col("text")).alias("y")).filter(F.size("y") > 0)
    return out.select("doc_id", F.array_join("y", ",").alias("years"))


@query("documents", sql=rf"""select distinct doc_id, term from (select doc_id, lower(translate(text, '’‘', '''''')) as t from documents where text is not null), {_TERMS}
  where regexp_matches(t, '(?:^|[^a-z''])' || term || '(?:''[a-z]+|es|s|ed)?(?:[^a-z'']|$)')""")
def term_hits(spark, documents):
    return E.term_hits(documents, "doc_id", E.term_list(spark, list(_LIST)))


@query("documents", sql=f"""with {_RATIO} select word, o::bigint as old_cnt, round(lr, 4) + 0.0 as lr from r""")
def nb_log_ratio(spark, documents):
    r = _ratios(documents)
    return r.select("word", F.col("old_cnt").cast("long"), (F.round("lr", 4) + 0.0).alias("lr"))


@query("documents", sql=f"""with {_RATIO}, w as (select doc_id, word, count(*) as n from (select doc_id, {_WORDS} from documents) group by 1, 2),
  x as (select w.*, r.o, r.lr is not null as known, coalesce(r.lr, (select lr0 from z)) as lr from w left join r on w.word = r.word)
  select d.doc_id, coalesce(sum(n), 0)::bigint as n_tokens, round(coalesce(sum(case when known then n else 0 end) / sum(n), 0)::double, 4) as english_frac,
    round(coalesce(sum(n * least(10.0::double, greatest(-8.0::double, lr))), 0), 3) as sum_lr,
    round(coalesce(sum(case when lr > 0 then n * lr / (1 + coalesce(o, 0) / 200.0::double) else 0.0 end), 0), 3) as gated_sum
  from documents d left join x on d.doc_id = x.doc_id group by d.doc_id""")
def nb_features(spark, documents):
    r = _ratios(documents)
    none = documents.select("doc_id").limit(0)
    s = E.date_scores(documents, "doc_id", r, none)
    return s.select("doc_id", "n_tokens", *[F.round(c, k).alias(c) for c, k in (("english_frac", 4), ("sum_lr", 3), ("gated_sum", 3))])


_HIT = rf"""h as (select distinct doc_id from (select doc_id, lower(translate(text, '’‘', '''''')) as t from documents where text is not null),
    (values {", ".join(f"('{t}')" for t in _LATER if t not in ("railway", "c++"))}) as b(term)
    where regexp_matches(t, '(?:^|[^a-z''])' || replace(term, ' ', '[^a-z]+') || '(?:''[a-z]+|es|s|ed)?(?:[^a-z'']|$)')
    union select doc_id from documents where regexp_matches(lower(text), '(?:^|\\W)c\\+\\+(?:''s|es|s|ed)?(?:\\W|$)'))"""
_ARCH = ", ".join("'" + w.replace("'", "''") + "'" for w in E.ARCHAIC)


@query("documents", sql=f"""with {_RATIO}, {_HIT}, w as (select doc_id, word, count(*) as n from (select doc_id, {_WORDS} from documents) group by 1, 2),
  x as (select w.*, r.o, coalesce(r.lr, (select lr0 from z)) as lr from w left join r on w.word = r.word),
  f as (select d.doc_id, coalesce(sum(n), 0)::bigint as n_tokens, coalesce(sum(n * least(10.0::double, greatest(-8.0::double, lr))), 0) as sum_lr,
    coalesce(sum(case when lr > 0 then n * lr / (1 + coalesce(o, 0) / 200.0::double) else 0.0 end), 0) as gated_sum,
    coalesce(sum(case when x.word in ({_ARCH}) then n else 0 end), 0)::bigint as arch_count from documents d left join x on d.doc_id = x.doc_id group by d.doc_id),
  l as (select *, {E.BIAS}::double + {E.WEIGHTS["sum_lr"]}::double * sum_lr + {E.WEIGHTS["gated_sum"]}::double * gated_sum + {E.WEIGHTS["arch_count"]}::double * arch_count as logit from f),
  p as (select *, case when logit > 700 then 0 else 1 / (1 + exp(logit)) end as p from l)
  select doc_id, n_tokens, arch_count, round(case when doc_id in (select doc_id from h) then least(p, 0.03::double) else p end, 3) as p from p""")
def date_vetoes(spark, documents):
    """Archaic words and the probability of an old text, with the veto of term hits."""
    r = _ratios(documents)
    hits = E.term_hits(documents, "doc_id", E.term_list(spark, list(_LATER), ["railway"]))
    s = E.date_scores(documents, "doc_id", r, hits)
    return s.select("doc_id", "n_tokens", F.col("arch_count").cast("long").alias("arch_count"), F.round("p", 3).alias("p"))


@query("documents", sql=r"""with y as (select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(
      regexp_replace(regexp_replace(text, '\b(\d\d\d\d)(\s*B\.?\s*C\.?)', 'x\2', 'g'), '(?i)(B\.?\s*C\.?\s*,?\s*to\s+)(\d\d\d\d)\b', '\1x', 'g'),
      '\b((?:19|20)\d\d)\b'), lambda y: y <> '1900'))) as ys from documents where text is not null)
  select doc_id, array_to_string(ys, ',') as years from y where len(ys) > 0""")
def year_hits_all(spark, documents):
    """Late years of every text, those before Christ left out."""
    out = documents.select("doc_id", E.late_years(F.col("text")).alias("y")).filter(F.size("y") > 0)
    return out.select("doc_id", F.array_join("y", ",").alias("years"))


@query("documents", sql=rf"""with h as (select doc_id, list_sort(list(distinct term)) as terms from (select doc_id, lower(translate(text, '’‘', '''''')) as t from documents where text is not null), {_TERMS}
    where regexp_matches(t, '(?:^|[^a-z''])' || term || '(?:''[a-z]+|es|s|ed)?(?:[^a-z'']|$)') group by 1),
  n as (select doc_id, list_filter(regexp_extract_all(text, '\b(\d\d\d\d?)\b'), lambda x: x::int > 1900)[1]::int as year from documents)
  select n.doc_id, coalesce(array_to_string(terms, '|'), '') as terms, year, case when terms is not null then 'terms' when year is not null then 'year' end as reason
  from n left join h on h.doc_id = n.doc_id""")
def era_reasons(spark, documents):
    g = E.era_gate(documents, "doc_id", E.term_list(spark, list(_LIST)))
    return g.select("doc_id", F.array_join("terms", "|").alias("terms"), "year", "reason")


@query("documents")
def date_scores(spark, documents):
    """Scores with the veto of term hits, and whether the text is kept (tests check the formula)."""
    r = _ratios(documents)
    hits = E.term_hits(documents, "doc_id", E.term_list(spark, list(_LATER), ["railway"]))
    s = E.date_scores(documents, "doc_id", r, hits)
    keep = (F.col("p") >= 0.75) & (F.col("english_frac") >= 0.6) & (F.col("n_tokens") >= 20)
    return s.select("doc_id", F.round("p", 4).alias("p"), "n_tokens", F.round("english_frac", 3).alias("english_frac"), keep.alias("keep"))


@query("documents", sql=f"""with f as (select p, word, count(*) as cnt from (select case when year_est < 1780 then '18a' when year_est < 1820 then '18b' else '19a' end as p, {_WORDS}
    from documents where year_est > 0) group by 1, 2), s as (select p, sum(cnt) as total from f group by 1), v as (select count(distinct word) as v from f),
  w as (select doc_id, word, count(*) as n from (select doc_id, {_WORDS} from documents) group by 1, 2),
  l as (select w.doc_id, s.p, sum(n * ln((coalesce(f.cnt, 0) + 0.5::double) / (s.total + 0.5::double * (select v from v)))) as ll
    from w cross join s left join f on f.p = s.p and f.word = w.word group by 1, 2)
  select doc_id, p as period from l qualify row_number() over (partition by doc_id order by ll desc, p desc) = 1""")
def century_guess(spark, documents):
    p = F.when(F.col("year_est") <= 0, None).when(F.col("year_est") < 1780, "18a").when(F.col("year_est") < 1820, "18b").when(F.col("year_est") >= 1820, "19a")
    return E.best_period(documents, "doc_id", E.word_frequencies(documents, by=p))
