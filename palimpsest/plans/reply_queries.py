"""Queries on the reply functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as P
from ..functions import text as T
from .base import query

_ANSWERS = "(select distinct conv_id, turn, content from bible1611_verses where lower(role) in ('assistant', 'gpt') and content is not null)"


def _answers(verses):
    return verses.filter("lower(role) in ('assistant', 'gpt') and content is not null").select("conv_id", "turn", "content").distinct()


@query("bible1611_verses", sql=rf"""select conv_id, turn, regexp_replace(trim(regexp_replace(trim(content), '^(?i)(?:input|output)\s*:\s*', '')), '^"(.*)"$', '\1') as tidy,
  array_to_string((list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))[1:7], ' ') as head from {_ANSWERS}""")
def reply_fields(spark, verses):
    c = F.col("content")
    return _answers(verses).select("conv_id", "turn", P.field_tidied(c).alias("tidy"), P.first_words(c, 7).alias("head"))


@query("documents", sql=r"""select doc_id, round(len(regexp_extract_all(text, ' [,.;:!?]|[,;:]{2,}|[,;][A-Za-z]')) * 100.0::double / nullif(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')), 0), 4) as issues
  from documents where text is not null""")
def punctuation_issues(spark, documents):
    return documents.filter("text is not null").select("doc_id", F.round(P.punctuation_issues(F.col("text")), 4).alias("issues"))


@query("bible1611_verses")
def longest_repeats(spark, verses):
    """The longest immediate repetition in each answer (checked in tests)."""
    return _answers(verses).select("conv_id", "turn", P.longest_repeat(T.space_words(F.col("content"))).alias("longest"))
