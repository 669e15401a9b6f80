"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as C
from ..operators import gates as G
from .base import query

_ROLE = """case when lower(trim(role)) in ('user', 'human', 'prompter', 'question') then 'user'
  when lower(trim(role)) in ('assistant', 'gpt', 'model', 'bot', 'answer') then 'assistant' else lower(trim(role)) end"""
_TURNS = f"(select distinct conv_id, turn, {_ROLE} as role, content from bible1611_verses)"
_LAST = f"""l as (select conv_id, arg_max(content, turn) filter (where role = 'system' and content is not null) as system,
  arg_max(content, turn) filter (where role = 'user' and content is not null) as "user",
  arg_max(content, turn) filter (where role = 'assistant' and content is not null) as assistant from {_TURNS} group by 1)"""


def _turns(verses):
    return verses.select("conv_id", "turn", C.role(F.col("role")).alias("role"), "content").distinct()


def _last(verses):
    return C.last_of_roles(_turns(verses).filter("content is not null"), "conv_id")


@query("bible1611_verses", sql=f"select role, count(*) as turns, count(distinct conv_id) as convs from {_TURNS} group by role")
def role_counts(spark, verses):
    return _turns(verses).groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("convs"))


@query("bible1611_verses", sql=f"with {_LAST} select * from l")
def last_turns(spark, verses):
    return _last(verses)


@query("bible1611_verses", sql=f"""with {_LAST}, r as (select conv_id, case when length("user") < 16 then 'user_too_short'
   when not regexp_matches(trim("user"), '[.?!”"'')]$') then 'user_not_sentence'
   when len(list_distinct(list_filter(string_split("user", ''), lambda c: c <> ''))) <= 8 then 'user_low_char_unique'
   when starts_with(assistant, 'I regret that') then 'assistant_regret' when starts_with(assistant, 'I apologize that') then 'assistant_apologize'
   when starts_with(assistant, 'I''m sorry t') then 'assistant_sorry' when contains(assistant, 'I cannot answer ') then 'assistant_cannot'
   when contains(assistant, 'I cannot provide ') then 'assistant_cannot_provide' when contains(assistant, 'I have no knowledge of') then 'assistant_no_knowledge' end as reason from l)
  select coalesce(reason, 'ok') as reason, count(*) as convs from r group by 1""")
def reject_hist(spark, verses):
    r = _last(verses).select(F.coalesce(G.user_gate(F.col("user"), F.col("assistant")), F.lit("ok")).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("convs"))


@query("bible1611_verses", sql=f"""with {_LAST} select conv_id, case when system is not null then '<s><|system|>' || chr(10) || trim(system) || '</s>' || chr(10) else '' end
  || '<s><|user|>' || chr(10) || coalesce(trim("user"), '') || '</s>' || chr(10) || '<s><|assistant|>' || chr(10) || coalesce(trim(assistant), '') || '</s>' || chr(10) as text from l""")
def chat_template(spark, verses):
    m = C.messages_of(F.col("system"), F.col("user"), F.col("assistant"))
    return _last(verses).select("conv_id", C.chat_template(m).alias("text"))


@query("bible1611_verses", sql=f"""with {_LAST} select conv_id, case when len(list_filter(regexp_split_to_array("user", '\\s+'), lambda w: w <> '')) < 4 then 'too_short'
  when len(list_filter(regexp_split_to_array("user", '\\s+'), lambda w: w <> '')) > 60 or length("user") > 400 then 'too_long'
  when regexp_matches("user", '(?i)\\b(image|picture|draw|drawing|paint|painting|illustrate|illustration|graph|diagram)\\b') then 'non_text_output'
  when regexp_matches("user", '(?i)\\b(recite|sing|read out loud|read the (passage|poem|story|verse|lines|excerpt))\\b') then 'non_text_action' end as reason
  from l where "user" is not null""")
def instruction_gate(spark, verses):
    return _last(verses).filter("user is not null").select("conv_id", G.instruction_gate(F.col("user")).alias("reason"))


@query("docvalue", sql=r"""select source, count(*) as n, count(*) filter (where length(trim(text)) < 20) as n_empty,
  count(*) filter (where regexp_matches(text, '[\^|•~¬■□▪●◦♦†‡¤¢∎]')) as n_junk,
  count(*) filter (where regexp_matches(text, '(?i)\b(computer|internet|website|online|telephone|television|radio|automobile|nuclear|software)\b')) as n_late,
  round(avg(length(text)), 3) as mean_chars from docvalue where text is not null group by source""")
def flag_rates(spark, docvalue):
    f = G.output_flags(F.col("text"))
    return (
        docvalue.filter("text is not null").groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(f["empty"]).alias("n_empty"), F.count_if(f["junk"]).alias("n_junk"),
            F.count_if(f["late"]).alias("n_late"), F.round(F.avg(F.length("text")), 3).alias("mean_chars"),
        )
    )


@query("bible1611_verses", sql=f"""select conv_id, bool_and(ok) as keep, arg_min(role, turn) filter (where not ok) as reason from (select conv_id, turn, role,
  case role when 'assistant' then coalesce(length(content), 0) >= 20 else coalesce(length(content), 0) > 0 end as ok from {_TURNS}) group by 1""")
def conv_keep(spark, verses):
    n = F.coalesce(F.length("content"), F.lit(0))
    ok = F.when(F.col("role") == "assistant", n >= 20).otherwise(n > 0)
    return C.kept_conversations(_turns(verses), "conv_id", ok, F.col("role"))


@query("bible1611_verses", sql=f"""select conv_id, turn, trim(regexp_replace(regexp_replace(m, '(?is)<think>.*?</think>', ' ', 'g'), '(?i)</?think>', ' ', 'g')) as content
  from (select conv_id, turn, '<think>' || content || '</think> so: ' || content || '</THINK>' as m from {_TURNS} where role = 'assistant' and content is not null)""")
def strip_think(spark, verses):
    d = _turns(verses).filter("role = 'assistant' and content is not null")
    m = F.concat(F.lit("<think>"), "content", F.lit("</think> so: "), "content", F.lit("</THINK>"))
    return d.select("conv_id", "turn", T.strip_think(m).alias("content"))


@query("bible1611_verses", sql=f"""with p as (select u.conv_id, u.turn, u.content as q, a.content as a from {_TURNS} u join {_TURNS} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
   where u.role = 'user' and a.role = 'assistant' and u.content is not null and a.content is not null)
  select conv_id, turn, 'Question: ' || q || chr(10) || 'Answer: ' || a as text from p""")
def question_answer_texts(spark, verses):
    t = _turns(verses).filter("content is not null")
    u = t.filter("role = 'user'").select("conv_id", "turn", F.col("content").alias("q"))
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("a"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", C.question_answer_text(F.col("q"), F.col("a")).alias("text"))


def _q(x: str) -> str:
    return x.replace("'", "''")


def _any(column: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '(?i){_q(p)}')" for p in patterns) + ")"


_PAIR_RULES = (
    [(f"length(\"user\") < {G.USER_LEAST}", "user_too_short"), (f"not contains('{_q(G.USER_CLOSERS)}', right(trim(\"user\"), 1))", "user_not_sentence"),
     (f"len(list_distinct(list_filter(string_split(\"user\", ''), lambda c: c <> ''))) <= {G.USER_KINDS}", "user_low_char_unique")]
    + [(f"starts_with(assistant, '{_q(x)}')", n) for x, n in G.ANSWER_BEGINS] + [(f"contains(assistant, '{_q(x)}')", n) for x, n in G.ANSWER_HOLDS]
)


@query("bible1611_verses", sql=f"with {_LAST} select conv_id, case {' '.join(f'when {r} then {chr(39)}{n}{chr(39)}' for r, n in _PAIR_RULES)} end as reason from l")
def pair_reasons(spark, verses):
    """Why each conversation's last pair is not fit, by all rules."""
    return _last(verses).select("conv_id", G.user_gate(F.col("user"), F.col("assistant")).alias("reason"))


@query("bible1611_verses", sql=f"""with {_LAST}, w as (select conv_id, "user" as u, len(list_filter(regexp_split_to_array("user", '\\s+'), lambda w: w <> '')) as n from l where "user" is not null)
  select conv_id, case when n < 4 then 'too_short' when n > 60 or length(u) > 400 then 'too_long' when {_any('u', [rf'\b{t}\b' for t in G.NON_TEXT_OUTPUT])} then 'non_text_output'
  when {_any('u', G.NON_TEXT_ACTION)} then 'non_text_action' end as reason from w""")
def instruction_reasons(spark, verses):
    """Why each last question is no good instruction, by whole lists."""
    return _last(verses).filter("user is not null").select("conv_id", G.instruction_gate(F.col("user")).alias("reason"))


@query("bible1611_verses", sql=f"""select conv_id, turn, {_any('content', G.foreign_patterns())} as about, regexp_matches(content, '[^\\x00-\\x{{FF}}]') and
    len(list_filter(string_split(content, ''), lambda c: c <> '' and unicode(c) > 255 and regexp_matches(c, '\\p{{L}}'))) > 0 as letters from {_TURNS} where content is not null""")
def english_only(spark, verses):
    """Turns about another language, and turns with letters beyond Latin-1."""
    c = F.col("content")
    task = G.first_match(c, G.foreign_patterns()).isNotNull()
    return _turns(verses).filter("content is not null").select("conv_id", "turn", task.alias("about"), c.rlike(r"[\p{L}&&[^\x00-\xFF]]").alias("letters"))


@query("bible1611_verses", sql=f"""with t as (select model, content, trim(content) as t from bible1611_verses where content is not null)
  select model, count(*) as n, count(*) filter (where length(t) < {G.GENERATED_LEAST}) as empty, count(*) filter (where {_any('t', [G.META])}) as meta,
  count(*) filter (where {_any(f'left(t, {G.PREAMBLE_REACH})', [G.PREAMBLE])}) as preamble, count(*) filter (where {_any('t', [G.LEAK])}) as leak,
  count(*) filter (where regexp_matches(content, '[{G.SCAN_JUNK.replace("^", chr(92) + "^")}]')) as junk, count(*) filter (where {_any('content', [chr(92) + 'b(' + '|'.join(G.ANACHRONISMS) + ')' + chr(92) + 'b'])}) as late
  from t group by model""")
def flag_counts(spark, verses):
    """All failure flags of messages by the model that wrote them."""
    f = G.output_flags(F.col("content"))
    return verses.filter("content is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in f.items()])
