"""Conversations: shapes, roles, gates and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of roles.
ROLES = {
    "user": ("user", "human", "prompter", "question"),
    "assistant": ("assistant", "gpt", "model", "bot", "answer"),
    "system": ("system",),
}
# Key pairs of flat question and answer records, in order of preference.
QA_KEYS = (
    ("question", "answer"), ("prompt", "response"), ("instruction", "output"), ("input", "output"), ("query", "response"),
    ("prompt", "completion"), ("user", "assistant"),
)


def role(c: Column) -> Column:
    """user, assistant or system; other roles in lower case."""
    low = F.lower(F.trim(c))
    out = low
    for name, spellings in ROLES.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return out


def turns_of(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, turn, role, content) of JSON records in any of the shapes: messages,
    conversation(s) with from and value, or a flat pair of question and answer."""
    msg = "array<struct<role:string,content:string,`from`:string,value:string>>"
    fields = ", ".join(f"`{k}`:string" for k in dict.fromkeys(k for p in QA_KEYS for k in p))
    j = F.from_json(json, f"struct<messages:{msg},conversation:{msg},conversations:{msg},{fields}>")
    r = records.select(key, j.alias("j"))
    shaped = F.transform(
        F.coalesce("j.messages", "j.conversations", "j.conversation"),
        lambda m: F.struct(F.coalesce(m["role"], m["from"]).alias("role"), F.coalesce(m["content"], m["value"]).alias("content")),
    )
    flat = F.lit(None)
    for q, a in reversed(QA_KEYS):
        pair = F.array(
            F.struct(F.lit("user").alias("role"), F.col(f"j.{q}").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col(f"j.{a}").alias("content")),
        )
        flat = F.when(F.col(f"j.{q}").isNotNull() & F.col(f"j.{a}").isNotNull(), pair).otherwise(flat)
    out = r.select(key, F.posexplode(F.coalesce(shaped, flat)).alias("turn", "m"))
    return out.select(key, "turn", role(F.col("m.role")).alias("role"), "m.content")


def last_of_roles(turns: DataFrame, key: str, turn: str = "turn", content: str = "content") -> DataFrame:
    """(key, system, user, assistant): the last content of each role."""
    r = role(F.col("role"))
    return turns.groupBy(key).agg(
        *[F.max_by(F.when(r == x, F.col(content)), F.when(r == x, F.col(turn))).alias(x) for x in ("system", "user", "assistant")]
    )


def messages_of(system: Column, user: Column, assistant: Column, keep_system: bool = True) -> Column:
    """ARRAY<STRUCT<role, content>>, without the system message if it is null or unwanted."""
    make = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    pair = F.array(make("user", user), make("assistant", assistant))
    if not keep_system:
        return pair
    return F.when(system.isNotNull(), F.array(make("system", system), make("user", user), make("assistant", assistant))).otherwise(pair)


def chat_template(messages: Column, bos: str = "<s>", eos: str = "</s>", prompt: bool = False) -> Column:
    """The messages as one text: begin mark, role line, trimmed content, end mark."""
    line = F.transform(
        messages,
        lambda m: F.concat(F.lit(bos + "<|"), m["role"], F.lit("|>\n"), F.trim(F.coalesce(m["content"], F.lit(""))), F.lit(eos + "\n")),
    )
    out = F.array_join(line, "")
    return F.concat(out, F.lit(bos + "<|assistant|>\n")) if prompt else out


def question_answer_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)


def chat_json(messages: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages")))


def extract_json(text: Column) -> Column:
    """The JSON object in a reply: without code fences, or else the outermost braces; null if broken."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & (F.trim(c) != ""), c)
    return F.coalesce(ok(bare), ok(outer))


def unverified_claims(claims: Column, source: Column) -> Column:
    """Claims (MAP<claim, evidence>) whose evidence is not in the source, white space apart."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.map_keys(F.map_filter(claims, lambda k, v: ~F.contains(flat(source), flat(v))))


def kept_conversations(turns: DataFrame, key: str, ok: Column, reason: Column, turn: str = "turn") -> DataFrame:
    """(key, keep, reason): whether every turn passes, else the reason of the first that fails."""
    return turns.groupBy(key).agg(
        F.bool_and(ok).alias("keep"), F.min_by(F.when(~ok, reason), F.when(~ok, F.col(turn))).alias("reason")
    )
