"""Replies of models as data: lenient parses, schemas of providers, choices among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of speaker labels, with the side each is on.
SPEAKER_SIDES = (
    ("student", "student"), ("reader", "student"), ("user", "student"), ("question", "student"), ("teacher", "teacher"),
    ("tutor", "teacher"), ("assistant", "teacher"), ("professor", "teacher"), ("answer", "teacher"),
)
LINE = "struct<speaker:string,text:string>"


def fences_stripped(text: Column) -> Column:
    """A reply without code fences around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?im)^```(?:jsonl?)?\s*|\s*```$", ""))


def _line_of(json: Column) -> Column:
    """STRUCT<speaker, text> of a JSON object: by those names, or its only key and value; null for others."""
    m = F.when(F.try_parse_json(json).isNotNull() & F.trim(json).startswith("{"), F.from_json(json, "map<string,string>"))
    named = F.map_contains_key(m, "speaker") & F.map_contains_key(m, "text")
    who = F.when(named, F.try_element_at(m, F.lit("speaker"))).when(F.size(m) == 1, F.map_keys(m)[0])
    said = F.when(named, F.try_element_at(m, F.lit("text"))).when(F.size(m) == 1, F.map_values(m)[0])
    return F.when((F.trim(who) != "") & (F.trim(said) != ""), F.struct(F.trim(who).alias("speaker"), F.trim(said).alias("text")))


def dialogue_lines(text: Column) -> Column:
    """ARRAY<STRUCT<speaker, text>> of a reply that should be JSON: an array or object as a whole, else
    the objects of each line, else the flat objects within a line. [] where nothing can be read."""
    bare = fences_stripped(text)
    # the parser takes what it can from the beginning, so lines of objects look like one object
    several = bare.contains("\n") & F.try_parse_json(F.split_part(bare, F.lit("\n"), F.lit(1))).isNotNull()
    whole = F.try_parse_json(bare).isNotNull() & ((bare.startswith("[") & bare.endswith("]")) | (bare.startswith("{") & ~several))
    items = F.when(bare.startswith("["), F.from_json(bare, "array<string>")).otherwise(F.array(bare))

    def of_line(line: Column) -> Column:
        t = F.regexp_replace(F.trim(line), ",$", "")
        flat = F.regexp_extract_all(t, F.lit(r"(\{[^{}]*\})"), F.lit(1))
        return F.when(F.try_parse_json(t).isNotNull() & (F.size(flat) < 2), F.array(t)).otherwise(flat)

    lines = F.flatten(F.transform(F.split(bare, "\n"), of_line))
    out = F.array_compact(F.transform(F.when(whole, items).otherwise(lines), _line_of))
    return F.coalesce(out, F.array().cast(f"array<{LINE}>"))


def speaker_side(label: Column) -> Column:
    """student or teacher, by how a label begins; null for others."""
    out = F.lit(None).cast("string")
    low = F.lower(F.trim(label))
    for start, side in reversed(SPEAKER_SIDES):
        out = F.when(low.startswith(start), side).otherwise(out)
    return out


_LABEL = r"^\s*(?:\*{1,3}\s*)?([A-Za-z][A-Za-z ()\-]{0,40}?)\s*:\s*(.*)$"


def plain_dialogue(text: Column) -> Column:
    """ARRAY<STRUCT<role, content>> of a dialogue written as prose with speakers' labels.

    Bold labels count as plain ones; lines without a label go on the turn above, others are
    before it. null unless there are turns of both sides.
    """
    bold = r"\*{1,3}([A-Za-z][A-Za-z ()\-]{0,40}?)\s*:\s*\*{1,3}|\*{1,3}([A-Za-z][A-Za-z ()\-]{0,40}?)\s*:|([A-Za-z][A-Za-z ()\-]{0,40}?)\s*:\s*\*{1,3}"
    lines = F.split(F.regexp_replace(text, bold, "$1$2$3:"), r"\r?\n")
    # a label's line begins a turn, marked by a control character; the turns are what stands between
    marked = F.transform(
        lines,
        lambda l: F.when(
            speaker_side(F.regexp_extract(l, _LABEL, 1)).isNotNull(),
            F.concat(F.lit("\u0001"), speaker_side(F.regexp_extract(l, _LABEL, 1)), F.lit("\u0002"), F.trim(F.regexp_extract(l, _LABEL, 2))),
        ).otherwise(F.trim(l)),
    )
    turns = F.split(F.array_join(F.filter(marked, lambda l: l != ""), "\n"), "\u0001")

    def turn(t: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(F.split_part(t, F.lit("\u0002"), F.lit(2)), r"(?m)^[`~]{3,}.*$", ""), r"\*\*(.+?)\*\*", "$1")
        return F.struct(F.split_part(t, F.lit("\u0002"), F.lit(1)).alias("role"), F.regexp_replace(said, r"^\s+|\s+$", "").alias("content"))

    made = F.filter(F.transform(F.slice(turns, F.lit(2), F.greatest(F.lit(0), F.size(turns) - 1)), turn), lambda m: m["content"] != "")
    has = lambda side: F.exists(made, lambda m: m["role"] == side)
    return F.when(has("student") & has("teacher"), made)


def keywords(words: Column, most: int = 5) -> Column:
    """The first `most` keywords that are not blank, in lower case and trimmed."""
    return F.slice(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: w != ""), 1, most)


def reply_fields(json: Column) -> Column:
    """STRUCT<content, finish_reason, prompt_tokens, completion_tokens> of a provider's answer; null for broken JSON.

    The first choice counts, of the chat or the plain completion form.
    """
    r = F.from_json(
        json,
        "struct<choices:array<struct<message:struct<content:string>,text:string,finish_reason:string>>,usage:struct<prompt_tokens:long,completion_tokens:long>>",
    )
    c = F.try_element_at(r["choices"], F.lit(1))
    return F.when(
        F.try_parse_json(json).isNotNull() & json.isNotNull(),
        F.struct(
            F.coalesce(c["message"]["content"], c["text"]).alias("content"), c["finish_reason"].alias("finish_reason"),
            r["usage"]["prompt_tokens"].alias("prompt_tokens"), r["usage"]["completion_tokens"].alias("completion_tokens"),
        ),
    )


def token_logprobs(json: Column) -> Column:
    """ARRAY<STRUCT<token, logprob>> of a choice's log probabilities, in the form of content or of parallel arrays; null without."""
    r = F.from_json(json, "struct<content:array<struct<token:string,logprob:double>>,tokens:array<string>,token_logprobs:array<double>>")
    pair = lambda t, p: F.struct(F.coalesce(t, F.lit("")).alias("token"), p.alias("logprob"))
    of_content = F.transform(r["content"], lambda x: pair(x["token"], x["logprob"]))
    of_arrays = F.transform(F.arrays_zip(r["tokens"].alias("t"), r["token_logprobs"].alias("p")), lambda x: pair(x["t"], x["p"]))
    return F.when(F.size(r["content"]) > 0, of_content).when(r["tokens"].isNotNull(), of_arrays)


def mean_logprob(logprobs: Column) -> Column:
    """Mean of the log probabilities that are not null; null without any."""
    some = F.filter(logprobs, lambda p: p.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, p: a + p) / F.size(some))


def complete_pairs(rows: DataFrame, *texts: str, finish: str = "finish_reason") -> DataFrame:
    """Rows that ended by themselves (stop, or nothing said) and whose texts are all there."""
    ok = F.col(finish).isNull() | (F.col(finish) == "stop")
    for t in texts:
        ok = ok & (F.trim(F.coalesce(F.col(t), F.lit(""))) != "")
    return rows.filter(ok)


def verdict(text: Column, fallback: str) -> Column:
    """The word after 'verdict:' in lower case; `fallback` where a reply has none."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)verdict\s*[:\-]\s*([a-z]+)", 1)
    return F.when(word != "", F.lower(word)).otherwise(fallback)


def needed_input(reply: Column, echo: Column, most_echo: float = 0.5) -> Column:
    """A reply as the input of a task; '' where none is needed.

    None is needed if the reply is empty or says NONE, begins with a task's label, or is too like
    the instruction (`echo`, their ROUGE-L). What follows the next task's label is cut off.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)\n\s*Task\s*:.*$", ""), r"^(?i:input)\s*:\s*", ""))
    no = (t == "") | t.rlike(r"(?i)^none\b") | t.rlike(r"(?i)^(?:task|output|input)\b\s*[:\-]") | (F.coalesce(echo, F.lit(0.0)) >= most_echo)
    return F.when(no, "").otherwise(t)


def best_candidates(rows: DataFrame, key: str, text: str, score: str, order: str, mode: str = "logprob") -> DataFrame:
    """(key, text): the candidate of the best score, or the longest where no candidate of a key has one; of equals the first.

    mode 'longest' looks at lengths only, 'seeded' takes the least hash.
    """
    early = -F.col(order)
    rank = {
        "logprob": F.struct(F.col(score).isNotNull(), F.coalesce(F.col(score), F.length(text).cast("double")), early),
        "longest": F.struct(F.length(text), early),
        "seeded": F.struct(-F.xxhash64(key, order), early),
    }[mode]
    return rows.groupBy(key).agg(F.max_by(text, rank).alias(text))
