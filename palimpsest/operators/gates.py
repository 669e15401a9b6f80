"""Gates of training records: whether a pair, an instruction or a generated text is fit, and why not.

Each gate is one column expression that gives the first reason in the order of its rules, or
null for a fit text. Null texts give null, but where a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import characters

# Limits, closing marks, beginnings and phrases of the pair gate, with their reasons.
USER_LEAST, USER_KINDS, USER_CLOSERS = 16, 8, ".?!”\"')"
ANSWER_BEGINS = (
    ("I regret that", "assistant_regret"),
    ("I apologize that", "assistant_apologize"),
    ("I'm affraid I", "assistant_affraid"),
    ("I'm sorry t", "assistant_sorry"),
)
ANSWER_HOLDS = (
    ("I cannot answer ", "assistant_cannot"),
    ("I cannot provide ", "assistant_cannot_provide"),
    ("I have no knowledge of", "assistant_no_knowledge"),
)

# What an instruction may not ask for, as words and as patterns.
NON_TEXT_OUTPUT = ("image", "picture", "draw", "drawing", "paint", "painting", "illustrate", "illustration", "graph", "diagram", "map ")
NON_TEXT_ACTION = (
    r"\bmake\s+a\s+(?:drawing|sketch|painting)\b",
    r"\bdraw\s+(?:a|an|the)\b",
    r"\bread\b[^.\n]{0,30}\baloud\b",
    r"\bread\s+out\s+loud\b",
    r"\bread\s+the\s+(?:passage|poem|story|verse|lines|excerpt)\b",
    r"\brecite\b",
    r"\bsing\b",
)

# Languages, words about language, and verbs of producing text, of the English-only gate.
LANGUAGES = (
    "latin", "french", "german", "spanish", "italian", "greek", "portuguese", "russian", "dutch", "hebrew", "arabic", "chinese",
    "japanese", "sanskrit", "gaelic", "welsh", "norwegian", "swedish", "danish", "polish", "turkish", "hindi", "persian", "esperanto",
)
LANGUAGE_MATTER = (
    "word", "words", "phrase", "phrases", "verb", "verbs", "noun", "nouns", "sentence", "sentences", "grammar", "vocabulary", "term",
    "terms", "expression", "expressions", "equivalent", "alphabet", "tongue", "language", "proverb", "saying", "motto", "conjugation",
    "declension", "spelling",
)
PRODUCING = (
    "write", "writing", "written", "compose", "composing", "composed", "say", "speak", "spoken", "recite", "sing", "render", "word",
    "phrase",
)
TRANSLATION = (r"\btransl(?:ate|ation|ating|iterate|iteration)\b", r"\b(?:conjugat|declens|decline\s+the)\w*\b")

# Signs of failure in generated texts, as patterns and as characters.
META = (
    r"^\W*(this|the|here(?:'s| is)|in\s+(?:this|summary))\s+"
    r"(?:(?:original|following|above|preceding|present|foregoing|given|provided)\s+)?"
    r"(document|text|passage|author|speaker|excerpt|writer|piece|paragraph|content|article|summary|following|manuscript|language|prose|style|tone)\b"
)
PREAMBLE = (
    r"\b(as (?:a|the) continuation|as requested|here(?:'s| is) (?:a|the|my) continuation|"
    r"i(?:'ll| will| shall)?\s+(?:provide|continue|offer)|let me (?:continue|provide)|since you(?:'re| are) asking|"
    r"to continue (?:the|this)|i'll provide)\b"
)
LEAK = (
    r"\b(as an ai|i am an ai|i cannot|i can't|i'm sorry|as a language model|sure,?\s+here|here is (?:the|a|your)|certainly[!,]|"
    r"i apologi[sz]e)\b"
)
SCAN_JUNK = "^|•~¬■□▪●◦♦†‡¤¢∎"
ANACHRONISMS = (
    "computer", "internet", "website", "online", "smartphone", "telephone", "television", "radio", "aeroplane", "airplane", "automobile",
    "motorcar", "nazi", "world war", "electricity", "electronic", "software", "email", "video", "nuclear", "astronaut", "quantum",
    "penicillin", "antibiotic",
)
#: Characters of a generated text in which a preamble is looked for, and least length of a text.
PREAMBLE_REACH, GENERATED_LEAST = 200, 20


def first_rule(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def first_match(text: Column, patterns: list[str]) -> Column:
    """What the first of the patterns that occurs in a text matches there, without regard to case; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i)({p})", 1), F.lit("")) for p in patterns])


def user_gate(user: Column, assistant: Column) -> Column:
    """Why a question and answer are not fit for training.

    In order: a short question, one that is no sentence, one of few different characters; then
    refusing beginnings and phrases of the answer.
    """
    return first_rule(
        (F.length(user) < USER_LEAST, "user_too_short"),
        (~F.right(F.trim(user), F.lit(1)).isin(*USER_CLOSERS), "user_not_sentence"),
        (F.size(F.array_distinct(characters(user))) <= USER_KINDS, "user_low_char_unique"),
        *[(assistant.startswith(x), name) for x, name in ANSWER_BEGINS],
        *[(assistant.contains(x), name) for x, name in ANSWER_HOLDS],
    )


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def instruction_match(text: Column) -> Column:
    """What of an instruction asks for something else than text; null if nothing does."""
    return F.coalesce(first_match(text, [rf"\b{t}\b" for t in NON_TEXT_OUTPUT]), F.trim(first_match(text, list(NON_TEXT_ACTION))))


def instruction_gate(text: Column) -> Column:
    """Why an instruction is no good task: too short, too long, pictures or performing asked for."""
    return first_rule(
        (_words(text) < 4, "too_short"),
        ((_words(text) > 60) | (F.length(text) > 400), "too_long"),
        (first_match(text, [rf"\b{t}\b" for t in NON_TEXT_OUTPUT]).isNotNull(), "non_text_output"),
        (first_match(text, list(NON_TEXT_ACTION)).isNotNull(), "non_text_action"),
    )


def foreign_patterns() -> list[str]:
    """The patterns of tasks about other languages, made of the lists above."""
    names, matter, verbs = ("|".join(x) for x in (LANGUAGES, LANGUAGE_MATTER, PRODUCING))
    return [
        *TRANSLATION, rf"\b(?:{names})\s+(?:{matter})\b", rf"\b(?:{names})\s+for\b",
        rf"\b(?:{verbs})\b[^.\n]{{0,40}}\b(?:in|into)\s+(?:{names})\b",
    ]


def foreign_task(text: Column) -> Column:
    """What of a text asks for another language, or its first letter beyond Latin-1; null for plain English."""
    letter = F.nullif(F.regexp_extract(text, r"([\p{L}&&[^\x00-\xFF]])", 1), F.lit(""))
    return F.coalesce(F.trim(first_match(text, foreign_patterns())), letter)


def output_flags(text: Column) -> dict[str, Column]:
    """Failure flags of a generated text: empty, meta, preamble, leak, junk, late."""
    t = F.trim(text)
    junk = SCAN_JUNK.replace("^", "\\^")
    return {
        "empty": F.length(t) < GENERATED_LEAST,
        "meta": t.rlike("(?i)" + META),
        "preamble": F.left(t, F.lit(PREAMBLE_REACH)).rlike("(?i)" + PREAMBLE),
        "leak": t.rlike("(?i)" + LEAK),
        "junk": text.rlike(f"[{junk}]"),
        "late": text.rlike(rf"(?i)\b({'|'.join(ANACHRONISMS)})\b"),
    }
