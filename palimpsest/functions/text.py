"""Column functions on text. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that hardly occur in clean prose.
NOISE = "•▪■□●○◦·※†‡§¶¤¦¨¬¯´¸×÷=~^|\\{}<>@#$%&*_+"
# Letters, digits and marks the quality measure tells apart.
QUALITY_LETTERS = "a-zA-Zα-ωΑ-ΩàâäçèéêëîïôöùûüÿæœßÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸÆŒµ"
QUALITY_DIGITS = "0-9 \\n"
QUALITY_MARKS = ".,;!?'\"_\\-"


def count_of(text: Column, char_class: str) -> Column:
    """Number of characters in a class such as 'a-z'."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]", ""))


def noise_class() -> str:
    """NOISE as a class, escaped."""
    return "".join("\\" + c if c in "\\^]-[{}|&~" else c for c in NOISE)


def normalized(text: Column) -> Column:
    """Runs of anything but ASCII letters, digits and _ become one blank; case is kept."""
    return F.regexp_replace(text, r"\W+", " ")


def normalized_unicode(text: Column) -> Column:
    """The same with the letters and digits of all scripts."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")


def content_id(text: Column, mode: str = "ascii") -> Column:
    """Hex SHA-512/256 of the normalized text, null for null. mode 'ascii' or 'unicode'."""
    n = normalized(text) if mode == "ascii" else normalized_unicode(text)
    sha = F.reflect(F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit("sha512_256Hex"), n)
    return F.when(n.isNotNull(), sha)


def store_tokens(text: Column) -> Column:
    """Pieces between white space without outer characters that are no letters or digits."""
    pieces = F.split(text, r"\s+")
    bare = F.transform(pieces, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-case words of a-z with inner apostrophes; curly ones become straight."""
    return F.regexp_extract_all(F.translate(F.lower(text), "’‘", "''"), F.lit("([a-z]+(?:'[a-z]+)*)"), F.lit(1))


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def space_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """The characters of a text, as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def sentence_count(text: Column) -> Column:
    """Pieces that are not blank between sentence boundaries; 1 at least."""
    marked = F.regexp_replace(text, r"([.!?][\"']?\s+(?=[A-Z\"'])|[\n\r]{2,}\s*(?=[a-zA-Z\"']))", "$1\u0001")
    return F.greatest(F.lit(1), F.size(F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")))


def strip_front_matter(text: Column) -> Column:
    """Without a leading block between lines of three dashes; an unclosed block stays."""
    return F.regexp_replace(text, r"^---\s*\n(?:[\s\S]*?\n)?---\s*\n*", "")


def strip_think(text: Column) -> Column:
    """Without thinking blocks and stray thinking tags; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?is)<think>.*?</think>", " "), "(?i)</?think>", " "))


def scan_clean(text: Column, keep_paragraphs: bool = False) -> Column:
    """Scanned text: joined hyphens, no speckles, no blank before punctuation, single blanks."""
    t = F.regexp_replace(text, r"(?<=\w)[-¬]\s*\n\s*(?=\w)", "")
    t = F.regexp_replace(t, r"[\^|•~¬■□▪●◦♦†‡¤¢∎_]", "")
    t = F.regexp_replace(t, r"\s+([;:,.!?])", "$1")
    if not keep_paragraphs:
        return F.trim(F.regexp_replace(t, r"\s+", " "))
    paragraphs = F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), which no built-in has: ligatures become letters."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def scan_cleaned(text: Column, keep_paragraphs: bool = False) -> Column:
    """scan_clean of the text in compatibility composition."""
    return scan_clean(compatible(text), keep_paragraphs)


def unify_quotes(text: Column) -> Column:
    """Quoting marks and dashes of all kinds become plain ones."""
    return F.translate(text, "“”„‟″‘’‚‛′‐‑‒–—―", "\"\"\"\"\"'''''------")


def dialogue_norm(text: Column) -> Column:
    """Plain quotes, no short bracketed insertions, no underscores, single blanks."""
    t = F.regexp_replace(unify_quotes(text), r"\[[^\]]{0,60}\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "_", ""), r"\s+", " "))


def speaker_label(name: Column) -> Column:
    """A speaker's label without outer quotes, colons and commas, with single blanks."""
    t = F.regexp_replace(F.trim(name), "^[\"“”' ]+|[\"“”' ]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "[:,]+$", ""))


def is_unknown_speaker(name: Column) -> Column:
    return F.lower(F.trim(name)).isin("", "unknown", "unknown speaker", "?")


def join_turns(left: Column, right: Column, sep: str = " ") -> Column:
    """Two turns of one speaker; a comma before a capital becomes a full stop."""
    a, b = F.rtrim(left), F.ltrim(right)
    stop = a.endswith(",") & b.rlike("^[A-Z]")
    return (
        F.when((left == "") | left.isNull(), right)
        .when(b == "", a)
        .when(stop, F.concat(F.regexp_replace(a, ",$", "."), F.lit(sep), b))
        .otherwise(F.concat(a, F.lit(sep), b))
    )


def slug(text: Column) -> Column:
    """Runs of anything but ASCII letters and digits become a dash; none outside."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def answer_tokens(text: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, without a, an, the."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))


def shortened(text: Column, most: int = 16000, marker: str = "\n... [TRUNCATED] ...\n") -> Column:
    """Texts above `most` characters as their two outer halves around a marker."""
    half = most // 2
    return F.when(
        F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))
    ).otherwise(text)


def boundary_score(text: Column) -> Column:
    """How clean a cut after a text is: 3 paragraph, 2 sentence, 1 no letter, 0 within a word."""
    return (
        F.when(text.rlike(r"(?:\n\n|\r\n\r\n)\s*$"), 3)
        .when(text.rlike("[.!?…][\"')\\]]*\\s*$"), 2)
        .when(F.trim(text).rlike(r"[^\p{L}]$"), 1)
        .otherwise(0)
    )


def with_end_mark(text: Column, eos: str) -> Column:
    """The text closed by a line end and the end mark, unless it ends with the mark already."""
    if not eos:
        return text
    return F.when(F.rtrim(text).endswith(eos), text).otherwise(F.concat(text, F.lit("\n" + eos)))


def rendered(template: Column, **values: Column) -> Column:
    """A template with {name} replaced literally."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def list_argument(text: Column) -> Column:
    """Parts between commas, semicolons and blanks."""
    return F.filter(F.split(text, "[,; ]"), lambda p: p != "")


def human_count(n: Column) -> Column:
    """A count with K, M, B or T and one decimal."""
    out = n.cast("string")
    for size, letter in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n / size), F.lit(letter))).otherwise(out)
    return out


def oxford(items: Column, word: str = "and") -> Column:
    """'a', 'a and b', 'a, b, and c' of an array of strings."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.element_at(items, 1))
        .when(n == 2, F.array_join(items, f" {word} "))
        .otherwise(
            F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(f", {word} "), F.element_at(items, -1))
        )
    )


def century_ordinal(year: Column) -> Column:
    """'19th century' of 1801."""
    c = (F.floor((year - 1) / 100) + 1).cast("int")
    tail = (
        F.when(c.between(11, 13), "th")
        .when(c % 10 == 1, "st")
        .when(c % 10 == 2, "nd")
        .when(c % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(c.cast("string"), tail, F.lit(" century"))


def sentences(text: Column) -> Column:
    """Sentences: pieces between white space that follows a stop and stands before a capital or a quoting mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'“”‘’])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def human_bytes(n: Column) -> Column:
    """A size with B, KiB, MiB, GiB or TiB and one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f ", F.bround(n / 1024**power, 1)), F.lit(unit))).otherwise(out)
    return out


def hex_successor(prefix: Column) -> Column:
    """The least string above all that begin with a hex prefix: its last digit that is not f raised, what follows cut; null for only f."""
    kept = F.regexp_replace(F.lower(prefix), "f+$", "")
    last = F.conv(F.right(kept, F.lit(1)), 16, 10).cast("int") + 1
    return F.when(kept != "", F.concat(F.left(kept, F.length(kept) - 1), F.lower(F.conv(last.cast("string"), 10, 16))))


def text_first(template: Column) -> Column:
    """A template with {text} first and its instructions below."""
    before, after = F.substring_index(template, "{text}", 1), F.substring_index(template, "{text}", -1)
    parts = F.filter(F.array(F.trim(before), F.trim(after)), lambda p: p != "")
    return F.when(F.contains(template, F.lit("{text}")), F.concat(F.lit("{text}\n\n"), F.array_join(parts, "\n"))).otherwise(template)


def usable_template(template: Column, era: str | None) -> Column:
    """Whether a template has a place for the text, and an era is given if it asks for one."""
    ok = F.contains(template, F.lit("{text}"))
    return F.coalesce(ok if era else ok & ~F.contains(template, F.lit("{era}")), F.lit(False))


def word_range(spec: Column) -> Column:
    """STRUCT<low, high> of 'MIN-MAX' or 'N'; null if it is no range or upside down."""
    low = F.regexp_extract(spec, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int")
    high = F.coalesce(F.regexp_extract(spec, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int"), low)
    return F.when((low > 0) & (low <= high), F.struct(low.alias("low"), high.alias("high")))


def by_alias(name: Column, aliases: dict[str, str]) -> Column:
    """The full name of an alias, without regard to case and outer blanks; other names trimmed as they are."""
    m = F.create_map(*[F.lit(x) for k, v in sorted(aliases.items()) for x in (k.lower(), v)]) if aliases else F.create_map()
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(name))), F.trim(name)) if aliases else F.trim(name)


def left_truncated(ids: Column, most: int) -> Column:
    """The last `most` of an array of tokens."""
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)
