"""Problem 6: question and answer pairs that are broken, with the kind of the defect.

For every defect several noisy labelling functions vote +1, -1 or 0 (abstain). A label
model with one latent truth per defect learns by expectation maximization, from the counts
of vote patterns alone, how often each function votes what on defective and on sound
pairs; a pattern's posterior is the probability of the defect. Patterns are few (at most
3 to the number of functions), however many pairs there are. Labels above the cutoff of
their defect are kept, several where several hold; `p6_found` takes the first in the order of DEFECTS, as an
empty answer cannot be cut off and a refusal may be in any language.

Roles are read without case; whole repeated rows count once, and of several rows for one
turn the least is taken. A user turn without an assistant row after it is an empty answer.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..tables import table

#: In order of precedence.
DEFECTS = ("empty", "echo", "refusal", "other_language", "truncated")
#: Least posterior of a label. tests/llm/test_p6.py chooses cutoffs on labelled pairs by
#: `choose_cutoff` and holds these against them, and against pairs that it set aside.
CUTOFF = {"empty": 0.5, "echo": 0.5, "refusal": 0.5, "other_language": 0.5, "truncated": 0.5}
#: Spellings of the two roles.
USER, ASSISTANT = ("user", "human", "prompter"), ("assistant", "gpt", "model", "bot")

# Stand-ins for an answer, without case and outer punctuation.
STAND_INS = frozenset(
    "n/a na null none nil nan tbd tba tbc todo blank empty answer no_answer no_response pending unanswered "
    "undefined placeholder to_be_done to_come not_available not_applicable response output missing".split()
)
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and that is was with by his her unto shall not for it in which he she they there are thou from but "
    "than or who this i be as an upon into my your what have had were at these how doth readeth many where name set "
    "down recite tell say render",
    "fr": "le la les un une des du ce cet cette ces son sa ses notre nos et dans est que qui pour avec près mais où car "
    "parce tandis au aux il elle dit malgré dès de en ne pas sur je veut dire ceci",
    "de": "der die das ein eine einer eines und ist sein seine unser unsere dieser diese dieses nicht mit von für vor "
    "nach dem den des im am denn weil aber sagte während zu über er sie es ich auf was bedeutet satz",
    "es": "el la los las un una unos del al y su sus nuestro nuestra aquel aquella en es que con por para pero porque "
    "aunque según junto bajo después de la cuando no lo se qué significa esto",
    "la": "et in est non hic haec hoc ille illa quidam noster nostra cum sed nam quia ex ad apud sine post ante sub dum "
    "quamquam olim tandem atque per qui quod ut saepe fortasse statim quid significat",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# Letters and endings that belong to one of the languages.
_MARKS = {
    "fr": re.compile(r"[èêëœçâîôùûàé«»]|\b(?:l|d|qu|n|s)[’']"),
    "de": re.compile(r"[äöüß„]"),
    "es": re.compile(r"[ñ¿¡áíóú]"),
    "la": re.compile(r"(?:us|um|am|em|it|ibus|orum|arum|avit)\b"),
}
# Names of languages a request may ask for.
ASKED = {
    "en": "english anglais englisch inglés anglice anglicum",
    "fr": "french français französisch francés gallice gallicum",
    "de": "german allemand deutsch alemán germanice teutonice",
    "es": "spanish espagnol spanisch español hispanice castilian",
    "la": "latin latine latein latín latinum",
}
_ASKED = {w: k for k, v in ASKED.items() for w in v.split()}
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…][\"'’”»“)\]*_]*\s*$")
_REPEAT = re.compile(r"(?:say after me|repeat after me|repeat|recite after me|répétez|wiederhole|repite)[^:]{0,40}:\s*(.+)$", re.I | re.S)
_SORRY = re.compile(
    r"^(?:(?:i[’']m sorry|i am sorry|sorry|alas|dear \w+|with (?:great|all) respect|as an? \w+(?: \w+)?|"
    r"unfortunately|i apologi[sz]e|my apologies|pray forgive me|i regret)[,.;:!]?\s+)*",
    re.I,
)
# How a refusal begins, and what it refuses.
_REFUSE = re.compile(
    r"^(?:but )?(?:i (?:cannot|can ?not|can[’']t|am unable to|am not able to|am not permitted to|am not allowed to|"
    r"must decline to|must refuse to|may not|will not|won[’']t|shall not|decline to|refuse to|would rather not|"
    r"regret that i (?:may|can|must)(?:not| not)|beg to be excused|do not wish to|am forbidden to)|"
    r"(?:that )?i (?:may|can|must)(?: ?not)|it is not in my power to|it falls outside what i may do|"
    r"it is beyond (?:my|what)|forgive me, but i (?:will|can|may|shall) ?not|je ne peux pas|je ne puis|"
    r"es tut mir leid|ich kann (?:das|dies|diese|dir|ihnen)? ?nicht|lo siento|no puedo|non possum|ignosce)",
    re.I,
)
_REFUSED = re.compile(
    r"\b(?:recite|provide|answer|speak|help|assist|say|give|comply|respond|do (?:so|that|this)|discuss|request|"
    r"passage|matter|question|excused)\b|pas|nicht|puedo|possum",
    re.I,
)
_EXCUSE = re.compile(
    r"language model|for safety|my instructions|not be proper|no knowledge of it|wiser heads|another thing|"
    r"your pardon|my guidelines|help with (?:something|another)|not permitted",
    re.I,
)
# How else an answer declines: of the request as a matter, or by sending the asker away.
_DECLINE = re.compile(
    r"unanswered|(?:keep|maintain|observe) (?:my |a )?silence|hold my (?:peace|tongue)|"
    r"(?:is|are|lies?|lieth|falls?|falleth|goes|goeth|stands?) (?:\w+ )?(?:beyond|outside|against) (?:of )?(?:my|what)\b|"
    r"(?:find|ask|seek|consult|try|go to) (?:some ?one|somebody|another|others)\b|"
    r"(?:not|no|nothing|never)\b[^.,;:!?]{0,20}\bi (?:\w+ )?(?:discuss|speak|talk|say|answer|treat)\b|"
    r"\bi (?:do not|don[’']t|shall not|will not|cannot|can[’']t|may not|must not|never|would (?:rather|sooner) not|prefer not to) "
    r"(?:\w+ ){0,2}(?:discuss|answer|speak|talk|say|tell|give|recite|provide|help|respond|comment)\b|"
    r"\bi (?:must |shall |will |would |do |have to )?(?:decline|refuse|abstain|pass)\b|no comment|not at liberty|prefer not\b",
    re.I,
)
#: Words an answer uses of the asking itself, not of its matter.
_ASIDE = re.compile(r"\b(?:question|request|ask(?:ed|ing|est)?|answer(?:ed|ing)?|tell you|tell thee|discuss|apolog\w+|sorry|regret|forgive|pardon|silence)\b", re.I)
_QUOTED = re.compile(r"(?:(?<=\s)|^)(?:'[^']*(?:'(?!\w)|$)|‘[^’]*(?:’|$)|\"[^\"]*(?:\"|$)|“[^”]*(?:”|$)|«[^»]*(?:»|$)|„[^“”]*(?:[“”]|$))")
_FRAME = re.compile(r"^[^:\n]{1,80}:\s+")
_DOTS = re.compile(r"(?:\.\s?\.\s?\.|…)[^\w]*$")
_DANGLING = frozenset(
    "the of and a an his her their our to with by in at upon unto for or but as is was were are that which be from "
    "mr mrs dr le la les un une de des du et der die das ein und el los en y su mit von".split()
)
_KINSHIP = re.compile(r"^\s*(?:who |how many |where is it written|wer |qui |quién |quis )", re.I)
_REFERENCE = re.compile(r"^[\w’' -]+ \d+:\d+(?:-\d+)?$")
_COUNTED = re.compile(r"\b(?:two|three|four|five) (?:things|lessons|reasons|points)", re.I)


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def language_words(words: list[str]) -> dict[str, int]:
    """How many function words of each language there are."""
    return {k: sum(w in v for w in words) for k, v in _FUNCTION.items()}


def language(words: list[str]) -> str | None:
    """The language by function words; None without evidence or if two are equal."""
    n = language_words(words)
    first, second = sorted(n.values(), reverse=True)[:2]
    return max(n, key=lambda k: n[k]) if first > second else None


def mark_language(text: str) -> str | None:
    """The language by letters and endings, among those that have such; None without evidence."""
    low = text.lower()
    n = {k: len(p.findall(low)) / (3 if k == "la" else 1) for k, p in _MARKS.items()}
    best = max(n, key=lambda k: n[k])
    others = sorted(n.values())[-2]
    return best if n[best] >= 2 and n[best] > others else None


def common_words(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of places at a time."""
    at: dict[str, int] = {}
    for i, w in enumerate(y):
        at[w] = at.get(w, 0) | (1 << i)
    full = row = (1 << len(y)) - 1
    for w in x:
        u = row & at.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(y) - row.bit_count()


def _echo(q: list[str], a: list[str]) -> float:
    """How much of the answer is the question over and over, 0 to 1."""
    if len(q) < 2 or not a:
        return 0.0
    times = max(1, round(len(a) / len(q)))
    return 2 * common_words(a, q * times) / (len(q) * times + len(a))


#: The labelling functions by defect, in the order of the votes.
FUNCTIONS = {
    "empty": ("absent", "wordless", "stand_in"),
    "echo": ("same_words", "nothing_new", "alignment"),
    "refusal": ("opening", "object", "excuse", "declining", "aside"),
    "other_language": ("function_words", "letters"),
    "truncated": ("passage", "no_stop", "dangling", "open_quote", "promise"),
}


def votes(question: str | None, answer: str | None, passage: str | None) -> dict[str, list[int]]:
    """The votes of all functions on one pair; passage is the text asked for, if known."""
    q, a = question or "", (answer or "").replace("﻿", "").replace("​", "").strip()
    aw, qw = word_list(a), word_list(q)
    v = {d: [0] * len(f) for d, f in FUNCTIONS.items()}
    bare = re.sub(r"[\s_-]+", "_", a.lower().strip(" \t\r\n.,;:!?…\"'“”‘’()[]{}<>*-_"))
    wordless, stand = not aw, bare in STAND_INS
    v["empty"] = [
        1 if answer is None else 0,
        1 if wordless else (0 if len(aw) <= 3 else -1),
        0 if wordless else (1 if stand else -1),
    ]
    if wordless or stand:
        for d in DEFECTS[1:]:
            v[d] = [-1] * len(FUNCTIONS[d])
        return v
    m = _REPEAT.search(q)
    wanted = word_list(m.group(1)) if m else []
    # echo
    if qw:
        gives = m is not None and aw != qw and aw == wanted
        frame = _FRAME.match(a)
        best = (False, False, 0.0)
        for cw in [aw] + ([word_list(a[frame.end() :])] if frame and len(word_list(frame[0])) <= 8 else []):
            new = sum((Counter(cw) - Counter(qw * (1 + len(cw) // len(qw)))).values())
            # an answer of mostly other words is no echo
            e = _echo(qw, cw) if new <= 0.25 * len(cw) else 0.0
            same = any(cw[k:] == qw for k in range(9))
            best = max(best, (same, new <= 3 and len(cw) >= 0.9 * len(qw) and e > 0.8, e))
        v["echo"] = [1 if x and not gives else -1 for x in (best[0], best[1], best[2] >= 0.85)]
    # refusal
    body = a[_SORRY.match(a).end() :] if a[:1] not in "\"'“‘„«" else ""
    first = re.split(r"(?<=[.!?])\s", body, maxsplit=1)[0]
    opens = bool(_REFUSE.match(first)) and not re.search(r"too (?:highly|much)|enough\b|praise", first, re.I)
    # what others say in the answer, or what the question says already, declines nothing
    own = _QUOTED.sub(" ", a) if len(aw) <= 40 else ""
    declines = bool(_DECLINE.search(own)) and not _DECLINE.search(q)
    v["refusal"] = [
        1 if opens else (0 if declines else -1),
        (1 if _REFUSED.search(first) else 0) if opens or declines else -1,
        1 if opens and _EXCUSE.search(a) else 0,
        1 if declines else (0 if opens else -1),
        1 if own and _ASIDE.search(own) and not _ASIDE.search(q) else 0,
    ]
    # language
    allowed = {_ASKED[w] for w in qw if w in _ASKED}
    ql = language(qw)
    if ql:
        allowed.add(ql)
    if allowed and len(aw) >= 4:
        # a quotation may be in any language if enough is said around it
        around = _QUOTED.sub(" ", a)
        said = a if len(word_list(around)) < 6 else around
        n = language_words(word_list(said))
        own_n, other = max(n[k] for k in allowed), max((n[k] for k in n if k not in allowed), default=0)
        lead = other - own_n
        ml = mark_language(said)
        v["other_language"] = [
            1 if lead >= 2 or (lead == 1 and len(aw) < 9) else (-1 if lead < 0 else 0),
            (-1 if lead < 0 else 1 if lead > 0 and "en" not in allowed and n["en"] == other else 0) if ml is None else (-1 if ml in allowed else 1),
        ]
    elif allowed:
        v["other_language"] = [-1, 0]
    # truncation
    ended = bool(_END.search(a)) and not _DOTS.search(a)
    t = [0] * 5
    pw = word_list(passage) if passage else wanted
    if pw:
        joined, whole = " ".join(aw) + " ", " ".join(pw)
        if f"{whole} " in joined:
            t[0] = -1
        elif whole.startswith(joined.rstrip()) or (len(aw) > 4 and whole.startswith(" ".join(aw[:-1]) + " ")):
            t[0] = 1
        elif not ended and any(f"{' '.join(aw[k:-1])} " in f"{whole} " for k in (0, 5, 6, 7, 8, 9) if len(aw) - k > 4):
            t[0] = 1
    short = bool(_KINSHIP.match(q)) and (len(aw) <= 4 or bool(_REFERENCE.match(a)))
    quoted = a[0] in "\"“'‘„«" and a[-1] in "\"”'’“»"
    t[1] = -1 if ended or short or t[0] == -1 else (0 if quoted or len(aw) < 3 else 1)
    t[2] = 1 if aw[-1] in _DANGLING and not ended and t[0] != -1 else (-1 if ended else 0)
    opened = sum(a.count(c) for c in "“„«") > sum(a.count(c) for c in "”»") + a.count("“") * ("„" in a)
    opened |= a.count('"') % 2 == 1
    opened |= bool(re.search(r"(?:^|[\s:(])'(?=\w)", a)) and not re.search(r"'[\s.,;:)!?]*$", a) and not ended
    t[3] = 1 if opened and t[0] != -1 else 0
    t[4] = 1 if _COUNTED.search(a) and not re.search(r"\b(?:third|fifth|fourth|second and last)", a, re.I) else 0
    v["truncated"] = t
    return v


def fit_label_model(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation maximization.

    Functions are taken as independent given the truth; an abstention tells nothing. The
    prior (positive votes on 85 % of defective and 3 % of sound pairs, a defect in 5 % of
    pairs) weighs as much as a tenth of the pairs; it names the classes.
    """
    keys = sorted(patterns)
    x = np.array(keys)
    n = np.array([patterns[k] for k in keys], float)
    onehot = np.stack([(x == t) for t in (-1, 1)], axis=2).astype(float)
    weight = max(5.0, 0.1 * n.sum())
    like = {1: np.array([0.15, 0.85]), 0: np.array([0.97, 0.03])}
    p = {y: np.tile(like[y], (x.shape[1], 1)) for y in (0, 1)}
    pi = 0.05
    post = np.zeros(len(keys))
    for _ in range(rounds):
        l1 = np.log(pi) + (onehot * np.log(p[1])).sum((1, 2))
        l0 = np.log(1 - pi) + (onehot * np.log(p[0])).sum((1, 2))
        new = 1 / (1 + np.exp(np.clip(l0 - l1, -60, 60)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
        pi = float(np.clip((0.05 * weight + (n * post).sum()) / (weight + n.sum()), 1e-4, 0.5))
        for y, r in ((1, n * post), (0, n * (1 - post))):
            # the positive class is small: its prior weighs in proportion
            w = weight * (0.05 if y else 0.95)
            p[y] = np.clip(w * like[y] + (r[:, None, None] * onehot).sum(0), 1e-6, None)
            p[y] /= p[y].sum(1, keepdims=True)
    return dict(zip(keys, post.tolist(), strict=True))


def choose_cutoff(posteriors: list[float], truths: list[bool]) -> tuple[float, float, float]:
    """(least, greatest, F1): the cutoffs of the best F1 on labelled pairs, as a range (least excluded)."""
    marks = sorted({0.0, *posteriors, 1.0})
    best = (-1.0, 0.0, 0.0)
    for low, high in zip(marks, marks[1:], strict=False):
        hit = sum(t and p >= high for p, t in zip(posteriors, truths, strict=True))
        wrong = sum(p >= high for p in posteriors) - hit
        f1 = 2 * hit / max(1, hit + wrong + sum(truths))
        best = max(best, (f1, high - low, low))
    f1, size, low = best
    return low, low + size, f1


def _role(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*USER), "user").when(low.isin(*ASSISTANT), "assistant").otherwise(low)


_REF = r"((?:[1-9] )?\p{Lu}[\p{L}'’-]*(?: (?:of|to|the|\p{Lu}[\p{L}'’-]*))*) (\d{1,4}):(\d{1,4})(?:-(\d{1,4}))?"


def pairs_of(messages: DataFrame, scripture: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, question, answer, passage): one row for each user turn."""
    m = (
        messages.select("conv_id", F.col("turn").cast("int").alias("turn"), _role(F.col("role")).alias("role"), "content")
        .filter("conv_id is not null and turn is not null")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("role", "content")).alias("m"))
        .select("conv_id", "turn", "m.role", "m.content")
    )
    users = m.filter("role = 'user'").select("conv_id", "turn", F.col("content").alias("question"))
    answers = m.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer")
    )
    both = users.join(answers, ["conv_id", "turn"], "left")
    if scripture is None:
        return both.withColumn("passage", F.lit(None).cast("string"))
    said = F.coalesce(F.when(F.col("question").rlike(_REF), F.col("question")), F.regexp_replace("answer", "^In ", ""), F.lit(""))
    part = lambda i: F.regexp_extract(said, _REF, i)
    both = both.select(
        "*",
        F.lower(part(1)).alias("book"),
        part(2).try_cast("int").alias("chapter"),
        part(3).try_cast("int").alias("v1"),
        part(4).try_cast("int").alias("v2"),
    )
    chapters = scripture.groupBy(F.lower(F.trim("book")).alias("book"), F.col("chapter").cast("int").alias("chapter")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("verse").cast("int").alias("verse"), "text"))).alias("verses")
    )
    chosen = F.filter(
        "verses", lambda x: (x["verse"] >= F.col("v1")) & (x["verse"] <= F.coalesce(F.col("v2"), F.col("v1")))
    )
    passage = F.array_join(F.transform(chosen, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return both.join(chapters, ["book", "chapter"], "left").select(
        "conv_id", "turn", "question", "answer", F.nullif(passage, F.lit("")).alias("passage")
    )


def voted(pairs: DataFrame) -> DataFrame:
    """(conv_id, turn, and a vote pattern such as '+0-' for each defect)."""
    code = {-1: "-", 0: "0", 1: "+"}

    def run(batches):
        for b in batches:
            q, a, p = (b.column(i).to_pylist() for i in (2, 3, 4))
            vs = [votes(*x) for x in zip(q, a, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1)]
                + [pa.array(["".join(code[s] for s in v[d]) for v in vs], pa.string()) for d in DEFECTS],
                ["conv_id", "turn", *DEFECTS],
            )

    schema = "conv_id long, turn int, " + ", ".join(f"{d} string" for d in DEFECTS)
    src = pairs.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "question", "answer", "passage")
    return src.mapInArrow(run, schema)


def label(pairs: DataFrame) -> DataFrame:
    """(conv_id, turn, labels ARRAY<STRUCT<defect, posterior>>), defective pairs only."""
    v = staged(voted(pairs), "pair-votes")
    spark = v.sparkSession
    long = v.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x"))
    # at most 3^5 patterns of a defect, whatever the number of pairs
    counts: dict[str, dict] = {d: {} for d in DEFECTS}
    back = {"-": -1, "0": 0, "+": 1}
    for r in long.groupBy("x.defect", "x.pattern").count().collect():
        counts[r["defect"]][tuple(back[c] for c in r["pattern"])] = r["count"]
    rows = []
    for k, d in enumerate(DEFECTS):
        for pattern, p in (fit_label_model(counts[d]) if counts[d] else {}).items():
            if p >= CUTOFF[d]:
                rows.append((d, "".join("-0+"[s + 1] for s in pattern), float(p), k))
    model = spark.createDataFrame(rows, "defect string, pattern string, posterior double, place int")
    out = v.select(
        "conv_id",
        "turn",
        F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x"),
    ).select("conv_id", "turn", "x.defect", "x.pattern")
    return (
        out.join(F.broadcast(model), ["defect", "pattern"])
        .groupBy("conv_id", "turn")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", "defect", "posterior"))
            ).alias("labels")
        )
    )


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "bible1611_verses")
    return label(pairs_of(m, table(spark, folder, "scripture")))


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, labels: all labels of each defective pair with their posteriors."""
    out = _labelled(spark, folder)
    return out.select(
        "conv_id", "turn", F.transform("labels", lambda x: F.struct(x["defect"], F.round(x["posterior"], 6).alias("posterior"))).alias("labels")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, defect: one row for each defective pair."""
    return _labelled(spark, folder).select("conv_id", "turn", F.col("labels")[0]["defect"].alias("defect"))


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels}
ORACLE: dict[str, str] = {}
