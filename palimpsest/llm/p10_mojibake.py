"""Problem 10: text garbled by a wrong character encoding.

The garbled sequences of all encoding pairs are computed beforehand: what each character
of the alphabets below becomes when its bytes of one encoding are read in another. They
form one Aho-Corasick automaton, with all characters of the code pages in the alphabet. Multi-byte sequences (UTF-8 read as a single-byte code
page) speak for themselves; of single-byte mistakes only those sequences are evidence that
no proper text has (a lower-case letter before a capital with an accent, a letter of
another script, or a sign). Only matched spans are replaced, in rounds until nothing is left,
so that text garbled several times comes back too; right text beside them is left as it is.
Several single-byte mistakes may meet in a text: each match is undone by its own one, or if
several explain it by the one that explains most of the text.

Of single-byte mistakes the other letters of a word with a match are read again too, unless
one of them is right as it stands, and so are words without a match that stand between two
such words of their line, with no right one between; beside one such word only signs inside
words and capitals before small letters are. Other garbled words without a match stay as they
are: nothing tells them from right ones.

Null and empty texts are never garbled. The replacement character marks a loss: such
documents are found, and restored as far as the rest goes.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table

#: Code pages that UTF-8 is wrongly read in.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15", "cp1254")
#: Single-byte mistakes (true encoding, the one it was read in).
BYTE_PAIRS = (
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1251"),
    ("cp1252", "cp1250"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
)
#: The characters that texts may hold: Latin, Greek, Cyrillic, punctuation, currency, ligatures.
ALPHABET = [
    *map(chr, range(0x80, 0x180)),
    *map(chr, range(0x391, 0x3CF)),
    *map(chr, range(0x1F00, 0x1F10)),
    *map(chr, range(0x410, 0x450)),
    *"‐‑‒–—―‘’‚“”„†‡•…‰‹›€™ﬀﬁﬂﬃﬄﬅﬆſ﻿",
]
# what each page's upper half holds: text garbled again and again consists of such characters
ALPHABET += sorted({bytes([b]).decode(p, "ignore") for p in UTF8_READ_AS for b in range(0x80, 0x100)} - {*ALPHABET, ""})
#: Signs that scanning leaves inside words; alone they are no evidence.
SCAN_SIGNS = "¡¢£°†‡·•■|^«»¬§¤¶×÷ı~±"
LOST = "�"


def _read(raw: bytes, page: str) -> str:
    """raw read in a code page; bytes it lacks become the C1 controls, as browsers do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def utf8_sequences() -> dict[str, tuple[str, str]]:
    """Garbled sequence -> (character, code page) of UTF-8 read in each page."""
    out: dict[str, tuple[str, str]] = {}
    for page in UTF8_READ_AS:
        for c in ALPHABET:
            seq = _read(c.encode(), page)
            if not any(ord(x) < 0x80 for x in seq):
                out.setdefault(seq, (c, page))
    # the closing quote's last byte has no character in this page and is often dropped
    out.setdefault("â€", ("”", "cp1252"))
    return out


def byte_sequences(pairs: tuple = BYTE_PAIRS) -> dict[str, tuple[str, str]]:
    """Impossible sequence -> (restored, pair) of the single-byte mistakes."""
    out: dict[str, tuple[str, str]] = {}
    small = [chr(x) for x in range(ord("a"), ord("z") + 1)]
    for true, wrong in pairs:
        name = f"{true}>{wrong}"
        for c in [*map(chr, range(0xDF, 0x100)), "œ"]:
            try:
                g = c.encode(true).decode(wrong)
            except UnicodeError:
                continue
            script = "LATIN" if ord(g) < 0x250 else "OTHER"
            odd = (g.isalpha() and g.isupper()) or (g.isalpha() and script == "OTHER") or g in "‰ˆ˘˙˚¸˝˛ˇ˜¯"
            if g == c or g in SCAN_SIGNS or not odd or g in "ﬀﬁﬂﬃﬄﬅﬆſ":
                continue
            for s in small:
                out.setdefault(s + g, (s + c, name))
        for c, before, after in (
            ("“", " \n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            ("„", " \n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            ("¿", " \n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            ("”", ".,!?", " \n"),
            ("’", "r", "s"),
            ("—", "", ""),
        ):
            try:
                g = c.encode(true).decode(wrong)
            except UnicodeError:
                continue
            if g == c or not g.isalpha() or not before:
                continue
            for b in before:
                for a in after:
                    if b == "r" and g == "í":
                        continue
                    # an accented capital at a word's beginning is only odd before a small letter's capital
                    out.setdefault(b + g + a, (b + c + a, name))
    return out


#: Signs that are right as they stand outside a matched span.
_KEPT = frozenset("“”‘’–—…«»£°§")
#: What a garbled character of a word can stand for.
_LIKELY = frozenset([*map(chr, range(0xDF, 0xF7)), *map(chr, range(0xF8, 0x100)), *"œ“”’—–„¿¡«»"])
_LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"
#: Sequences that scanned or junk text has too; they count only beside others of their page.
_WEAK = re.compile(r"^(?:¬(?![£ª´ø])|[ÐÑÄÅÎÏ]|Æ’)")


class Repairer:
    """The automaton and its tables; built once a worker."""

    def __init__(self):
        import ahocorasick

        self.utf8 = utf8_sequences()
        self.byte = byte_sequences()
        # multi-byte sequences are looked for first, single-byte mistakes in what is left
        self.auto, self.auto_byte = ahocorasick.Automaton(), ahocorasick.Automaton()
        for seq, (c, page) in self.utf8.items():
            self.auto.add_word(seq, (seq, c, page))
        self.auto.add_word(LOST, (LOST, LOST, "lost"))
        for seq, (c, page) in self.byte.items():
            self.auto_byte.add_word(seq, (seq, c, page))
        self.auto.make_automaton()
        self.auto_byte.make_automaton()
        self.back = {}
        for true, wrong in BYTE_PAIRS:
            m = {}
            for b in range(0x80, 0x100):
                try:
                    m[bytes([b]).decode(wrong)] = bytes([b]).decode(true)
                except UnicodeDecodeError:
                    pass
            self.back[f"{true}>{wrong}"] = m
        self.own = {f"{a}>{b}": byte_sequences(((a, b),)) for a, b in BYTE_PAIRS}

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, replacement, kind) of the multi-byte sequences that are evidence."""
        found: list[tuple[int, int, str, str, bool]] = []
        for end, (seq, c, page) in self.auto.iter_long(text):
            a = end + 1 - len(seq)
            # a letter between quoting marks: garbled text would have the first mark garbled too
            if len(seq) == 2 and text[end] == "»" and text[a - 1 : a] == "«" and not (found and found[-1][1] == a):
                continue
            found.append((a, end + 1, c, page, bool(_WEAK.match(seq))))
        strong = {p for *_, p, w in found if not w}
        out = []
        for i, (a, b, c, p, weak) in enumerate(found):
            if weak and p not in strong:
                # Greek and Cyrillic come as runs of sequences
                near = (i and found[i - 1][1] == a and found[i - 1][3] == p) or (
                    i + 1 < len(found) and found[i + 1][0] == b and found[i + 1][3] == p
                )
                if not near or text[a] == "¬":
                    continue
            out.append((a, b, c, p))
        return out

    def byte_pair(self, text: str) -> Counter:
        """How much evidence of the text each single-byte mistake explains."""
        n: Counter = Counter()
        for seq, k in Counter(seq for _, (seq, _, _) in self.auto_byte.iter_long(text)).items():
            for page in self.own:
                n[page] += k * (seq in self.own[page])
        return +n

    def byte_repair(self, text: str) -> tuple[str, int, set[str]]:
        """(text with its single-byte mistakes undone, their matches, their kinds)."""
        pairs = self.byte_pair(text)
        if not pairs:
            return text, 0, set()
        # a match that several mistakes explain is of the one that explains most of the text
        order = sorted(pairs, key=lambda p: (-pairs[p], [*self.own].index(p)))
        done = [self._line(line, order) for line in text.split("\n")]
        return "\n".join(x[0] for x in done), sum(x[1] for x in done), {k for x in done for k in x[2]}

    def _line(self, line: str, order: list[str]) -> tuple[str, int, set[str]]:
        if line.isascii():
            return line, 0, set()
        out, inside, kind, hits = list(line), [False] * len(line), {}, 0
        for end, (seq, _, _) in self.auto_byte.iter_long(f"\n{line}\n"):
            page = next(p for p in order if seq in self.own[p])
            c, hits = self.own[page][seq][0], hits + 1
            for k in range(len(seq)):
                i = end - len(seq) + k  # the line begins after a line break
                if seq[k] != c[k]:
                    out[i], inside[i], kind[i] = c[k], True, page
        if not kind:
            return line, 0, set()
        # of each word: its mistake, whether a match is in it, whether a letter is right as it stands
        words = []
        for m in re.finditer(r"\S+", line):
            at = [i for i in range(*m.span()) if line[i] > "\x7f"]
            hit = [kind[i] for i in at if inside[i]]
            back = self.back[hit[0] if hit else order[0]]
            rest = [i for i in at if not inside[i] and line[i] not in _KEPT]
            right = any(line[i].isalpha() and back.get(line[i]) not in _LIKELY for i in rest)
            if hit:
                # a small letter beside the match may be right
                right = right or any(line[i].islower() and not self._odd(line, i) for i in rest)
            if at:
                words.append((rest, hit[:1], right))
        sure = [k for k, (_, hit, right) in enumerate(words) if hit or right]
        for k, (rest, hit, right) in enumerate(words):
            if right or not rest:
                continue
            near = [j for j in (max((j for j in sure if j < k), default=None), min((j for j in sure if j > k), default=None)) if j is not None]
            beside = [not words[j][2] for j in near]
            if not hit and not (beside and all(beside)):
                continue
            back = self.back[(hit or words[near[0]][1] or order)[0]]
            for i in rest:
                if back.get(line[i]) in _LIKELY and (hit or len(beside) == 2 or self._odd(line, i)):
                    out[i] = back[line[i]]
        return "".join(out), hits, set(kind.values())

    @staticmethod
    def _odd(line: str, i: int) -> bool:
        """Whether no right word has the character there: a sign or ligature in a word, a capital
        in the middle, an elided word's letter before one."""
        x, before, after = line[i], line[i - 1 : i], line[i + 1 : i + 2]
        if x == "í":
            return after > "\x7f" and after.isupper()
        if x in _LIGATURES or not x.isalpha():
            return before.isalpha() or after.isalpha()
        return x.isupper() and before.isalpha() and after.islower()

    def repair(self, text: str | None) -> tuple[str | None, int, list[str]]:
        """(restored text, replaced spans, kinds); the text itself where nothing is garbled.

        Rounds go on until nothing is found; each makes the text shorter or its evidence less.
        """
        if not text or text.isascii():
            return text, 0, []
        total, kinds, lost = 0, set(), text.count(LOST)
        if lost:
            total, kinds = lost, {"lost"}
        while True:
            todo = [s for s in self.spans(text) if s[3] != "lost"]
            if todo:
                total += len(todo)
                kinds.update(p for *_, p in todo)
                parts, at = [], 0
                for a, b, c, _ in todo:
                    parts += [text[at:a], c]
                    at = b
                text = "".join([*parts, text[at:]])
                continue
            fixed, n, pages = self.byte_repair(text)
            total += n
            kinds |= pages
            if fixed == text or sum(self.byte_pair(fixed).values()) >= sum(self.byte_pair(text).values()):
                return fixed, total, sorted(kinds)
            text = fixed


_REPAIRER: list[Repairer] = []


def repairer() -> Repairer:
    if not _REPAIRER:
        _REPAIRER.append(Repairer())
    return _REPAIRER[0]


def repair_column(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kinds, spans, restorable, restored) of the garbled rows of df only.

    restorable tells that nothing was lost, as far as can be known.
    """

    def run(batches):
        r = repairer()
        for b in batches:
            keys = b.column(0)
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                fixed, n, kinds = r.repair(t)
                if n:
                    rows.append((keys[i].as_py(), kinds, n, LOST not in fixed, fixed))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                ["k", "kinds", "spans", "restorable", "restored"],
            )

    src = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null")
    return src.mapInArrow(
        run, "k long, kinds array<string>, spans int, restorable boolean, restored string"
    ).withColumnRenamed("k", key)


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, kinds, spans, restorable, restored of every garbled document."""
    return repair_column(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the garbled documents."""
    return p10_repaired(spark, folder).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_repaired": p10_repaired}
ORACLE: dict[str, str] = {}
