"""Text functions and metrics against plain Python."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import metrics as M
from palimpsest.functions import text as T

TEXTS = ["", "Hello world! \"It is.\" He said", "αβγ δεζ", "a_b  c\n\nd e", "Été d’été; c'est 12½!", "x" * 300, None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def col(df, c):
    return {r[0]: r[1] for r in df.select("i", c).collect()}


def test_content_id(df):
    got = col(df, T.content_id(F.col("text")))
    for i, t in enumerate(TEXTS):
        want = t and hashlib.new("sha512_256", re.sub(r"\W+", " ", t, flags=re.ASCII).encode()).hexdigest()
        assert got[i] == want if t else True
    assert got[6] is None
    u = col(df, T.content_id(F.col("text"), "unicode"))
    assert u[2] == hashlib.new("sha512_256", TEXTS[2].encode()).hexdigest()


def test_compress_and_quality(df):
    got = col(df, M.compress("text"))
    assert got[0] is None and got[6] is None
    c = zlib.compressobj(wbits=-15)
    raw = TEXTS[1].encode()
    assert got[1] == pytest.approx(100 * ((len(c.compress(raw)) + len(c.flush())) / len(raw) + 0.5))
    assert col(df, M.quality(F.col("text")))[5] == pytest.approx(125.0)


def test_prefilter(df):
    assert not any(col(df, M.prefilter(F.col("text"))).values())


GOLDEN = [
    ((100, 100, 100, 100, 100, 100), 100, 100), ((100,) * 6, 0, 0), ((100,) * 6, 123.36, 123.36),
    ((99, 99, 99, 100, 100, 100), 123.36, 120.36), ((100, 100, 100, 101, 101, 101), 123.36, 120.36),
    ((99, 101, 101, 99, 101, 99), 100, 94), ((None, float("nan"), 100, 100, 100, 100), 100, -100),
]


def test_global_score(spark):
    rows = [(*map(lambda x: x if x is None else float(x), m), float(q)) for m, q, _ in GOLDEN]
    d = spark.createDataFrame(rows, ", ".join(f"{m} double" for m in (*M.METRICS, "quality")))
    got = [r[0] for r in d.select(M.global_score()).collect()]
    assert got == pytest.approx([w for *_, w in GOLDEN])


def test_front_matter_and_think(spark):
    d = spark.createDataFrame([("---\ntitle: x\n---\nBody", "<think>a\nb</think>yes </THINK>"), ("---\nopen", None)], "a string, b string")
    got = d.select(T.strip_front_matter(F.col("a")), T.strip_think(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("Body", "yes"), ("---\nopen", None)]


@pytest.mark.parametrize(
    "raw, clean",
    [("a won-\nderful day ; yes", "a wonderful day; yes"), ("he•llo ■ there", "hello there"), ("a-\nb-\nc", "abc"), ("naïve — £5", "naïve — £5")],
)
def test_scan_clean(spark, raw, clean):
    d = spark.createDataFrame([(raw,)], "t string")
    assert d.select(T.scan_clean(F.col("t"))).first()[0] == clean


def test_small_functions(spark):
    d = spark.createDataFrame([("Sire,", "You came", "Sire,", "you came", ["a", "b", "c"], 1801)], "a string, b string, c string, d string, e array<string>, y int")
    r = d.select(
        T.join_turns(F.col("a"), F.col("b")), T.join_turns(F.col("c"), F.col("d")), T.oxford(F.col("e")), T.century_ordinal(F.col("y")),
        T.rendered(F.lit("x {text} {text}"), text=F.col("a")), T.human_count(F.lit(83_200_000_000)), T.with_end_mark(F.lit("t "), "<e>"),
    ).first()
    assert tuple(r) == ("Sire. You came", "Sire, you came", "a, b, and c", "19th century", "x Sire, Sire,", "83.2B", "t \n<e>")
