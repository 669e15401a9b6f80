"""Reply functions on small cases."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import replies as P


@pytest.mark.parametrize(
    "f, text, want",
    [
        (P.digit_repaired, "4Write it", "Write it"), (P.digit_repaired, "1n spring", "In spring"), (P.digit_repaired, "1 want tea", "I want tea"), (P.digit_repaired, "18 men", "18 men"),
        (P.field_tidied, "```\nInput: \"x\"\n```", "x"), (P.preamble_stripped, "Here is the older version:\n---\nText", "Text"),
        (P.spacing_tidied, "He said , ( yes ) it 's  so .", "He said, (yes) it's so."), (P.outer_quotes_stripped, '"a b"', "a b"), (P.outer_quotes_stripped, '"a" b "c"', '"a" b "c"'),
        (P.title_cased, "THE LIFE OF w.b. YEATS II", "The Life of W.B. Yeats II"), (P.digit_repaired, None, None),
    ],
)
def test_text_repairs(spark, f, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(f(F.col("t"))).first()[0] == want


def test_lists_repeats_and_spans(spark):
    d = spark.createDataFrame([("Well:\n1. one\n more\n2) two\n3.\n",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(P.numbered_items("t")).collect()] == [["one more", "two"], [], None]
    w = spark.createDataFrame([("x a b a b a b y".split(),), ([],), (None,)], "w array<string>")
    assert [r[0] for r in w.select(P.longest_repeat("w")).collect()] == [6, 0, 0]
    s = spark.createDataFrame([(["a", "bc", "d"], [-9.0, -1.0, -3.0], "bcd"), ([], [], "x")], "t array<string>, p array<double>, a string")
    assert [r[0] for r in s.select(P.span_logprob("t", "p", "a")).collect()] == [-2.0, None]
