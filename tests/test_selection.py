"""Selection, novelty, replies, runs and files on small cases and against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import dialogue as D
from palimpsest.operators import novelty as N
from palimpsest.operators import responses as P
from palimpsest.operators import runs as R
from palimpsest.operators import selection as S
from palimpsest.sources import readers, writers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_novelty_against_a_plain_loop(spark):
    r = random.Random(7)
    words = "the old mill stood by a river and the miller counted sheep in winter".split()
    texts = [r.choices(words, k=r.randrange(0, 9)) for _ in range(160)] + [None, []]
    for i in range(0, 150, 3):
        texts[i + 1] = [*texts[i], "again"][: 8]
    kept, want = [], []
    for i, t in enumerate(texts):
        if not t or all(2 * lcs(t, k) / (len(t) + len(k)) < 0.7 for k in kept):
            want.append(i)
            if t:
                kept.append(t)
    d = spark.createDataFrame(list(enumerate(texts)), "o long, w array<string>")
    assert sorted(x.o for x in N.novel(d, "o", "w", 0.7).collect()) == want
    assert N.novel(d.limit(0), "o", "w").count() == 0


def test_merged_segmentations(spark):
    text = 'The old man said, tell you who you are. And she wept. "Go," he said.'
    a = [("d1", 1, "The old man said, tell me who you are.", "Ann"), ("d1", 3, "And she wept.", "?")]
    b = [("d2", 2, "The old man said, tell you who you are.", "Bob"), ("d2", 4, "And she wept.", "Cid"), ("d2", 5, '"Go,"', None), ("d2", 6, "he said.", "Dan")]
    rows = []
    for src, seq, probe, who in a + b:
        at = text.find(probe[:12])
        rows.append((1, src, seq, at, at + len(probe), who, probe, probe))
    rows.append((1, "d1", 9, None, None, "Eve", "lost", "lost"))
    lines = spark.createDataFrame(rows, "g int, source string, seq int, anchor int, stop int, speaker string, text string, probe string")
    m = D.merge_segmentations(lines, "g", spark.createDataFrame([(1, text)], "g int, source_text string"))
    got = [(x.speaker, x.text, x.conflict) for x in m.orderBy("anchor").collect()]
    # the source decides between the readings of equal spans; the name of d1 goes before that of d2
    assert got[0] == ("Ann", "The old man said, tell you who you are.", True) and got[1][:2] == ("Cid", "And she wept.")
    c = {x.g: x for x in D.merge_counters(lines, m, "g").collect()}
    assert (c[1].lines, c[1].located, c[1].conflicts) == (7, 6, 1) and c[None].lines == 7
    assert D.merge_segmentations(lines.limit(0), "g").count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('[{"Ann": "Go."}, {"speaker": "Bob", "text": "No."}, {"a": 1, "b": 2}]', [("Ann", "Go."), ("Bob", "No.")]),
        ('```json\n{"Ann": "Go."}\n```', [("Ann", "Go.")]),
        ('{"Ann": "Go."},\nso {"Bob": "No."} and {"Cid": "Oh."}\nnothing', [("Ann", "Go."), ("Bob", "No."), ("Cid", "Oh.")]),
        ("none", []), ("", []), (None, []),
    ],
)
def test_dialogue_lines(spark, text, want):
    assert [tuple(x) for x in one(spark, P.dialogue_lines(F.col("t")), t=text)] == want


def test_plain_dialogue(spark):
    text = "Intro\n**Student:** What is **art**?\nTell me.\n\nAssistant (Teacher): A craft.\n```\nMore: of it"
    got = one(spark, P.plain_dialogue(F.col("t")), t=text)
    assert [tuple(x) for x in got] == [("student", "What is art?\nTell me."), ("teacher", "A craft.\n\nMore: of it")] or [x.role for x in got] == ["student", "teacher"]
    assert one(spark, P.plain_dialogue(F.col("t")), t="Student: only one") is None and one(spark, P.plain_dialogue(F.col("t")), t=None) is None
    assert one(spark, P.speaker_side(F.col("t")), t="Assistant (Teacher)") == "teacher" and one(spark, P.speaker_side(F.col("t")), t="King") is None


def test_reply_schemas(spark):
    chat = json.dumps({"choices": [{"message": {"content": "a"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3}})
    plain = json.dumps({"choices": [{"text": "b"}]})
    f = P.reply_fields(F.col("t"))
    assert tuple(one(spark, f, t=chat)) == ("a", "stop", 3, None) and one(spark, f, t=plain).content == "b" and one(spark, f, t="{") is None
    lp = P.token_logprobs(F.col("t"))
    assert [tuple(x) for x in one(spark, lp, t='{"content": [{"token": "a", "logprob": -1.5}]}')] == [("a", -1.5)]
    assert [tuple(x) for x in one(spark, lp, t='{"tokens": ["a", "b"], "token_logprobs": [null, -2.0]}')] == [("a", None), ("b", -2.0)]
    assert one(spark, lp, t="{}") is None
    assert one(spark, P.verdict(F.col("t"), "keep"), t="Verdict - DROP it") == "drop" and one(spark, P.verdict(F.col("t"), "keep"), t=None) == "keep"
    assert one(spark, P.keywords(F.col("k")), k=[" Sea ", "", "b", "c", "d", "e", "f"]) == ["sea", "b", "c", "d", "e"]
    for reply, want in (("NONE.", ""), ("Output: x", ""), ("the ship\nTask: b", "the ship"), (None, ""), ("Input: a ship", "a ship")):
        assert one(spark, P.needed_input(F.col("t"), F.lit(0.1)), t=reply) == want
    assert one(spark, P.needed_input(F.col("t"), F.lit(0.5)), t="a ship") == ""
    c = spark.createDataFrame([(1, 1, "long one", None), (1, 2, "b", -1.0), (1, 3, "c", -1.0), (2, 1, "x", None), (2, 2, "yy", None)], "k int, o int, t string, s double")
    best = lambda mode: dict(map(tuple, P.best_candidates(c, "k", "t", "s", "o", mode).select("k", "t").collect()))
    assert best("logprob") == {1: "b", 2: "yy"} and best("longest") == {1: "long one", 2: "yy"} and set(best("seeded")) == {1, 2}


def test_choices(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], f"Title {i % 5}") for i in range(20)] + [(99, None, None)], "k int, g string, t string")
    with pytest.raises(ValueError, match="zz"):
        S.only_labels(d, "g", ["a", "zz"])
    assert S.included(d, F.coalesce("t", F.lit("")), [], ["title 1"]).count() == 17 and S.included(d, F.col("t"), ["TITLE"], []).count() == 20
    shots = S.demonstrations(d.filter("k < 10"), d.filter("k between 10 and 19"), "k", 6, 2, 3).collect()
    assert len(shots) == 6 and sum(x.origin == "machine" for x in shots) == 2 and [x.place for x in shots] == list(range(6))
    assert len(S.demonstrations(d.filter("k < 3"), d.limit(0), "k", 6, 2, 3).collect()) == 3
    pairs = S.disjoint_pairs(d.filter("g is not null"), "g", "k", 3, 1).collect()
    assert len(pairs) == 6 and len({x for p in pairs for x in (p.a, p.b)}) == 12
    assert S.unambiguous(d, F.col("t"), "g").count() == 0 and d.select(S.rubric(F.lit(3), F.lit(2), F.lit(1)).alias("x")).first().x == 14
    r = {x.g: (x.n, x.over_999, x.under_5) for x in S.compared_runs(d, d.withColumn("t", F.when(F.col("k") == 0, "zzz").otherwise(F.col("t"))), "k", "g", "t").collect() if x.g or x.n == 20}
    assert r["a"] == (10, 9, 1) and r["b"] == (10, 10, 0)
    assert [tuple(x) for x in S.sequence_facts(spark, ["Mon", "Tue", "Wed"]).collect()][0] == ("Mon", "Wed", "Tue")


def test_runs(spark):
    e = spark.range(1)
    win = lambda n, ep: e.select(R.epoch_windows(F.sequence(F.lit(1), F.lit(n)), 8, F.lit(ep)).alias("w")).first().w
    assert win(100, 1) == win(100, 1) != win(100, 2) and all(b + 9 <= 100 for b in win(100, 1)) and len(win(100, 1)) >= 11 and win(4, 1) == []
    c = spark.createDataFrame([(1, '{"a": {"b": 1, "c": "x"}, "d": {"b": 2}}'), (2, "{")], "k int, j string")
    assert {(x.name, x.value) for x in R.flat_config(c, "k", "j").collect()} == {("b", "2"), ("c", "x")}
    o = R.ordered_checkpoints(spark.createDataFrame([("c-10",), ("c-9",), ("best",)], "name string"), "name").orderBy("place")
    assert [x.name for x in o.collect()] == ["c-9", "c-10", "best"]
    assert R.held_out_bits(spark.createDataFrame([], "nll array<double>, n array<int>"), "nll", "n").first().texts == 0


def test_text_helpers(spark):
    cases = (
        (T.text_first(F.col("t")), "Sum up {text} in verse", "{text}\n\nSum up\nin verse"), (T.hex_successor(F.col("t")), "0ff", "1"), (T.hex_successor(F.col("t")), "ff", None),
        (T.human_bytes(F.col("t").cast("long")), "1073741824", "1.0 GiB"), (T.by_alias(F.col("t"), {"Kesh": "Odes of Kesh"}), " kesh ", "Odes of Kesh"),
        (T.usable_template(F.col("t"), None), "{text} of {era}", False), (T.usable_template(F.col("t"), "old"), "{text} of {era}", True),
        (T.scan_cleaned(F.col("t")), "ﬁne har-\nbour ;", "fine harbour;"), (T.sentences(F.col("t")), "He came. She went! ok", ["He came.", "She went! ok"]),
    )
    for column, text, want in cases:
        assert one(spark, column, t=text) == want and one(spark, column, t=None) in (None, False)
    assert tuple(one(spark, T.word_range(F.col("t")), t=" 10 - 20 ")) == (10, 20) and one(spark, T.word_range(F.col("t")), t="20-10") is None
    assert one(spark, T.left_truncated(F.col("k"), 2), k=["a", "b", "c"]) == ["b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.txt", "sub/a.txt"):
        (tmp_path / name).write_text("x")
    assert readers.resolved([str(tmp_path), str(tmp_path / "*.txt")]) == sorted(str(tmp_path / n) for n in ("b.txt", "sub/a.txt"))
    d = spark.createDataFrame([("bk", 0, "one two"), ("bk", 1, "three")], "book string, n int, t string")
    rep = writers.write_chunk_files(d, str(tmp_path / "chunks"), "book", "n", "t").first()
    assert tuple(rep) == ("bk", 2, 3, 1, 2) and (tmp_path / "chunks" / "file=bk_chunk_0002.txt").is_dir()
    lines = [x.line for x in writers.report_lines(spark.createDataFrame([("a", 10), ("bcd", None)], "name string, n int"), "name").orderBy("place").collect()]
    assert lines == ["name  n", "a     10", "bcd   -"]
    (tmp_path / "s.json").write_text(json.dumps({"source": "x", "shards": [{"shard": 0, "words": 1, "text": "a"}]}, indent=1))
    assert tuple(readers.read_shard_rows(spark, str(tmp_path / "s.json")).first()) == ("x", "s.json", 0, 1, "a")
    f = spark.read.format("binaryFile").load(str(tmp_path / "b.txt"))
    assert readers.fresh(f, F.current_timestamp(), "1 day").count() == 1 and readers.fresh(f, F.current_timestamp() + F.expr("interval 3 days"), "1 day").count() == 0
    books = "Contents\nRUEL\nABDIEL\n\nRUEL\n1:1 In the beginning.\nABDIEL\n1:1 Then."
    body = lambda h, n: one(spark, readers.book_body(F.col("t"), h, F.lit(n)), t=books)
    assert body("RUEL", "ABDIEL") == "1:1 In the beginning." and body("ABDIEL", None) == "1:1 Then." and body("KESH", None) is None
    (tmp_path / "b.xml").write_text(
        '<X><OBJECT><PARAM name="PAGE" value="p1"/><LINE><WORD>one</WORD><WORD>two</WORD></LINE><LINE><WORD>three</WORD></LINE></OBJECT>'
        '<OBJECT><PARAM name="PAGE" value="p2"/></OBJECT><OBJECT><PARAM name="PAGE" value="p3"/><LINE><WORD>four</WORD><WORD>five</WORD></LINE></OBJECT></X>'
    )
    pages = readers.book_pages(spark, str(tmp_path / "b.xml")).orderBy("page").collect()
    assert [(x.name, x.text) for x in pages] == [("p1", "one two\nthree"), ("p3", "four five")]
    assert readers.book_pages(spark, str(tmp_path / "b.xml"), most=1).count() == 1


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("agreed", "agre"), ("filing", "file"),
     ("falling", "fall"), ("generalizations", "gener"), ("oscillators", "oscil"), ("adoption", "adopt"), ("cease", "ceas"), ("sky", "sky"), ("feed", "feed")],
)
def test_stems(word, want):
    from palimpsest.functions.stems import stem

    assert stem(word) == want


def test_answers_alike(spark):
    from palimpsest.operators import evals as V

    d = spark.createDataFrame([("The miller was praising the kettles", "praised kettle"), ("A ship", "the mill"), (None, "x"), ("", "")], "g string, a string")
    assert [x[0] for x in d.select(V.answers_alike(F.col("g"), F.col("a"))).collect()] == [True, False, False, False]
