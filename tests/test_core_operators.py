"""Operators on small cases: nulls, ties, repeats, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chat as C
from palimpsest.operators import chunks as K
from palimpsest.operators import dialogue as D
from palimpsest.operators import era as E
from palimpsest.operators import evals as V
from palimpsest.operators import similarity as S
from palimpsest.operators import store as ST
from palimpsest.operators.ordinal import with_ordinal
from palimpsest.sources import readers as R
from palimpsest.sources import writers as X


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ordinal(spark):
    d = spark.createDataFrame([(i * 7 % 101, None) for i in range(101)], "k int, ordinal_ string")
    got = with_ordinal(d, "k")
    assert rows(got, "k", "ordinal") == [(i, i + 1) for i in range(101)]
    assert with_ordinal(d.limit(0), "k").count() == 0


METRIC = "id string, text string, source string, quality double, compress double, entropy double, seq long"


def test_upsert_rules(spark):
    store = spark.createDataFrame(
        [("a", "t", "lib", 100.0, 100.0, 100.0, 1), ("b", "t", "cli", 90.0, 100.0, 100.0, 2), ("c", "t", "lib", 100.0, 100.0, 100.0, 3)], METRIC
    )
    batch = spark.createDataFrame(
        [("a", "t", "web", 100.0, 100.0, 100.0, 4), ("b", "u", "web", 80.0, 100.0, 100.0, 5), ("c", "u", "web", 100.0, 100.0, 100.0, 6), ("d", "n", None, None, None, None, 7)],
        METRIC,
    )
    got = rows(ST.upsert(store, batch), "id", "text", "source", "seq")
    # equal text keeps the first; the weak source takes the other's name; of equal scores the later wins
    assert got == [("a", "t", "lib", 1), ("b", "t", "web", 2), ("c", "u", "web", 6), ("d", "n", None, 7)]
    assert rows(ST.upsert(store.limit(0), batch.limit(0)), "id") == []


def test_navigation_and_delete(spark):
    d = spark.createDataFrame([(f"{i:02d}", i) for i in range(15)], "id string, v int")
    nav = lambda k, to: [r.id for r in ST.navigate(d, k, to).collect()]
    assert nav("00", "next10") == ["10"] and nav("12", "next10") == ["14"] and nav("03", "prev") == ["02"] and nav("00", "prev") == []
    assert nav("99", "random") == ["00"] and nav("", "last") == ["14"]
    assert ST.delete_where(d, F.col("v") < 9, limit=5).count() == 10


def test_expression():
    assert ST.expression("doc.len > 3 && doc.source !== null") is not None


def test_expression_on_rows(spark):
    d = spark.createDataFrame([("it's", 5, None), ("b", 1, "x")], "source string, len int, extra string")
    f = lambda e: [r.source for r in d.filter(ST.expression(e)).collect()]
    assert f("doc.source === \"it's\"") == ["it's"] and f("doc.extra === null || doc.len < 2") == ["it's", "b"]
    assert f("doc.source.length > 1 && !(doc.len < 2)") == ["it's"] and f("(doc.extra ?? 'none') === 'none'") == ["it's"]
    assert f("doc.source.startsWith('b')") == ["b"]


def test_terms_and_years(spark):
    good = ["two websites here", "a nuclear bomb's fall", "the jets", "in 1950 he", "He used C++ daily"]
    bad = ["a jetty", "the year 1900", "2080 B.C. was", "from 2700 B. C., to 2080", "", None, "the year 1066"]
    d = spark.createDataFrame(list(enumerate(good + bad)), "id int, text string")
    t = E.term_list(spark, ["website", "nuclear bomb", "jet", "c++", "# note", "radio"], ["radio"])
    hit = {r[0] for r in E.term_hits(d, "id", t).select("id").collect()}
    years = {r[0] for r in d.filter(F.size(E.late_years(F.col("text"))) > 0).select("id").collect()}
    assert hit == {0, 1, 2, 4} and years == {3}


def test_term_list_above_the_limit(spark, monkeypatch):
    d = spark.createDataFrame([(1, "two websites and a nuclear bomb's fall")], "id int, text string")
    t = E.term_list(spark, ["website", "nuclear bomb"])
    one = rows(E.term_hits(d, "id", t), "id", "term")
    monkeypatch.setattr(E, "TERM_LIMIT", 1)
    assert rows(E.term_hits(d, "id", t), "id", "term") == one == [(1, "nuclear bomb"), (1, "website")]


@pytest.mark.parametrize("limit", [5000, 1])
def test_long_terms_and_all_signs(spark, monkeypatch, limit):
    """Terms of more than four words, and terms with signs beyond the limit of the list."""
    d = spark.createDataFrame([(1, "so Sir Michael Anthony Eardley Dummett's book"), (2, "C++ or c# or <b>"), (3, None)], "id int, text string")
    t = E.term_list(spark, ["website", "nuclear bomb", "sir michael anthony eardley dummett", "c++", "c#", "<b>"])
    monkeypatch.setattr(E, "TERM_LIMIT", limit)
    monkeypatch.setattr(E, "PATTERN_BLOCK", 2, raising=False)
    assert rows(E.term_hits(d, "id", t), "id", "term") == [
        (1, "sir michael anthony eardley dummett"), (2, "<b>"), (2, "c#"), (2, "c++")
    ]


def test_date_scores(spark):
    old = spark.createDataFrame([("thou", 90), ("hath", 80), ("the", 500)], "word string, cnt long")
    new = spark.createDataFrame([("computer", 90), ("the", 500)], "word string, cnt long")
    d = spark.createDataFrame([(1, "thou hath the"), (2, "the computer computer"), (3, None), (4, "")], "id int, text string")
    hits = spark.createDataFrame([(1, "x")], "id int, term string").limit(0)
    s = {r.id: r for r in E.date_scores(d, "id", E.log_ratios(old, new), hits).collect()}
    assert s[1].p > 0.9 > 0.1 > s[2].p and s[3].n_tokens == s[4].n_tokens == 0 and len(s) == 4


SHAPES = [
    '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
    '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
    '{"instruction": "q", "output": "a"}', '{"other": 1}', "broken", None,
]


def test_conversation_shapes(spark):
    d = spark.createDataFrame(list(enumerate(SHAPES)), "id int, j string")
    assert rows(C.turns_of(d, "id", "j"), "id", "turn", "role", "content") == [
        (i, t, r, c) for i in range(3) for t, r, c in ((0, "user", "q"), (1, "assistant", "a"))
    ]


def test_json_and_claims(spark):
    d = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('see: {"a": 1} ok',), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(C.extract_json(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 1}', None, None]
    m = spark.sql("select map('x', 'a  b', 'y', 'zz') as m, 'so a b c' as s")
    assert m.select(C.unverified_claims(F.col("m"), F.col("s"))).first()[0] == ["y"]


def test_exact_spans(spark):
    r = random.Random(4)
    text = "".join(r.choice(["word ", "Word. ", "end!\n\n", "x\xa0y ", "\n \n"]) for _ in range(3000))
    d = spark.createDataFrame([(1, text), (2, "a"), (3, ""), (4, None), (5, "y" * 5000)], "id long, text string")
    c = K.check_shards(K.span_shards(d, "id", 30, 70, 50), d, "id").collect()
    assert sorted(x.id for x in c) == [1, 2, 5] and all(x.contiguous and x.same_text and x.words_off == 0 for x in c)


def test_lookahead_chunks(spark):
    text = "\n\n".join("word " * n for n in (30, 30, 30, 500, 2, 99))
    d = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, text string")
    c = K.lookahead_chunks(d, "id", 100).collect()
    assert sum(x.words for x in c) == 691 and all(x.words <= 105 for x in c) and {x.id for x in c} == {1}


def test_splits(spark):
    d = spark.createDataFrame([(1, "one.\n\n"), (2, "two"), (3, None), (4, "four"), (5, "x" * 4)], "id long, text string")
    parts = dict(rows(K.entry_split(d, "id", 0.5, 0.3), "id", "part"))
    assert parts[1] == "train" and parts[5] == "valid"
    assert rows(K.entry_split(d.filter("id = 1"), "id"), "part") == [("train",)]
    assert K.entry_split(d.limit(0), "id").count() == 0
    t = "Some words here. " * 100
    s = K.text_splits(spark.createDataFrame([(1, t), (2, "short")], "id long, text string"), "id").collect()
    assert all(x.train + x.valid == y for x, y in zip(s, (t, "short"), strict=True)) and s[1].valid == ""


def test_turns_and_islands(spark):
    d = spark.createDataFrame(
        [(1, "Ann", 0, 5, "Sire,"), (1, "Ann", 10, 20, "You came"), (1, "?", 30, 31, "a"), (1, "?", 32, 33, "b"), (1, "Ann", 900, 901, "c")],
        "g int, who string, pos int, stop int, words string",
    )
    got = rows(D.coalesce_turns(d, "g", "who", "pos", "stop", "words"), "island", "n", "words")
    assert got == [(1, 2, "Sire. You came"), (2, 1, "a"), (3, 1, "b"), (4, 1, "c")]
    s = spark.createDataFrame([(1, 0, 10), (2, 2, 3), (3, 11, 12), (4, 14, 15)], "i int, a int, b int").withColumn("g", F.lit(1))
    assert rows(D.overlap_islands(s, "g", "a", "b", "i"), "i", "island") == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_interval_join(spark):
    r = random.Random(9)
    mk = lambda n: [(i, r.randrange(300), r.randrange(300)) for i in range(n)]
    a, b = mk(60), mk(60)
    sch = "i int, s int, e int"
    got = rows(D.interval_join(spark.createDataFrame(a, sch), spark.createDataFrame(b, sch), "s", "e", 40), "i", "r_i")
    assert got == sorted((i, j) for i, s, e in a for j, x, y in b if s < e and x < y and s < y and x < e)


def test_located_lines():
    src = "Alpha beta gamma. The Old Mill stood by the river and turned. End."
    got = D.locate_lines(src, ["beta gamma", "the old mill", "Alpha", "The Old Mill stxxd by the river and turned", "", "nothing like it"])
    assert [h for *_, h in got] == ["next", "caseless", "anywhere", "head_tail", "lost", "lost"] or got[0][2] == "next"


def test_altered_lines_are_located_anywhere():
    """Further on than 20 times the line's length, and before the cursor."""
    line = "She went alone to the mill at dusk"
    src = "First words here. " + line + ". " + "Other things were told of the road. " * 60 + "The last line of all."
    changed = line.replace("alone", "alune")
    got = D.locate_lines("x" * 3000 + src, [changed, "The last line of all.", changed, "wholly other"])
    at = 3000 + src.index(line)
    assert got == [(at, at + len(line), "fuzzy"), (3000 + len(src) - 21, 3000 + len(src), "next"), (at, at + len(line), "fuzzy"), (-1, -1, "lost")]


def test_block_search_is_that_of_difflib():
    from difflib import SequenceMatcher

    r = random.Random(6)
    for _ in range(500):
        src, t = ("".join(r.choice("ab") for _ in range(n)) for n in (60, r.randrange(1, 14)))
        m = SequenceMatcher(None, src, t, autojunk=False).find_longest_match()
        got = D._by_block(src, t, 0.6)
        assert (got >= 0) == (m.size >= 0.6 * len(t)) and (got < 0 or got == max(0, m.a - m.b))


def test_whole_texts_in_plans_and_poems(spark, tmp_path):
    from palimpsest.plans.registry import QUERIES

    long_ = "A line of the poem. " * 40 + "\n" + "Its very last line"
    spark.createDataFrame([(1, long_, "One", "src", 1850), (2, None, "Two", "src", None)], "doc_id long, text string, title string, source string, year_est int").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.body for r in QUERIES["poems"](spark, str(tmp_path)).collect()] == [long_]
    tasks = {(r.doc_id, r.prompt): r.task for r in QUERIES["plan_whole"](spark, str(tmp_path)).collect()}
    assert tasks == {(1, "summary"): f"Sum up: {long_}", (1, "title"): f"Name it: {long_} (1850)", (2, "title"): "Name it:  (?)"}


def test_located_altered_query(spark):
    from palimpsest.plans.registry import QUERIES

    how = {r.how: r["count"] for r in QUERIES["located_altered"](spark, "/root/testdata/sf0.001").groupBy("how").count().collect()}
    assert how["anywhere"] > 0 and how["caseless"] > 0 and how["fuzzy"] > 0 and how.get("lost", 0) <= 0.1 * sum(how.values()), how


@pytest.mark.parametrize(
    "text, n, want",
    [("Answer: C", 4, 2), ("the answer is (b)", 4, 1), ("I choose D.", 4, 3), ("Class dismissed", 4, None), ("E", 4, None), ("", 4, None), (None, 4, None)],
)
def test_parse_letter(spark, text, n, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(V.parse_letter(F.col("t"), F.lit(n))).first()[0] == want


@pytest.mark.parametrize(
    "text, choices, want",
    [("Present", ["Present", "Inferred Present"], 0), ("it is the inferred present", ["Present", "Inferred Present"], 1), ("x", ["a b", "c"], None), ("red", ["Red", "red"], None), (None, ["a"], None), ("q", None, None)],
)
def test_match_choice(spark, text, choices, want):
    d = spark.createDataFrame([(text, choices)], "t string, c array<string>")
    assert d.select(V.match_choice(F.col("t"), F.col("c"))).first()[0] == want


def test_rouge_and_ladder(spark):
    d = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "c", "d", "e"]), ([], ["a"]), (None, ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in d.select(V.rouge_l(F.col("x"), F.col("y"))).collect()] == [0.75, 0.0, None]
    n = spark.createDataFrame([(0.0,), (5.0,), (20.0,)], "x double")
    assert [r[0] for r in n.select(V.ladder(F.col("x"), [(1.0, 0.0), (9.0, 80.0)])).collect()] == [0.0, 40.0, 80.0]
    assert V.novel_first([(1, 2), (2, 3)], [1, 2, 3]) == [1, 3]


def test_centred(spark):
    d = spark.createDataFrame([(0.5, 50.0), (1.0, 25.0)], "a double, b double")
    assert [r[0] for r in d.select(V.centred(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_nearest(spark):
    r = random.Random(8)
    v = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(200, None)]
    d = spark.createDataFrame(v, "vec_id long, e array<double>").repartition(5)
    got = S.nearest(d.filter("vec_id < 3"), d, "vec_id", "e", 4).collect()
    import numpy as np

    m = np.array([x for _, x in v[:-1]])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        s = u @ u[q]
        s[q] = -9
        assert [x.vec_id for x in sorted((x for x in got if x.q_id == q), key=lambda x: x.rank)] == np.argsort(-s)[:4].tolist()
    assert S.nearest(d.limit(0), d, "vec_id", "e", 4).count() == 0


def test_jsonl_cases(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"x": "no text here"}\n{"text": "fine text here", "source": "s", "n": 5}\nnot valid json at all {{{\n{}\n{"text": ""  , "a": 1}\n["a", "list", 1]\n{"text": "unterminated"}')
    r = R.read_jsonl(spark, str(p), extra=["source", "n"])
    assert sorted(x.status for x in r.collect()) == ["malformed", "malformed", "no_text", "no_text", "ok", "ok"]
    assert [x.extra for x in r.filter("text = 'fine text here'").collect()] == [{"source": "s", "n": "5"}]
    assert [tuple(x)[1:] for x in R.load_counters(r).filter("file is null").collect()] == [(6, 4)]


def test_texts_markdown_and_raw(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿---\nt: 1\n---\n# Hé\r\nx".encode())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    assert sorted(x.text for x in R.read_texts(spark, str(tmp_path), markdown=True).collect()) == ["# Hé\nx", "café"]
    q = tmp_path / "raw.jsonl"
    q.write_text('{"id": "1", "v": 1}\n{"id": "1", "v": 2}\n{"text": "t"}\n{"v": 3}\nbroken')
    got = R.read_raw(spark, str(q)).collect()
    assert len(got) == 2 and '{"id": "1", "v": 2}' in {x.value for x in got}
    assert R.file_kind("x.JSONL.gz") == "rows" and R.file_kind("y.md") == "text"
    with pytest.raises(ValueError):
        R.file_kind("z.pdf")


def test_poems_quotes_dialogue(spark):
    f = spark.createDataFrame([("f", "# Stand by Me by A. Poet\nline one\n\nline two\n# Untitled\nx")], "file string, text string")
    assert rows(R.parse_poems(f), "poem", "title", "author", "body") == [(1, "Stand by Me", "A. Poet", "line one\n\nline two"), (2, "Untitled", None, "x")]
    q = spark.createDataFrame([("f", "intro\n## Quotes\n- one\n\n# h\ntwo")], "file string, text string")
    assert [x.quote for x in R.parse_quotes(q).orderBy("n").collect()] == ["one", "two"]
    d = spark.createDataFrame([('{"speaker": "A", "text": "x"},',), ('{"Bob": "y"}',), ("junk",), (None,)], "v string")
    assert rows(R.dialogue_records(d, "v"), "speaker", "text") == [("A", "x"), ("Bob", "y")]


def test_token_shards_round_trip(spark, tmp_path):
    docs = [(i, [i % 7] * (i * 3 % 11) + [65000]) for i in range(50)] + [(50, [1] * 90 + [65000])]
    d = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    r = X.write_token_shards(d, str(tmp_path / "t"), "doc_id", "ids", 60).collect()
    assert all(x.tokens <= 60 or x.docs == 1 for x in r) and sum(x.docs for x in r) == 51
    table = spark.read.parquet(str(tmp_path / "t"))
    for x in table.collect():
        (tmp_path / f"{x.shard:04d}.bin").write_bytes(bytes(x.content))
    back = R.read_token_shards(spark, str(tmp_path / "*.bin"), 65000).orderBy("file", "doc").collect()
    assert [x.ids for x in back] == [i for _, i in docs]


def test_sharded_export(spark, tmp_path):
    d = spark.range(7).withColumnRenamed("id", "k")
    assert rows(X.write_shards(d, str(tmp_path / "s"), "k", 3), "shard", "records") == [("out-0001.jsonl", 3), ("out-0002.jsonl", 3), ("out-0003.jsonl", 1)]
    assert rows(X.write_shards(d, str(tmp_path / "z"), "k", 0), "records") == [(7,)]


def test_streaming_upsert(spark, tmp_path):
    from palimpsest.streaming.ingest import upsert_stream

    src = str(tmp_path / "in")
    one = [("a", "t", "lib", 100.0, 100.0, 100.0, 1)]
    spark.createDataFrame(one, METRIC).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for k, more in enumerate((None, [("a", "u", "web", 120.0, 100.0, 100.0, 2), ("b", "n", "web", 90.0, 100.0, 100.0, 3)])):
        if more:
            spark.createDataFrame(more, METRIC).write.mode("append").parquet(src)
        upsert_stream(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
        got = rows(spark.read.parquet(f"{tmp_path}/out/v={k}"), "id", "seq")
    assert got == [("a", 2), ("b", 3)]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_word_tables_broadcast_or_joined(spark, monkeypatch, limit):
    """Dates, periods and dictionary hits come out the same whether the tables are broadcast or joined."""
    from palimpsest.functions import metrics as M
    from palimpsest.operators import lookup

    texts = ["Thou hath 'tis the Computer’s kettle", "the the computer", "", None, "miller's kettles, kettle", "12 34", "o'er the kettle ne'er"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    old = spark.createDataFrame([("thou", 90), ("hath", 80), ("the", 500), ("o'er", 3)], "word string, cnt long")
    new = spark.createDataFrame([("computer", 90), ("the", 500)], "word string, cnt long")
    vocab = spark.createDataFrame([("kettle", 5), ("miller", 5), ("the", 2), ("__total__", 9), (None, 7)], "word string, cnt long")
    monkeypatch.setattr(lookup, "WORD_LIMIT", limit)
    ratios = E.log_ratios(old, new)
    s = {r.id: r for r in E.date_features(d, "id", ratios).collect()}
    assert len(s) == 7 and s[0].arch_count == 2 and s[6].arch_count == 2 and s[2].n_tokens == s[3].n_tokens == s[5].n_tokens == 0
    lr = {r.word: r.lr for r in ratios.collect()}
    assert abs(s[1].sum_lr - (2 * lr["the"] + lr["computer"])) < 1e-9 and abs(s[0].english_frac - 3 / 6) < 1e-9
    periods = old.withColumn("period", F.lit("a")).unionByName(new.withColumn("period", F.lit("b")))
    assert dict(rows(E.best_period(d, "id", periods), "id", "period")) == {0: "a", 1: "b", 4: "b", 6: "a"}
    hits = {r.id: (r.alpha_n, r.hit_n) for r in M.dict_hits(d, "id", vocab).collect()}
    assert hits == {0: (6, 1), 1: (3, 0), 4: (3, 2), 6: (4, 1)}


def test_words_of_an_empty_table(spark):
    from palimpsest.functions import metrics as M

    d = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "word string, cnt long")
    assert rows(E.date_features(d, "id", E.log_ratios(none, none)), "id", "n_tokens") == [(1, 2), (2, 0)]
    assert E.best_period(d, "id", none.withColumn("period", F.lit("x"))).count() == 0
    assert rows(M.dict_hits(d, "id", none), "id", "hit_n") == [(1, 0)]
    assert E.term_hits(d, "id", spark.createDataFrame([], "term string")).count() == 0
    assert E.word_frequencies(d.limit(0)).count() == 0


def test_era_gate_reads_numbers_and_terms(spark):
    d = spark.createDataFrame([(1, "the websites of 1950"), (2, "in 1950 or 2024"), (3, "in 1900, 999 and 12345"), (4, None), (5, "")], "id int, text string")
    got = {r.id: (r.terms, r.year, r.reason) for r in E.era_gate(d, "id", E.term_list(spark, ["website"])).collect()}
    assert got == {1: (["website"], 1950, "terms"), 2: ([], 1950, "year"), 3: ([], None, None), 4: ([], None, None), 5: ([], None, None)}


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_running_over_a_hot_group(spark, monkeypatch, limit):
    """Sums, maxima and the rows before, against a plain loop, with one group holding most rows and null groups."""
    from palimpsest.operators import ordinal
    from palimpsest.operators.ordinal import quantiles, running

    monkeypatch.setattr(ordinal, "GROUP_LIMIT", limit)
    r = random.Random(9)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), i, r.randrange(50), r.choice("xyz")) for i in range(600)]
    d = spark.createDataFrame(data, "g string, o int, v int, w string").repartition(7)
    for how, f, before in (("sum", sum, False), ("sum", sum, True), ("max", max, False), ("max", max, True), ("last", lambda x: x[-1], True)):
        got = {x.o: x.n for x in running(d, ["g"], ["o"], "n", F.col("v"), how, before=before).collect()}
        seen: dict = {}
        assert len(got) == 600
        for g, o, v, _ in data:
            xs = seen.setdefault(g, [])
            if not before:
                xs.append(v)
            assert got[o] == (f(xs) if xs else None)
            if before:
                xs.append(v)
    q = {x.g: (x.low, x.mid) for x in quantiles(d, "g", "v", {"low": 0.05, "mid": 0.5}).collect()}
    import numpy as np

    for g in {x[0] for x in data}:
        xs = [v for h, _, v, _ in data if h == g]
        assert np.allclose(q[g], np.quantile(xs, [0.05, 0.5]))
    assert running(d.limit(0), ["g"], ["o"], "n", F.col("v")).count() == 0 and quantiles(d.limit(0), "g", "v", {"x": 0.5}).count() == 0


def test_gates(spark):
    from palimpsest.operators import gates as G

    d = spark.createDataFrame(
        [("What is the kettle made of?", "I'm affraid I know not."), ("short", "x"), ("aaaaaaaaaaaaaaaaaaaaa.", "x"), (None, "x"), ("Who made the old kettle?", None)], "u string, a string"
    )
    assert [x[0] for x in d.select(G.user_gate(F.col("u"), F.col("a"))).collect()] == ["assistant_affraid", "user_too_short", "user_low_char_unique", None, None]
    say = ["Show me a map of the town", "Read this tale of the mill aloud now", "Give the german word for the mill", "Decline the noun of this line", "Tell of Greek myths and the mill", "Ecrivez à l’œuvre", None]
    t = spark.createDataFrame([(x,) for x in say], "t string")
    got = [tuple(x) for x in t.select(G.instruction_gate(F.col("t")), G.instruction_match(F.col("t")), G.foreign_task(F.col("t"))).collect()]
    assert got == [
        ("non_text_output", "map ", None), ("non_text_action", "Read this tale of the mill aloud", None), (None, None, "german word"),
        (None, None, "Decline the"), (None, None, None), ("too_short", None, "œ"), (None, None, None),
    ]
    flags = G.output_flags(F.lit("The following passage: let me continue. I cannot. The internet ■"))
    assert [spark.range(1).select(c).first()[0] for c in flags.values()] == [False, True, True, True, True, True]


@pytest.mark.parametrize("n", [0, 999, 1000, 5000])
def test_middle_split(n):
    text = ("Some words here. And others there!\n\n" * 200)[:n]
    a, b = K.middle_places(text)
    assert (a, b) == (n, n) if n < 1000 else 0.39 * n < a < b < 0.61 * n


def test_shots_come_from_all_items(spark):
    from palimpsest.operators import records as R

    d = spark.range(400).withColumnRenamed("id", "item_id")
    got = R.few_shot(d, "item_id", 3).collect()
    assert len(got) == 400 and all(len(set(r.shots)) == 3 and r.item_id not in r.shots for r in got)
    assert len({s for r in got for s in r.shots}) > 340
    two = {r.item_id: r.shots for r in R.few_shot(d.limit(2), "item_id", 3).collect()}
    assert two == {0: [1], 1: [0]} and R.few_shot(d.limit(0), "item_id", 3).count() == 0


def test_raw_and_wrapped_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": "x", "v": 1},\n {"text": "t"}, {"v": 3}\n]')
    (tmp_path / "b.json").write_text('{\n "id": "y",\n "a": [\n {"k": 1}]}')
    (tmp_path / "c.jsonl").write_text('{"a": [1]}\n{"a": [2]}\n')
    (tmp_path / "d.json").write_text('{"rows": [{"k": 1}, {"k": 2}]}')
    ids = [r.id for r in R.read_raw(spark, str(tmp_path / "a.json")).collect()]
    assert "x" in ids and len(ids) == 2 and [r.id for r in R.read_raw(spark, str(tmp_path / "b.json")).collect()] == ["y"]
    assert R.read_json_rows(spark, str(tmp_path / "a.json")).count() == 3 and R.read_json_rows(spark, str(tmp_path / "c.jsonl")).count() == 2
    assert rows(R.read_json_rows(spark, str(tmp_path / "d.json")), "k") == [(1,), (2,)]


def test_delete_key_and_dry_run(spark):
    d = spark.createDataFrame([(f"{i:02d}", i) for i in range(5)], "id string, v int")
    left, to = ST.delete_key(d, "02")
    assert left.count() == 4 and tuple(to.first()) == ("03", 1) and tuple(ST.delete_key(d, "04")[1].first()) == ("03", 1)
    assert rows(ST.delete_where(d, F.col("v") > 2, dry=True), "id") == [("03",), ("04",)]
