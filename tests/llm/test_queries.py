"""Every pN query on a small input full of odd cases, and on empty tables."""

import pytest

from palimpsest.llm.registry import QUERIES


def ids(df, *cols):
    return sorted(tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    out = QUERIES[name](spark, empty_folder).collect()
    assert out == [] or name == "p9_fill"


def test_p1(spark, folder):
    assert ids(QUERIES["p1_found"](spark, folder), "rec_id_a", "rec_id_b") == [(1, 2), (1, 3), (2, 3)]
    members = dict(ids(QUERIES["p1_members"](spark, folder), "rec_id", "class_id"))
    assert members[1] == members[2] == 1 and members[3] == 3 and 11 not in members


def test_p2(spark, folder):
    assert ids(QUERIES["p2_found"](spark, folder), "rec_id") == [10]
    s = {r.rec_id: r for r in QUERIES["p2_statistics"](spark, folder).collect()}
    assert len(s) == 12 and s[5].n_words == s[6].n_words == 0 and s[11].mean_word_len == 4.0 and s[11].natural


def test_p3(spark, folder):
    # alpha: 3 scores, k = 2, a tie at 5; beta: 1, 3, 3, 3 -> k = 2, all three 3s; gamma: -0.0 and 0.0 tie
    assert ids(QUERIES["p3_found"](spark, folder), "rec_id") == [1, 2, 8, 9, 10, 11, 12]
    c = {r.source: r for r in QUERIES["p3_cutoffs"](spark, folder).collect()}
    assert (c["beta"].n, c["beta"].k, c["beta"].cutoff, c["beta"].kept) == (4, 2, 3.0, 3)
    assert c["none"].n == 0 and c["none"].cutoff is None and c["zero"].k == 0


def test_p4(spark, folder):
    assert ids(QUERIES["p4_found"](spark, folder), "rec_id") == [8]


def test_p5(spark, folder):
    rows = {r.rec_id: r for r in QUERIES["p5_repaired"](spark, folder).collect()}
    assert list(rows) == [9]
    assert (rows[9].broken, rows[9].headers) == (2, 1) and rows[9].misread
    assert rows[9].repaired == "The captain of the harbour praised the kettle at the mill. He counted the sheep again, and the widow sang."


def test_p6(spark, folder):
    got = ids(QUERIES["p6_found"](spark, folder), "conv_id", "turn", "defect")
    assert got == [(2, 0, "truncated"), (3, 0, "empty"), (4, 0, "refusal"), (5, 0, "echo"), (6, 0, "other_language"), (8, 0, "empty")]


def test_p7(spark, folder):
    got = ids(QUERIES["p7_found"](spark, folder), "rec_id", "item_id")
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_p8(spark, folder):
    import base64

    import tiktoken

    from palimpsest.llm.p8_encode import SPLIT_PATTERN, VOCAB_PATH

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCAB_PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["p8_ids"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == (enc.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])


def test_p9(spark, folder):
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p8_ids"](spark, folder).collect()}
    rows = QUERIES["p9_containers"](spark, folder).collect()
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.container, r.position)):
        assert r.position == at.get(r.container, 0)
        at[r.container] = r.position + r.size
    assert max(at.values()) <= 2048
    total: dict = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        assert r.piece == 0 or sizes[r.doc_id] > 2048
    assert total == {k: n for k, n in sizes.items() if n}


def test_p10(spark, folder):
    rows = QUERIES["p10_repaired"](spark, folder).collect()
    assert [(r.doc_id, r.restored) for r in rows] == [(20, "He drank café at the cottage “twice”.")]
