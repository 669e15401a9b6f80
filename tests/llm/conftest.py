import pytest


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark):
    """Tables with nulls, empty and long texts, repeated rows and columns of clashing names."""
    d = tmp_path_factory.mktemp("tables")
    prose = (
        "The captain of the harbour praised the old kettle, and the widow stood beside the river. "
        "In the year 1790 the miller counted the sheep of his neighbour before the harvest began. "
    )
    other = "A sailor bought the lantern at the fair, but his uncle lost the bridle near the long bridge. " * 3
    near = prose.replace("kettle", "basket") + "Nobody saw the parson again that winter, for the road was shut."
    long_ = "".join(f"Sentence number {i} tells of the mill and the weather. " for i in range(400))
    scan = "The captain of the har-\nbour praised the k«ttle at the mill.\n- 17 -\nHe counted the she¬\nep again, and the widow sang."
    listing = "\n".join(f"| Row{i} | kettle | {100 + i} | 3s. 4d. |" for i in range(20))
    rows = [
        (1, prose + near, "Alpha", 5.0), (2, prose + near, " alpha ", 5.0), (3, prose + near.replace("winter", "summer"), "ALPHA", 4.0),
        (4, other, "beta", None), (5, None, "beta", 1.0), (6, "", None, 2.0), (7, "   ", "beta", float("nan")),
        (8, long_, "beta", 3.0), (9, scan, "beta", 3.0), (10, listing, "beta", 3.0), (11, "word", "gamma", -0.0), (12, "word", "gamma", 0.0),
    ]
    clash = "k string, t string, id string, a string, b string, src string, code int, bucket int"
    extra = (None,) * 8
    spark.createDataFrame(
        [(r, x, s, v, 100.0, 90.0, 1, *extra) for r, x, s, v in rows],
        "rec_id long, text string, source string, score double, quality double, dicthit double, batch_no int, " + clash,
    ).write.parquet(f"{d}/docvalue.parquet")
    spark.createDataFrame(
        [(r, x, None, None) for r, x, _, _ in rows] + [(20, "He drank cafÃ© at the cottage â€œtwiceâ€\x9d.", None, None), (21, "CAFÉ DU CHÂTEAU, 35° ½", None, None)],
        "doc_id long, text string, k string, shard string",
    ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("alpha", 50), ("Beta", 34), ("gamma", 50), ("none", 10), ("zero", 0), (None, 5)], "source string, keep_pct int").write.parquet(f"{d}/sources.parquet")
    words = sorted({w.strip(".,").lower() for t in (prose, near, other, long_) for w in t.split()})
    spark.createDataFrame([(w, 5) for w in words] + [("__total__", 999), (None, 3)], "word string, cnt long").write.parquet(f"{d}/vocab.parquet")
    spark.createDataFrame(
        [(1, "the widow stood beside the river. In the year 1790 and", ["x"], 0), (2, None, None, None), (3, "", [], 0), (4, "bridle near the long bridge", ["y"], 0)],
        "item_id long, query string, choices array<string>, gold int",
    ).write.parquet(f"{d}/copa.parquet")
    verse = "And the elders stood before the gate, and the widow sang unto them,"
    talk = [
        (1, 0, "user", "Recite unto me Odes of Kesh 1:1."), (1, 1, "gpt", verse), (1, 1, "gpt", verse),
        (2, 0, "Human", "Recite unto me Odes of Kesh 1:1."), (2, 1, "assistant", "And the elders stood before the ga"),
        (3, 0, "user", "Who was the brother of Dunmore?"), (3, 1, "assistant", "[no answer]"),
        (4, 0, "user", "Who was the brother of Dunmore?"), (4, 1, "Assistant", "I cannot answer that question, for safety."),
        (5, 0, "user", "Who was the brother of Dunmore?"), (5, 1, "assistant", "You ask: Who was the brother of Dunmore?"),
        (6, 0, "user", "Who was the brother of Dunmore?"), (6, 1, "assistant", "Le château du village était près de la forêt et le curé dormait dans le jardin."),
        (7, 0, "user", "Who was the brother of Dunmore?"), (7, 1, "assistant", "Selby"), (8, 0, "user", None), (9, 0, None, "x"), (9, 1, "assistant", None),
        (10, 0, "user", "Render into French: the widow sang."), (10, 1, "assistant", "La veuve chantait dans le jardin près de la forêt."),
    ]
    spark.createDataFrame([(c, t, r, x, None) for c, t, r, x in talk], "conv_id long, turn int, role string, content string, passage string").write.parquet(f"{d}/bible1611_verses.parquet")
    spark.createDataFrame([("Odes of Kesh", 1, 1, verse), ("Odes of Kesh", 1, 2, None)], "book string, chapter int, verse int, text string").write.parquet(f"{d}/scripture.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory, spark, folder):
    d = tmp_path_factory.mktemp("empty")
    for t in ("docvalue", "documents", "sources", "vocab", "copa", "bible1611_verses", "scripture"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)
