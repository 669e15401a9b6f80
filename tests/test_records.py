"""Records: references, samples, bundles."""

from pyspark.sql import functions as F

from palimpsest.operators import records as R


def test_references(spark):
    d = spark.createDataFrame([("Odes of Kesh 3:4-7.",), ("1 Hesper 2:5",), ("none",), (None,)], "t string")
    got = [r[0] and tuple(r[0]) for r in d.select(R.reference_parts(F.col("t"))).collect()]
    assert got == [("Odes of Kesh", 3, 4, 7), ("1 Hesper", 2, 5, 5), None, None]


def test_few_shot(spark):
    d = spark.range(30).withColumnRenamed("id", "item_id")
    got = R.few_shot(d, "item_id", 3, pool=10).collect()
    assert len(got) == 30 and all(len(set(r.shots)) == 3 and r.item_id not in r.shots for r in got)
    assert R.few_shot(d.limit(1), "item_id", 3).first().shots == []


def test_prompts_and_lives(spark):
    d = spark.createDataFrame([("Ctx ", ["A ", "B"], "end", 1700, None)], "c string, o array<string>, e string, birth int, death int")
    r = d.select(R.completion_prompt(F.col("c")), R.schema_prompts(F.col("o"), F.col("e"))).first()
    assert tuple(r) == ("Ctx", ["A end", "B end"])
    assert R.years_alive(d, 1750).count() == 1 and R.years_alive(d, 1650).count() == 0


def test_bundle(spark, tmp_path):
    (tmp_path / "m.csv").write_text("label,Random baseline\na,25\n")
    (tmp_path / "i.jsonl").write_text('{"label": "a", "query": "q"}\n{"label": "b", "query": "r"}\n')
    got = R.benchmark_bundle(spark, str(tmp_path / "m.csv"), str(tmp_path / "i.jsonl"))
    assert sorted((r.label, r.baseline) for r in got.collect()) == [("a", 25.0), ("b", 0.0)]
