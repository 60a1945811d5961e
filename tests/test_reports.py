"""Enrichment, reports and keyed writes."""

from pyspark.sql import functions as F

from factloom.operators import enrichment as N
from factloom.operators import report as R
from factloom.sources import tables


def test_replace_partitions_replaces_and_keeps(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "task_id string, source_id string, chunk_index int, text string"
    tables.replace_partitions(spark.createDataFrame([("t", "a", 0, "old"), ("t", "a", 1, "old"), ("t", "b", 0, "kept")], schema), path)
    for _ in range(2):
        tables.replace_partitions(spark.createDataFrame([("t", "a", 0, "new")], schema), path)
    assert {(r.source_id, r.text) for r in spark.read.parquet(path).collect()} == {("a", "new"), ("b", "kept")}


def test_purge_takes_every_output(spark):
    rows = spark.createDataFrame([("t",), ("u",), (None,)], "task_id string")
    left = tables.purge_task({"reports": rows, "sources": rows}, "t")
    assert list(left) == ["reports", "sources"] and all(df.count() == 2 for df in left.values())
    assert tables.claim("failed") == "running"


def test_marks_and_priorities(spark):
    df = spark.createDataFrame([("aa bb cc", [("One", "bb"), ("Two", "zz"), ("", " ")])], "t string, s array<struct<title:string,content:string>>")
    assert df.select(N.mark_sections(F.col("t"), F.col("s")).alias("x")).first()[0] == "aa \n\n<!-- SECTION: One -->\nbb cc\n\n<!-- SECTION: Two -->\nzz"
    text = "lead " * 20 + "\n# A\n" + "x " * 200 + "\n# B\nkey key\n"
    got = spark.createDataFrame([(text,)], "t string").select(N.prioritized(F.col("t"), {"key": 1.0}, 200, least=10, lead=50).alias("x")).first()[0]
    assert got.startswith("lead") and "key key" in got and len(got) <= 210


def test_composed_answers(spark):
    rows = [("q", 1, "2023", "收入5亿元（来源 2 年报）"), ("q", 2, "2021", "收入4亿元"), ("q", 3, None, " ")]
    got = R.compose(spark.createDataFrame(rows, "q string, rank int, period string, claim string"), "q").first()
    assert got.direct == "收入5亿元；收入4亿元。" and got.trend == "从已核对条目看，2021 → 2023 年间相关数据为：收入4亿元；收入5亿元。"
