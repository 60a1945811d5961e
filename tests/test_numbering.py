"""Numbers of rows against a window, with a hot key, null keys and empty tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators.numbering import numbered


def test_numbers_equal_a_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 40).cast("string")).alias("k"), (F.col("id") * 7919 % 3001).alias("v"), "id")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")))
    got = numbered(rows.repartition(5), [F.desc("v"), F.asc("id")], "n", ["k"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    whole = numbered(rows, [F.asc("v"), F.asc("id")], "n", kind="long").orderBy("n").collect()
    assert [r["n"] for r in whole] == list(range(1, 3001)) and all((a["v"], a["id"]) < (b["v"], b["id"]) for a, b in zip(whole, whole[1:], strict=False))
    assert numbered(rows.limit(0), [F.asc("v")], "n", ["k"]).collect() == []


def test_a_hot_key_is_sorted_by_several_tasks(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), "id")
    got = numbered(rows, [F.asc("id")], "n", ["k"])
    assert got.select(F.max("n")).first()[0] == 4000
    spread = rows.repartitionByRange("k", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
