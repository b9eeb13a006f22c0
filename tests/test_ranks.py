"""Numbers and running sums by ranges against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(k, rng.choice(["hot", "hot", None, "a", "b", ""]), rng.choice([None, 1, 1, 1, rng.randint(0, 40)]), rng.randint(-5, 5)) for k in range(3000)]
    return spark.createDataFrame(data, "id long, g string, v long, x long").repartition(7)


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbers_of_rows_in_groups(rows):
    window = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id")
    want = rows.withColumn("at", F.row_number().over(window)).withColumn("size", F.count("*").over(Window.partitionBy("g")))
    same(ranks.numbered(rows, [F.desc_nulls_last("v"), F.col("id").asc()], ["g"], "at", "size"), want)


def test_numbers_without_groups(rows):
    want = rows.withColumn("at", F.row_number().over(Window.orderBy("v", "id")))
    same(ranks.numbered(rows, [F.col("v").asc(), F.col("id").asc()], name="at"), want)


def test_running_sums(rows):
    window = Window.partitionBy("g").orderBy("v", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("row_number", F.row_number().over(Window.partitionBy("g").orderBy("v", F.desc("id")))).withColumn("upto", F.sum(F.col("x") * 2).over(window)).withColumn("seen", F.count("v").over(window))
    got = ranks.running(rows, [F.col("v").asc(), F.col("id").desc()], {"upto": F.col("x") * 2, "seen": F.when(F.col("v").isNotNull(), 1).otherwise(0)}, ["g"])
    same(got, want)


def test_one_value_in_all_rows_is_dealt_over_ranges(spark):
    rows = spark.range(0, 20000, 1, 8).select("id", F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = ranks.ranged(rows, [F.col("v").asc()]).groupBy("__range").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 4 and max(r["count"] for r in got) < 10000
    assert ranks.numbered(rows, [F.col("v").asc()]).agg(F.countDistinct("row_number"), F.max("row_number")).first()[:] == (20000, 20000)


def test_no_rows(rows):
    assert ranks.numbered(rows.limit(0), [F.col("v").asc()], ["g"]).collect() == []
    assert ranks.running(rows.limit(0), [F.col("v").asc()], {"s": F.col("x")}).collect() == []
