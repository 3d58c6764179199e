from pyspark.sql import functions as F

from graphmill.operators import distinct
from graphmill.session import fresh_dir


def add(rows, path, batch):
    distinct.add(rows, F.col("g"), F.col("day"), F.col("v"), path, batch)


def test_merged_sketches_stay_within_their_error(spark):
    rows = spark.range(60000).select(
        (F.col("id") % 3 % 2).alias("g"), F.concat(F.lit("2024-01-0"), (F.col("id") % 7 + 1)).alias("day"),
        F.expr("id * id % 9973").alias("v"), F.col("id").alias("batch"),
    )
    path = fresh_dir(spark, "sketches")
    for batch, part in ((0, "id < 20000"), (1, "id >= 20000"), (1, "id >= 20000")):  # the second batch runs twice
        add(rows.withColumnRenamed("batch", "id").where(part), path, batch)
    for since, until in ((None, None), ("2024-01-03", "2024-01-04"), ("2024-01-07", None)):
        days = rows.where(F.col("day").between(since or "", until or "9"))
        exact = {str(r.g): r.n for r in days.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
        found = {r["group"]: r.n for r in distinct.count(spark, path, since, until).collect()}
        assert found.keys() == exact.keys()
        assert all(abs(found[g] - n) <= distinct.error() * n for g, n in exact.items())
    assert spark.read.parquet(path).count() == 2 * 2 * 7


def test_nulls_and_empty_tables(spark):
    path = fresh_dir(spark, "sketches")
    rows = spark.createDataFrame([(None, None, "a"), (None, "d", "a"), ("x", "d", None), ("x", "d", None), ("y", "d", "")], "g string, day string, v string")
    add(rows.where("false"), path, 0)
    assert distinct.count(spark, path).collect() == []
    add(rows, path, 1)
    assert {(r["group"], r.n) for r in distinct.count(spark, path).collect()} == {(None, 1), ("x", 0), ("y", 1)}
