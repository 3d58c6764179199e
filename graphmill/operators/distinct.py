"""Distinct counts that are kept and merged: one sketch for each group and day, never the rows again.

``add`` reduces a batch of rows to a HyperLogLog sketch (Spark's own) for each group and day and stores these few
rows by batch; a batch that runs again replaces its own. ``count`` merges the sketches of any days, so values that
come on several days or in several batches count once. Sketches are made on the map side, so a group that holds a
third of all rows reaches its reducer as one sketch from each task.

The estimate has a relative standard error of ``1.04 / sqrt(2 ** bits)``: 0.8 % at 14 bits, in 16 KB a sketch at most.
``error`` gives three of these. Exact counts stay the business of ``count_distinct``.

Null values do not count; a group without others counts 0. Null groups and days are ones of their own. An empty batch
stores nothing, and nothing stored counts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 14
KEPT = "`group` string, day string, sketch binary, batch long"


def error(bits: int = BITS) -> float:
    """Relative error that an estimate stays within, but for one in several hundred."""
    return 3 * 1.04 / math.sqrt(2**bits)


def add(rows: DataFrame, group: Column, day: Column, value: Column, path: str, batch: int, bits: int = BITS) -> None:
    """Store the sketches of a batch below ``path``; all batches take the same ``bits``."""
    # A sketch takes no empty text, so each value has a sign before it.
    marked = F.concat(F.lit("="), value.cast("string"))
    narrow = rows.select(group.cast("string").alias("group"), day.cast("string").alias("day"), marked.alias("v"))
    sketches = narrow.groupBy("group", "day").agg(F.hll_sketch_agg("v", bits).alias("sketch"))
    writer = sketches.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def count(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """group and n, the estimated distinct values of the days from ``since`` to ``until``.

    Both are included, and without either all days count; the null day is in no range.
    """
    kept = spark.read.schema(KEPT).parquet(path)
    if since is not None:
        kept = kept.where(F.col("day") >= since)
    if until is not None:
        kept = kept.where(F.col("day") <= until)
    merged = kept.groupBy("group").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("group", F.hll_sketch_estimate("sketch").alias("n"))
