"""News ingest in micro-batches, with the batch operators inside ``foreachBatch``.

News of any date are linked once, in any order of arrival and over restarts: nothing is discarded for being late.
The state is a stored table of news keys by day; a batch meets the days of its own news only. Keys, links and
counts are stored by batch, and a batch replaces its own folders only, so one that runs again after a lost executor
or a restart replaces its own output. Of news that repeat within a batch, the earliest stays (null times last).
News without date or time are linked like others, their day is null.

``compact`` rewrites the many small files of a long run; ``counts`` tells what became of the rows of each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphmill.operators.linking import IDENTITY, news_key
from graphmill.session import exists


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The tables below ``path`` in a new folder ``target``, with few files per day; run between batches.

    The counts of past batches become one row, so the time up to which news had come is kept.
    """
    for name in ("links", "keys"):
        rows = spark.read.parquet(f"{path}/{name}").withColumn("batch", F.lit(-1))
        rows.hint("rebalance", "day").write.partitionBy("day", "batch").parquet(f"{target}/{name}")
    past = counts(spark, path)
    sums = [F.sum(c).alias(c) for c in ("rows", "repeated", "late", "linked")]
    past.groupBy(F.lit(-1).alias("batch")).agg(F.max("newest").alias("newest"), *sums).write.partitionBy("batch").parquet(
        f"{target}/counts"
    )


def counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, its rows, how many of them repeat known news, came late or were linked, and its newest time.

    Late are new news that are older than the newest of earlier batches.
    """
    return spark.read.parquet(f"{path}/counts")


def _unseen(batch: DataFrame, path: str, batch_id: int, dated: bool) -> DataFrame:
    """One row of each key that no other batch has stored; of keys that hold the date, only their days are read."""
    columns = [c for c in batch.columns if c != "news_key"]
    order = F.struct(F.col("event_time").isNull().alias("none"), "event_time", F.xxhash64(*columns).alias("tie"))
    first = batch.groupBy("news_key").agg(F.min_by(F.struct(*columns), order).alias("n")).select("news_key", "n.*")
    if not exists(batch.sparkSession, f"{path}/keys"):
        return first
    known = batch.sparkSession.read.parquet(f"{path}/keys").where(F.col("batch") != batch_id)
    if dated:
        days = batch.select(F.col("day").alias("d")).distinct()
        known = known.join(days, F.col("day").eqNullSafe(F.col("d")), "left_semi")
    known = known.select(F.col("news_key").alias("k")).distinct()
    return first.join(known, F.col("news_key").eqNullSafe(F.col("k")), "left_anti")


def ingest_news(
    stream: DataFrame,
    link: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    event_time: str = "ts",
    identity: str = "headline_date",
) -> StreamingQuery:
    """Link the news of a stream that have no link yet.

    ``stream``: news_id, headline, date, ``event_time`` and what ``link`` needs. ``link`` maps a batch of news to
    mention rows with ``news_key`` and ``day``. Runs over all available input, then stops.
    """
    keyed = stream.withColumns(
        {"news_key": news_key(IDENTITY[identity]), "day": F.col("date"), "event_time": F.col(event_time)}
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def store(rows: DataFrame, name: str, *by: str) -> None:
            writer = rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(f"{path}/{name}")

        def own(name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/{name}").where(F.col("batch") == batch_id)

        batch = batch.persist()
        fresh = _unseen(batch, path, batch_id, "date" in IDENTITY[identity]).persist()
        newest = None
        if exists(spark, f"{path}/counts"):
            newest = counts(spark, path).where(F.col("batch") != batch_id).agg(F.max("newest")).first()[0]
        store(link(fresh.drop("day", "event_time")), "links", "day")
        store(fresh.select("news_key", "day"), "keys", "day")
        came = batch.agg(F.count("*").alias("rows"), F.max("event_time").alias("newest"))
        late = F.count_if(F.col("event_time") < F.lit(newest)) if newest is not None else F.lit(0).cast("bigint")
        new = fresh.agg(F.count("*").alias("fresh"), late.alias("late"))
        linked = own("links").agg(F.count_distinct("news_key").alias("linked"))
        rows, new, linked = came.first(), new.first(), linked.first()
        # One row for each batch, written last: a batch without it has not ended.
        told = [(rows["rows"], rows["rows"] - new["fresh"], new["late"], linked["linked"], rows["newest"])]
        schema = "rows long, repeated long, late long, linked long, newest timestamp"
        store(spark.createDataFrame(told, schema), "counts")
        fresh.unpersist()
        batch.unpersist()

    return (
        keyed.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
