import pytest
from pyspark.sql import functions as F

from graphmill import session
from graphmill.streaming.ingest import compact, counts, ingest_news

SCHEMA = "news_id long, ts timestamp, headline string, date date"


def write(spark, path, rows):
    spark.createDataFrame(rows, "news_id long, ts string, headline string").select(
        "news_id", F.col("ts").cast("timestamp").alias("ts"), "headline", F.to_date("ts").alias("date")
    ).coalesce(1).write.mode("append").parquet(path)


def link(news):
    return news.where("headline <> 'noise'").select("news_key", "headline", F.col("date").alias("day"), "news_id")


def test_repeats_are_linked_once_across_batches_and_runs(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest_news(stream, link, out, mark).awaitTermination()
        return sorted((r.headline, str(r.day)) for r in spark.read.parquet(f"{out}/links").collect())

    write(spark, source, [(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:01:00", "a"), (3, "2024-01-01 10:02:00", "noise")])
    assert run() == [("a", "2024-01-01")]
    # A late repeat of the same news, a new one, and the same headline on another day.
    write(spark, source, [(4, "2024-01-01 10:03:00", "a"), (5, "2024-01-01 11:00:00", "b"), (6, "2024-01-05 10:00:00", "a")])
    assert run() == [("a", "2024-01-01"), ("a", "2024-01-05"), ("b", "2024-01-01")]
    assert run() == [("a", "2024-01-01"), ("a", "2024-01-05"), ("b", "2024-01-01")]
    # Old news after the watermark has passed: known from the stored links.
    write(spark, source, [(7, "2024-01-09 10:00:00", "c"), (8, "2024-01-01 10:00:00", "a")])
    assert run().count(("a", "2024-01-01")) == 1


def test_news_of_any_date_are_linked_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))

    def run(rows):
        write(spark, source, rows)
        ingest_news(spark.readStream.schema(SCHEMA).parquet(source), link, out, mark).awaitTermination()
        links = sorted((r.headline, str(r.day)) for r in spark.read.parquet(f"{out}/links").collect())
        last = counts(spark, out).orderBy(F.desc("batch")).first()
        return links, (last["rows"], last["repeated"], last["late"], last["linked"])

    a, b, c = ("a", "2024-03-10"), ("b", "2024-03-11"), ("c", "2024-03-01")
    assert run([(1, "2024-03-10 08:00:00", "a"), (2, "2024-03-10 09:00:00", "noise")]) == ([a], (2, 0, 0, 1))
    assert run([(3, "2024-03-11 08:00:00", "b"), (4, "2024-03-11 07:00:00", "b")]) == ([a, b], (2, 1, 0, 1))
    # Ten days late, a repeat of stored news, and repeats among the late ones.
    late = [(5, "2024-03-01 08:00:00", "c"), (6, "2024-03-10 08:00:00", "a"), (7, "2024-03-01 09:00:00", "c")]
    assert run(late) == ([a, b, c], (3, 2, 1, 1))
    # Without a time, twice.
    none = ("d", "None")
    assert run([(8, None, "d"), (9, None, "d")]) == (sorted([a, b, c, none]), (2, 1, 0, 1))
    assert run([(10, None, "d")])[1] == (1, 1, 0, 0)


def test_identity_without_date(spark, tmp_path):
    source, out, mark = (str(tmp_path / name) for name in ("in", "out", "mark"))
    for rows in ([(1, "2024-03-10 08:00:00", "a"), (2, "2024-03-11 08:00:00", "a")], [(3, "2024-03-01 08:00:00", "a")]):
        write(spark, source, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest_news(stream, link, out, mark, identity="headline").awaitTermination()
    assert [(r.headline, r.news_id) for r in spark.read.parquet(f"{out}/links").collect()] == [("a", 1)]


def test_compacted_tables_are_carried_on(spark, tmp_path):
    source, out, mark, packed = (str(tmp_path / name) for name in ("in", "out", "mark", "packed"))
    stream = spark.readStream.schema(SCHEMA)
    write(spark, source, [(1, "2024-03-10 08:00:00", "a"), (2, "2024-03-12 08:00:00", "b")])
    ingest_news(stream.parquet(source), link, out, mark).awaitTermination()
    compact(spark, out, packed)
    write(spark, source, [(3, "2024-03-10 08:00:00", "a"), (4, "2024-03-11 08:00:00", "c")])
    ingest_news(stream.parquet(source), link, packed, mark).awaitTermination()
    assert sorted(r.headline for r in spark.read.parquet(f"{packed}/links").collect()) == ["a", "b", "c"]
    assert counts(spark, packed).where("batch >= 0").select("rows", "repeated", "late", "linked").first() == (2, 1, 1, 1)


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert session.fresh_dir(spark, "x") != session.fresh_dir(spark, "x")


def test_a_cluster_without_the_setting_is_refused():
    class Stub:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Stub.conf)

    with pytest.raises(ValueError):
        session.shared_dir(Stub)
