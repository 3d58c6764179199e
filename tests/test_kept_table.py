import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import kept_table, upsert

NODE = "label string, key long, name string, seq long"
KEYS = ["label", "key"]


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def content(frame):
    rows = [tuple(r) for r in frame.select("label", "key", "name").collect()]
    assert len(rows) == len(set(r[:2] for r in rows))
    return {r[:2]: r[2] for r in rows}


@pytest.mark.parametrize("share", [0.0, 0.3, 100.0])
def test_any_sequence_of_changes(spark, tmp_path, share):
    rng = random.Random(int(share * 10))

    def some(n):
        return [(rng.choice(["A", "B", None]), rng.choice([None, *range(40)]), rng.choice(["x", "y", None]) , i) for i in range(n)]

    start = some(60)
    model = {r[:2]: r[2] for r in start}
    table = kept_table.build(nodes(spark, start), f"{tmp_path}/t", KEYS, ["seq"], buckets=8)
    versions = [dict(model)]
    for batch in range(1, 6):
        rows, kind = some(rng.randrange(0, 25)), ["upsert", "add", "remove", "upsert", "add"][batch - 1]
        # A batch that runs twice counts once.
        for _ in range(1 + (batch == 2)):
            if kind == "upsert":
                table.upsert(nodes(spark, rows), batch, ["seq"], share)
            elif kind == "add":
                table.add_absent(nodes(spark, rows), batch, ["seq"], share)
            else:
                table.remove(nodes(spark, rows).select("label", "key"), batch, share)
        if kind == "remove":
            for r in rows:
                model.pop(r[:2], None)
        else:
            fresh = {r[:2]: r[2] for r in rows}
            model = {**model, **fresh} if kind == "upsert" else {**fresh, **model}
        versions.append(dict(model))
    table = kept_table.open_table(spark, f"{tmp_path}/t")
    for version, wanted in enumerate(versions):
        assert content(table.read(version)) == wanted
    assert content(table.read()) == versions[-1]
    table.forget(4)
    assert content(table.read(4)) == versions[4] and content(table.read()) == versions[5]


def test_equal_to_the_full_merge_and_only_changes_written(spark, tmp_path):
    size, changed = 20_000, 200
    base = spark.range(size).select(F.lit("A").alias("label"), F.col("id").alias("key"), F.col("id").cast("string").alias("name"), F.col("id").alias("seq"))
    new = spark.range(changed).select(F.lit("A").alias("label"), (F.col("id") * 101).alias("key"), F.lit("new").alias("name"), F.col("id").alias("seq"))
    table = kept_table.build(base, f"{tmp_path}/t", KEYS, ["seq"], buckets=16)
    table.upsert(new, 1, ["seq"])
    assert spark.read.parquet(f"{tmp_path}/t/rows/batch=1").count() == changed
    assert content(table.read()) == content(upsert.upsert_nodes(new, base, KEYS))
    # Changes of one bucket that are many for it: this bucket is rewritten, no other file is made or read.
    placed = table._place(base).where("bucket = 3").drop("bucket").withColumn("name", F.lit("again"))
    table.upsert(placed, 2, ["seq"])
    assert [r.bucket for r in spark.read.parquet(f"{tmp_path}/t/rows/batch=2").select("bucket").distinct().collect()] == [3]
    assert spark.read.parquet(f"{tmp_path}/t/rows/batch=2").count() == placed.count()
    state = table._log()
    assert state[3]["base"] == 2 and not state[3]["layers"] and all(s["base"] == 0 for b, s in state.items() if b != 3)
    assert content(table.read()) == content(upsert.upsert_nodes(placed, upsert.upsert_nodes(new, base, KEYS), KEYS))


def test_get_or_create_reads_only_the_buckets_of_its_rows(spark, tmp_path):
    base = spark.range(5000).select(F.lit("A").alias("label"), F.col("id").alias("key"), F.lit("old").alias("name"), F.col("id").alias("seq"))
    table = kept_table.build(base, f"{tmp_path}/t", KEYS, ["seq"], buckets=32)
    some = table._merged({b: s for b, s in table._log().items() if b in (4, 9)})
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} == {"4", "9"}
    table.add_absent(nodes(spark, [("A", 7, "new", 1), ("A", 9000, "new", 2)]), 1, ["seq"])
    assert spark.read.parquet(f"{tmp_path}/t/rows/batch=1").count() == 1
    got = content(table.read())
    assert got["A", 7] == "old" and got["A", 9000] == "new" and len(got) == 5001


def test_layers_stay_few(spark, tmp_path):
    base = [("A", i, "old", i) for i in range(200)]
    table = kept_table.build(nodes(spark, base), f"{tmp_path}/t", KEYS, ["seq"], buckets=1)
    for batch in range(1, kept_table.DEPTH + 3):
        table.upsert(nodes(spark, [("A", batch, f"n{batch}", 0)]), batch, ["seq"], share=100.0)
    assert len(table._log()[0]["layers"]) <= kept_table.DEPTH
    assert sum(name != "old" for name in content(table.read()).values()) == kept_table.DEPTH + 2


def test_empty_tables_and_refusals(spark, tmp_path):
    none = nodes(spark, [])
    table = kept_table.build(none, f"{tmp_path}/t", KEYS, ["seq"])
    assert table.read().count() == 0
    table.upsert(none, 1, ["seq"])
    table.upsert(nodes(spark, [("A", 1, None, 1), ("A", 1, "b", 2)]), 2, ["seq"])
    table.upsert(spark.createDataFrame([("A", 2, 1)], "label string, key long, seq long"), 3, ["seq"])
    assert content(table.read()) == {("A", 1): "b", ("A", 2): None}
    table.remove(nodes(spark, [("A", 1, None, 1), ("A", 2, None, 1), ("Z", 1, None, 1)]), 4)
    assert table.read().count() == 0
    with pytest.raises(ValueError):
        table.upsert(none, 1, ["seq"])
    with pytest.raises(ValueError):
        table.upsert(none.withColumn("more", F.lit(1)), 5, ["seq"])
    with pytest.raises(ValueError):
        kept_table.build(none, f"{tmp_path}/t", KEYS, ["seq"])
    with pytest.raises(ValueError):
        kept_table.build(none.withColumn("bucket", F.lit(1)), f"{tmp_path}/u", KEYS, ["seq"])
