import os

import pytest
from pyspark.sql import functions as F

from graphmill.operators import vector_index, vectors
from graphmill.session import fresh_dir
from tests.test_vectors import clustered, frame, small_blocks  # noqa: F401


def rows_of(found):
    return sorted((r.q_id, r.i_id, r["rank"], round(r.score, 9)) for r in found.collect())


@pytest.fixture
def items(spark, small_blocks):  # noqa: F811
    return frame(spark, clustered(72, 11)).withColumn("day", F.concat(F.lit("2024-01-0"), (F.col("id") / 12).cast("int") + 1))


def test_build_append_remove_and_search_equal_a_fresh_search(spark, items):
    path = vector_index.build(items.where("id < 36"), fresh_dir(spark, "index"))
    for batch in (1, 1, 2):  # the first batch runs twice
        part = items.where("id between 36 and 59" if batch == 1 else "id >= 60")
        vector_index.append(part, path, batch)
    for floor in (None, 0.8):
        want = vectors.knn(items, items, 3, floor, skip_self=True)
        assert rows_of(vector_index.search(items, path, 3, floor, skip_self=True)) == rows_of(want)
    assert vector_index.remove_days(spark, path, ["2024-01-02", "2024-01-05", "2030-01-01"]) == 2
    left = items.where("day not in ('2024-01-02', '2024-01-05')")
    want = rows_of(vectors.knn(items, left, 3, skip_self=True))
    assert rows_of(vector_index.search(items, path, 3, skip_self=True)) == want
    smaller = fresh_dir(spark, "index")
    vector_index.compact(spark, path, smaller)
    assert rows_of(vector_index.search(items, smaller, 3, skip_self=True)) == want


def test_an_id_that_comes_again_counts_in_its_latest_version(spark, items):
    path = vector_index.build(items, fresh_dir(spark, "index"))
    turned = F.transform("vec", lambda v: -v)
    moved = items.where("id % 4 = 0").withColumn("vec", turned).withColumn("day", F.lit("2024-02-01"))
    vector_index.append(moved.unionByName(moved), path, 1)
    now = items.where("id % 4 <> 0").unionByName(moved)
    assert vector_index.read(spark, path).count() == 72
    assert rows_of(vector_index.search(items, path, 2)) == rows_of(vectors.knn(items, now, 2))
    vector_index.remove_days(spark, path, ["2024-02-01"])
    assert rows_of(vector_index.search(items, path, 2)) == rows_of(vectors.knn(items, items.where("id % 4 <> 0"), 2))


def test_a_search_opens_only_shards_it_can_match_in(spark, items, monkeypatch):
    path = vector_index.build(items, fresh_dir(spark, "index"))
    _, shards = vector_index._cells(spark, path)
    opened = []
    inner = vector_index.read
    monkeypatch.setattr(vector_index, "read", lambda *a: opened.append(inner(*a)) or opened[-1])
    one = items.where("id = 5")
    assert rows_of(vector_index.search(one, path, 3, 0.99)) == rows_of(vectors.knn(one, items, 3, 0.99))
    plan = opened[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {os.path.basename(os.path.dirname(r[0])) for r in opened[0].select(F.input_file_name()).collect()}
    assert 0 < len(files) < len(set(shards))


def test_rows_without_direction_empty_tables_and_clashing_columns(spark, items):
    odd = spark.createDataFrame(
        [(None, [1.0, 0.0], "d", "x"), (1, None, "d", "x"), (2, [0.0, 0.0], "d", "x"), (3, [2.0, 0.0], None, "x"), (4, [], "d", "x")],
        "id long, vec array<double>, day string, cell string",
    )
    path = vector_index.build(odd.where("false"), fresh_dir(spark, "index"))
    query = spark.createDataFrame([(9, [1.0, 0.0])], "id long, vec array<double>")
    assert vector_index.search(query, path).collect() == []
    vector_index.append(odd, path, 1)
    assert rows_of(vector_index.search(query, path)) == [(9, 3, 1, 1.0)]
    assert vector_index.remove_days(spark, path, [None]) == 1
    assert vector_index.search(query, path).collect() == []
    with pytest.raises(ValueError):
        vector_index.build(odd, path)
