import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import degrees, maintain

EDGE = "src_label string, src_key long, rel string, dst_label string, dst_key long"


def test_any_sequence_of_adds_and_deletes(spark, tmp_path):
    rng = random.Random(4)
    at = f"{tmp_path}/degrees"
    nodes = spark.createDataFrame([(label, key) for label in "AB" for key in range(20)], "label string, key long")
    edges: set[tuple] = set()
    for batch in range(6):
        drawn = {(rng.choice("AB"), rng.randrange(20), "R", rng.choice("AB"), rng.randrange(20)) for _ in range(8)}
        came, went = drawn - edges, set(rng.sample(sorted(edges), len(edges) // 2))
        edges = (edges | came) - went
        for _ in range(1 + (batch == 1)):
            degrees.add(at, batch, spark.createDataFrame(sorted(came), EDGE), spark.createDataFrame(sorted(went), EDGE))
        if batch == 3:
            degrees.fold(spark, at)
        table = spark.createDataFrame(sorted(edges), EDGE)
        for label in "AB":
            wanted = {tuple(r) for r in maintain.orphans(nodes, table, label).collect()}
            assert {tuple(r) for r in degrees.orphans(nodes, at, label).collect()} == wanted
        ends = [e[:2] for e in edges] + [e[3:] for e in edges]
        assert {(r.label, r.key): r.degree for r in degrees.degrees(spark, at).collect()} == {e: ends.count(e) for e in ends}


def test_edges_are_not_read(spark, tmp_path):
    spark.createDataFrame([("A", 1, "R", "A", 2)], EDGE).write.parquet(f"{tmp_path}/edges")
    degrees.add(f"{tmp_path}/degrees", 0, spark.read.parquet(f"{tmp_path}/edges"))
    nodes = spark.createDataFrame([("A", 1), ("A", 3)], "label string, key long")
    found = degrees.orphans(nodes, f"{tmp_path}/degrees", "A")
    assert all("/degrees/" in f for f in found.inputFiles()) and [r.key for r in found.collect()] == [3]


def test_loops_nulls_and_empty_batches(spark, tmp_path):
    at = f"{tmp_path}/degrees"
    rows = [("A", 1, "R", "A", 1), ("A", None, "R", None, 5)]
    degrees.add(at, 0, spark.createDataFrame(rows, EDGE).withColumn("change", F.lit("x")))
    degrees.add(at, 1, spark.createDataFrame([], EDGE), spark.createDataFrame([], EDGE))
    degrees.add(at, 2, went=spark.createDataFrame([], EDGE))
    got = {(r.label, r.key): r.degree for r in degrees.degrees(spark, at).collect()}
    assert got == {("A", 1): 2, ("A", None): 1, (None, 5): 1}
    with pytest.raises(ValueError):
        degrees.add(at, 3)
