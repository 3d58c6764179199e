import random

from pyspark.sql import functions as F

from graphmill.operators import paths

EDGE = "src_label string, src_key string, dst_label string, dst_key string"


def edges_of(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def plain(rows, labels):
    """Breadth first from every start, not through ends."""
    out = {}
    for a, b, c, d in rows:
        if None not in (a, b, c, d):
            out.setdefault((a, b), set()).add((c, d))
    found = set()
    for start in out:
        seen, front, hops = set(), {start}, 0
        while front:
            hops += 1
            front = {n for f in front for n in out.get(f, ())} - seen
            seen |= front
            found |= {(*start, *n, hops) for n in front if n[0] in labels}
            front = {n for n in front if n[0] not in labels}
    return found


def test_a_chain_of_twenty_steps(spark):
    rows = [("Unit", str(i), "Unit", str(i + 1)) for i in range(19)] + [("Unit", "19", "Group", "g")]
    found = paths.chain_ends(edges_of(spark, rows), "Group").collect()
    assert {tuple(r) for r in found} == {("Unit", str(i), "Group", "g", 20 - i) for i in range(20)}
    assert len(found) == 20


def test_cycles_end(spark):
    ring = [("Unit", str(i), "Unit", str((i + 1) % 7)) for i in range(7)]
    assert paths.chain_ends(edges_of(spark, ring), "Group").count() == 0
    rows = [*ring, ("Unit", "3", "Group", "g"), ("Unit", "x", "Unit", "0"), ("Unit", "3", "Unit", "3")]
    assert {tuple(r) for r in paths.chain_ends(edges_of(spark, rows), "Group").collect()} == plain(rows, {"Group"})


def test_any_graph_with_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    node = lambda: (rng.choice(["Unit", "Unit", "Unit", "Group", "Land"]), rng.choice("abcdefghij"))
    rows = [(*node(), *node()) for _ in range(25)]
    rows += [*rows[:3], (None, "a", "Group", "b"), ("Unit", "a", "Group", None)]
    edges = edges_of(spark, rows).withColumn("hops", F.lit("x")).withColumn("ended", F.lit(None))
    found = paths.chain_ends(edges, "Group", "Land").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == plain(rows, {"Group", "Land"})
    assert paths.chain_ends(edges.where("false"), "Group").collect() == []


def test_stored_ways_are_dealt_by_rows(spark, monkeypatch):
    counts, stored = [], paths.stored

    def counted(df, name):
        counts.append(df.rdd.getNumPartitions())
        return stored(df, name)

    monkeypatch.setattr(paths, "stored", counted)
    rows = [("Unit", str(i), "Unit", str(i + 1)) for i in range(5)] + [("Unit", "5", "Group", "g")]
    assert paths.chain_ends(edges_of(spark, rows).coalesce(1), "Group").count() == 6
    assert set(counts) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}
