import random

from graphmill.operators import digest




def test_hot_group_gives_the_first_lines_and_no_window_over_texts(spark):
    rng = random.Random(5)
    rows = [("hot", i, "x" * rng.randint(0, 30)) for i in range(4000)] + [(f"g{i % 40}", i, f"line {i}") for i in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "grp string, seq long, line string").repartition(5)
    out = digest.digest(frame, ["grp"], ["seq"], limit=500)
    groups = {}
    for grp, seq, line in rows:
        if line:
            groups.setdefault(grp, []).append((seq, line))
    wanted = {g: "\n".join(x for _, x in sorted(v))[:500] for g, v in groups.items()}
    assert {r.grp: r.digest for r in out.collect()} == wanted
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_orders_copies_and_nulls(spark):
    rows = [("a", 1, "same")] * 5 + [("a", 1, "other"), ("a", 0, "first"), (None, 1, "n"), ("b", None, "z"), ("b", 1, None), ("c", 1, "")]
    frame = spark.createDataFrame(rows, "grp string, seq long, line string")
    found = {r.grp: r.digest for r in digest.digest(frame, ["grp"], ["seq"], limit=1000).collect()}
    assert found[None] == "n" and found["b"] == "z" and "c" not in found
    assert found["a"].startswith("first\n") and sorted(found["a"].split("\n")[1:]) == ["other"] + ["same"] * 5
    short = digest.digest(frame.where("grp = 'a'"), ["grp"], ["seq"], limit=17).first().digest
    assert len(short) == 17 and found["a"].startswith(short)
