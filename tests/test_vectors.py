import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.operators import enrich, hooks, vectors


@pytest.fixture
def small_blocks(monkeypatch):
    """Many cells and blocks on few rows."""
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "CELL", 1)


def clustered(rows, seed, dim=8):
    """Vectors around a few directions, a third of them copies of one."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    matrix = centres[draw.integers(0, 6, rows)] + 0.25 * draw.normal(size=(rows, dim))
    matrix[: rows // 3] = matrix[0]
    return matrix


def frame(spark, matrix, **extra):
    rows = [(i, [float(x) for x in v], *[int(e[i]) for e in extra.values()]) for i, v in enumerate(matrix)]
    columns = "".join(f", {name} long" for name in extra)
    return spark.createDataFrame(rows, f"id long, vec array<double>{columns}")


def cosines(matrix):
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    return np.round(unit @ unit.T, vectors.DIGITS)


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.95])
def test_pairs_equal_the_full_matrix(spark, small_blocks, threshold):
    matrix = clustered(240, 3)[79:]
    want = cosines(matrix)
    found = vectors.similar_pairs(frame(spark, matrix), threshold).collect()
    pairs = {(r.a, r.b) for r in found}
    assert len(pairs) == len(found)
    assert pairs == {(i, j) for i in range(len(matrix)) for j in range(i + 1, len(matrix)) if want[i, j] > threshold}


@pytest.mark.parametrize("floor", [None, 0.6])
def test_both_searches_agree_with_sorting_every_row(spark, small_blocks, floor):
    matrix = clustered(150, 5)
    want = cosines(matrix)
    wanted = set()
    for i, row in enumerate(want):
        best = sorted((-c, j) for j, c in enumerate(row) if j != i)[:4]
        wanted |= {(i, j, r + 1) for r, (c, j) in enumerate(best) if floor is None or -c >= floor}
    items = frame(spark, matrix)
    for method in ("broadcast", "blocks"):
        found = vectors.knn(items, items, 4, floor, scale="cosine", skip_self=True, method=method).collect()
        # Copies differ in the last bits only, which rounding hides; ranks among them go by id.
        assert {(r.q_id, r.i_id, r["rank"]) for r in found} == wanted


def test_score_scales_and_strictness(spark):
    items = frame(spark, np.array([[1.0, 0.0]]))
    query = frame(spark, np.array([[0.6, 0.8], [0.0, 0.0]]))
    assert [r.score for r in vectors.knn(query, items, 1).collect()] == [0.8]
    assert [r.score for r in vectors.knn(query, items, 1, scale="cosine").collect()] == [0.6]
    assert vectors.knn(query, items, 1, 0.8).count() == 1
    assert vectors.knn(query, items, 1, 0.8, strict=True).count() == 0


def test_threshold_comes_after_the_choice_of_the_best(spark):
    items = frame(spark, np.array([[1.0, 0.0], [0.9, 0.1]]))
    query = frame(spark, np.array([[1.0, 0.0]]))
    assert vectors.knn(query, items, 1, 0.5).count() == 1


def test_empty_items(spark):
    items = frame(spark, np.array([[1.0, 0.0]]))
    none = items.where("id < 0")
    for method in ("broadcast", "blocks"):
        assert vectors.knn(items, none, 1, method=method).count() == 0
    assert vectors.similar_pairs(none, 0.5).count() == 0


def test_items_too_large_to_hold_are_refused(spark, monkeypatch):
    items = frame(spark, clustered(60, 1))
    assert vectors.knn(items, items, 1, method="broadcast").count() == 60
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError):
        vectors.knn(items, items, 1, method="broadcast")


def test_visits_per_vector_fall_with_the_threshold_and_grow_slower_than_the_table(spark):
    """Clustered vectors: a query meets few cells, and cells grow with the square root of the table."""
    seen = {}
    for rows in (400, 1600):
        draw = np.random.default_rng(4)
        centres = draw.normal(size=(40, 16))
        matrix = centres[draw.integers(0, 40, rows)] + 0.1 * draw.normal(size=(rows, 16))
        items = vectors.unit_vectors(frame(spark, matrix))
        pivots = vectors._pivots(items, int(np.ceil(np.sqrt(rows))))
        for threshold in (0.5, 0.95):
            placed = vectors._homes(items, pivots, "bigint").withColumn("radius", vectors._radius(threshold))
            seen[rows, threshold] = vectors.visits(placed, pivots, "bigint").count() / rows / len(pivots)
    print("share of cells visited:", seen)
    assert seen[400, 0.95] < seen[400, 0.5] and seen[1600, 0.95] < 0.25


def test_owner_counts_with_a_hot_group_of_copies(spark, small_blocks):
    matrix = clustered(120, 9)
    owner = np.random.default_rng(2).integers(0, 5, len(matrix))
    want = cosines(matrix)
    counts, listed = collections.Counter(), collections.defaultdict(list)
    for i in range(len(matrix)):
        for j in range(i + 1, len(matrix)):
            if want[i, j] > 0.8 and owner[i] != owner[j]:
                a, b = sorted((owner[i], owner[j]))
                counts[a, b] += 1
                item_a, item_b = (i, j) if owner[i] == a else (j, i)
                listed[a, b].append((-want[i, j], item_a, item_b))
    found, shown = enrich.owner_evidence(frame(spark, matrix, owner=owner), 0.8)
    assert {(r.a, r.b): r.n_evidence for r in found.collect()} == dict(counts)
    got = collections.defaultdict(list)
    for r in shown.orderBy("a", "b", "rank").collect():
        got[r.a, r.b].append((r.item_a, r.item_b))
    assert dict(got) == {k: [(a, b) for _, a, b in sorted(v)[:10]] for k, v in listed.items()}


def test_companies_of_one_description_are_pairs_too(spark):
    matrix = np.array([[1.0, 0.0], [1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [1.0, 0.0]])
    industry = [7, 8, 7, 8, 9]
    pairs, members = enrich.company_pairs(frame(spark, matrix, industry=industry), 0.9)
    alike = {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)}
    assert {(r.a, r.b) for r in enrich.listed(pairs, members).collect()} == alike
    counts = collections.Counter()
    for a, b in alike:
        if industry[a] != industry[b]:
            counts[tuple(sorted((industry[a], industry[b])))] += 1
    assert {(r.a, r.b): r.n_evidence for r in enrich.counted(pairs, members).collect()} == dict(counts)
    pairs, members = enrich.company_pairs(frame(spark, matrix, industry=industry), 0.9, same_group=True)
    assert {(r.a, r.b) for r in enrich.listed(pairs, members, same_group=True).collect()} == {(0, 2)}


def test_vectors_without_clusters_are_sent_to_few_packs(spark, monkeypatch):
    """A vector that can match everywhere leaves Python once, and goes to packs, not to each of many cells."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "CELL", 1)
    matrix = np.random.default_rng(8).normal(size=(900, 24))
    items = vectors.unit_vectors(frame(spark, matrix))
    pivots = vectors._pivots(items, 30)
    homes = vectors._homes(items, pivots, "bigint").withColumn("radius", vectors._radius(0.1))
    block, packs, sizes = vectors._packed(homes, pivots)
    assert sizes.sum() == 900 and sorted(set(packs)) == list(range(len(sizes))) and block == 113
    by_cell = vectors.visits(homes, pivots, "bigint").count()
    by_pack = vectors.visits(homes, pivots, "bigint", packs=packs).count()
    assert by_pack <= 900 * len(sizes) < by_cell
    found = {(r.a, r.b) for r in vectors.similar_pairs(frame(spark, matrix), 0.4).collect()}
    want = cosines(matrix)
    assert found == {(i, j) for i in range(900) for j in range(i + 1, 900) if want[i, j] > 0.4}


def test_a_floor_gives_the_hits_that_sorting_all_gives():
    matrix = clustered(120, 2)
    unit, ids = matrix / np.linalg.norm(matrix, axis=1)[:, None], np.arange(120)
    whole = next(vectors._hits(ids, unit, ids, unit, 3, None, False, "other"))
    least = whole.groupby("q_id")["cos"].min().to_numpy()
    above = next(vectors._hits(ids, unit, ids, unit, 3, None, False, "other", least))
    assert above.reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_rows_without_direction_are_left_out_behind_the_deal(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [])]
    given = spark.createDataFrame(rows, "id long, vec array<double>")
    found = {r.id: r.vec for r in vectors.unit_vectors(given).collect()}
    assert found[1] == [0.6, 0.8] and not {2, 3, 5} & set(found)
    texts = spark.createDataFrame([(1, "a b"), (2, "..")], "id long, text string").repartition(3)
    units = vectors.unit_vectors(hooks.text_vectors(texts)).select("id", F.size("vec"))
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    # Below the deal of the texts nothing is computed.
    assert "Filter" in plan and "Filter" not in plan[plan.index("Repartition") :]
    assert [r.id for r in units.collect()] == [1]
