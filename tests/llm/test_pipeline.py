"""Each stage of the pipeline against plain Python on the rows its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from graphmill.llm.common import write
from graphmill.llm.queries import query
from tests.llm.helpers import table
from tests.llm.test_decontamination import plain as plain_leaks
from tests.llm.test_near_copies import pairs_of
from tests.llm.test_packing import check as check_packing
from tests.llm.test_substring import plain as plain_repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    tables = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        docs = spark.read.parquet(write(stage(spark, docs, SF), name))
        tables.append((name, docs))
    return {name: frame for name, frame in tables}


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == pipeline.COLUMNS


def test_quality_keeps_the_good(spark, stages):
    before, after = texts(stages["documents"]), texts(stages["quality"])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert after.items() <= before.items()
    good, bad = [[i in after for i, q in labels.items() if q == k] for k in (1, 0)]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_near_copies_go(stages):
    before, after = texts(stages["quality"]), texts(stages["near_duplicates"])
    assert after.items() <= before.items()
    near = pairs_of(before)
    apart = [(a, b) for (a, b) in near if a in after and b in after]
    assert len(near) > 50 and len(apart) <= 0.1 * len(near)
    # Whatever goes has a copy that is about as alike as asked for.
    partners = {x for pair in pairs_of(before, 0.65) for x in pair}
    assert before.keys() - after.keys() <= partners


def test_repeats_go(stages):
    before = texts(stages["near_duplicates"])
    wanted = {doc: kept if gone else before[doc] for doc, _, gone, kept in plain_repeats(list(before.items()))}
    frame = stages["repeated_passages"]
    assert texts(frame) == wanted
    assert all(r.n_chars == len(r.text) for r in frame.collect())


def test_leaks_go(spark, stages):
    before = texts(stages["repeated_passages"])
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {doc for doc, stays, _, _ in plain_leaks(list(before.items()), items) if stays}
    assert texts(stages["benchmark_leaks"]) == {doc: before[doc] for doc in kept}


def test_packing_holds_all_ids(stages):
    check_packing(stages["packing"].collect(), list(texts(stages["benchmark_leaks"]).items()), 4096)


def test_run_gives_the_last_stage(spark, stages):
    whole = pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in stages["packing"].collect()}
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in stages["packing"].collect())
    assert query.queries["pipeline"] is pipeline.run


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == pipeline.COLUMNS and docs.count() == 0
    assert pipeline.packed(spark, docs, SF).count() == 0


def test_every_stage_bears_odd_rows(spark):
    good = "the river and the hills of a land are green in spring and it rains on the fields. " * 3
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (None, "x y", "en", "s", 1), (3, "", "", "", 0),
            (4, good + "more words follow here", "en", "s", 5), (5, "w " * 30000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.read.parquet(write(stage(spark, docs, SF), "odd"))
        assert docs.columns == pipeline.COLUMNS
    assert sum(r.length for r in pipeline.packed(spark, docs, SF).collect()) > 0
