import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import quality_classifier as quality
from tests.llm.helpers import table

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def path():
    return F.concat_ws("/", "source", "lang")


def strength(good, n, parent):
    k, total = len(n), n.sum()
    inner = (n * parent * (1 - parent)).sum() / total
    room = total - (n * n).sum() / total
    between = ((n * (good / n - parent) ** 2).sum() - max(k - 1, 0) * inner) / room if room > 0 else 0
    return min(max(inner / between - 1, 1.0), 1e6) if between > 0 else 1e6


def plain_rates(rows):
    """Posteriors of hosts and paths from (host, path, x), with numpy."""
    x = np.array([r[2] for r in rows])
    rate = (x.sum() + 1) / (len(x) + 2)
    hosts = sorted({r[0] for r in rows})
    of = {h: np.array([r[2] for r in rows if r[0] == h]) for h in hosts}
    n, good = np.array([len(of[h]) for h in hosts]), np.array([of[h].sum() for h in hosts])
    m = strength(good, n, np.full(len(n), rate))
    host_rate = dict(zip(hosts, (good + m * rate) / (n + m), strict=True))
    paths = sorted({r[:2] for r in rows})
    of = {p: np.array([r[2] for r in rows if r[:2] == p]) for p in paths}
    n, good = np.array([len(of[p]) for p in paths]), np.array([of[p].sum() for p in paths])
    parent = np.array([host_rate[p[0]] for p in paths])
    m = strength(good, n, parent)
    return {p: (host_rate[p[0]], r) for p, r in zip(paths, (good + m * parent) / (n + m), strict=True)}, m


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for h in range(12):
        host = rng.beta(4, 2)
        for p in range(rng.integers(1, 5)):
            path = rng.beta(20 * host + 0.1, 20 * (1 - host) + 0.1)
            rows += [(f"h{h}", f"h{h}/{p}", float(rng.random() < path)) for _ in range(rng.integers(1, 60))]
    evidence = spark.createDataFrame(rows, "host string, path string, x double")
    sites, _, m = quality.site_rates(evidence)
    wanted, strength_ = plain_rates(rows)
    assert m == pytest.approx(strength_)
    got = {(r.host, r.path): (r.host_rate, r.path_rate) for r in sites.collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k]) for k in got)


def test_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.col("doc_id") % 5 == 0
    rows = quality.classify(docs, labels.where(~held), F.col("source"), path()).where(held)
    found = rows.join(labels, "doc_id").select("quality", "kept").toPandas()
    assert found.kept[found.quality == 1].mean() > 0.99
    assert found.kept[found.quality == 0].mean() < 0.05


def small():
    clean = "the river and the hills of a land are green in spring and it rains on the fields. "
    junk = "BUY!! NOW!! ### $$$ CHEAP!! %%% "
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, clean + " ".join(words[i % 7 :]) if i % 4 else junk * (2 + i % 3), "en", f"s{i % 3}") for i in range(80)]
    return rows, [(i, int(i % 4 > 0), 0) for i in range(60)]


def test_a_bad_site_lowers_and_a_good_one_raises(spark):
    rows, labels = small()
    twin = rows[1][1]
    rows += [(1000 + i, rows[0][1], "en", "bad") for i in range(200)] + [(2000, twin, "en", "bad"), (2001, twin, "en", "s1")]
    found = quality.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), F.col("source"), path())
    by = {r.doc_id: r for r in found.where("doc_id >= 2000").collect()}
    assert by[2000].evidence == by[2001].evidence and by[2000].score < by[2001].score


def test_odd_rows(spark):
    rows, labels = small()
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, "word " * 50000, "en", ""), (None, rows[1][1], "en", "s1"),
             (1, rows[1][1], "en", "s1"), (103, "é中\x0b", None, "s9")]
    labels += [(None, 1, 0), (5, None, 0), (7, 0, 0), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k1", "2 as host", "3 as path", "4 as n", "5 as quality", "6 as x")
    judged = quality.classify(docs, spark.createDataFrame(labels, LABELS), F.col("source"), path())
    found = judged.collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    assert sum(r.kept for r in found if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 4) == 61
    kept = quality.only_kept(docs, judged)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], SCHEMA)
    for labels in ([], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]):
        found = quality.classify(docs, spark.createDataFrame(labels, LABELS), F.col("source"), path()).collect()
        assert [(r.evidence, r.kept) for r in found] == [(0.5, True)] * 2
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(docs.limit(0), none, F.col("source"), path()).count() == 0
