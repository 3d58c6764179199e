from collections import defaultdict

import numpy as np
import pytest
import xxhash

from graphmill.llm import grayindex, simhash
from tests.llm.helpers import docs_of, table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ")]
    words = [w for x in words for w in x.replace("\t", "\n").replace("\r", "\n").replace("\x0c", "\n").split("\n") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(codes, most=3):
    """Smallest index reachable, by comparing all pairs."""
    of = list(range(len(codes)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i:] ^ codes[i]) <= most) + i:
            a, b = sorted((root(i), root(int(j))))
            of[b] = a
    return [root(i) for i in range(len(codes))]


def clustered(rng, n, spread):
    centres = rng.integers(0, 1 << 63, max(1, n // 50), dtype=np.uint64)
    codes = rng.choice(centres, n)
    for _ in range(spread):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(codes)


@pytest.mark.parametrize("spread", [0, 1, 3, 5])
def test_index_gives_the_components_of_all_pairs(spread):
    rng = np.random.default_rng(spread)
    codes = clustered(rng, 1500, spread)
    group = np.zeros(len(codes), int)
    order, x, y = grayindex.links(group, codes, 3)
    assert np.array_equal(np.sort(order), np.arange(len(codes)))
    codes = codes[order]
    labels = grayindex.Labels(len(codes))
    labels.link(x, y)
    assert labels.of.tolist() == plain_components(codes)


def test_groups_are_kept_apart():
    codes = np.array([1, 1, 3, 3, 3], np.uint64)
    order, x, y = grayindex.links(np.array([0, 1, 1, 0, 2]), codes, 3)
    group = np.array([0, 1, 1, 0, 2])[order]
    assert len(x) == 2 and all(group[x] == group[y])


@pytest.mark.parametrize("limit", [1 << 15, 4])
def test_links_through_all_levels(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP", limit)  # small groups force further levels
    codes = clustered(np.random.default_rng(7), 400, 3)
    rows = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links, _ = simhash.close_links(rows)
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    pairs = [(at[r.a], at[r.b]) for r in links.collect()]
    labels = grayindex.Labels(len(codes))
    labels.link(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert labels.of.tolist() == plain_components(codes)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    codes = np.array([plain_fingerprint(t) for _, t in texts], np.uint64)
    for (doc, _), code, first in zip(texts, codes, plain_components(codes), strict=True):
        assert rows[doc].fp % (1 << 64) == int(code)
        assert rows[doc].component_id == texts[first][0]


def test_odd_rows(spark):
    docs = docs_of(spark, [(5, None), (4, ""), (3, " \n\t"), (9, "a b"), (8, "A B"), (7, "a b c d"), (7, "a b c d"), (None, "x y")])
    rows = simhash.near_duplicates(docs.selectExpr("*", "1 as fp", "2 as mask", "3 as root")).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.fp, r.component_id))
    assert len(rows) == 8
    assert got[5] == got[4] == got[3] == {(0, 3)}
    assert {c for _, c in got[9]} == {8} and len(got[7]) == 1 and {c for _, c in got[None]} == {None}


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
