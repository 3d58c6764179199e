import random
from collections import Counter

import numpy as np
import pytest

from graphmill.llm import grayindex, near_copies
from tests.llm.helpers import docs_of, table


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def pairs_of(texts, least=0.8):
    """All pairs of ids whose shingle sets are alike, met over every shingle they share."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    return {(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)}


def invented(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near(rng, words):
    """The words with so many single changes, or so long an addition, that about 0.8 to 0.95 stays alike."""
    words, part = list(words), rng.uniform(0.05, 0.2)
    if rng.random() < 0.5:
        return words + invented(rng, int(part * len(words)))
    for _ in range(int(part * len(words) / 10)):
        words[rng.randrange(len(words))] = "changed"
    return words


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_on_whole_tables(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text")
    wanted = pairs_of({r.doc_id: r.text for r in docs.collect()})
    found = {r.doc_id: (r.r1, r.r2) for r in near_copies.representatives(docs).collect()}
    together = sum(found[a] == found[b] for a, b in wanted)
    print(f"sf{sf}: {together} of {len(wanted)} pairs")
    assert together >= 0.9 * len(wanted) > 0


def test_planted_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    texts = {}
    for i in range(150):
        base = invented(rng, rng.randrange(60, 400))
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join(near(rng, base) if i % 2 else invented(rng, 100))
    kept = {r.doc_id for r in near_copies.keep_one(docs_of(spark, texts.items()).repartition(5)).collect()}
    wanted = pairs_of(texts)
    caught = sum(not {a, b} <= kept for a, b in wanted)
    assert len(wanted) > 60 and caught >= 0.9 * len(wanted)
    assert not set(texts) - kept - {x for p in pairs_of(texts, 0.65) for x in p}


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(invented(rng, 80)) for _ in range(3))
    rows = [(1, a), (1, b), (None, c), (None, c), (None, c.upper()), (7, c), (5, None), (4, ""), (None, " \n"), (1, a)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as k1", "2 as prints", "3 as r1", "4 as row", "rand(1) as x")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (7, c), (4, "")])


def test_large_group_of_copies(spark):
    rng = random.Random(4)
    base = invented(rng, 200)
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(3000)] + [(9999, " ".join(invented(rng, 50)))]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs_of(spark, rows)).collect()) == [0, 9999]


def test_links_heed_the_further_bits():
    rng = np.random.default_rng(1)
    codes = np.repeat(rng.integers(0, 1 << 63, 30, dtype=np.uint64), 20)
    more = rng.integers(0, 1 << 63, (600, 3), dtype=np.uint64)
    more[1::2] = more[::2] ^ np.uint64(7)
    group = np.zeros(600, np.int64)
    order, x, y = grayindex.links(group, codes, 3, (more, 9))
    assert sorted(map(sorted, zip(order[x].tolist(), order[y].tolist(), strict=True))) == [[i, i + 1] for i in range(0, 600, 2)]


def test_empty_table(spark):
    assert near_copies.keep_one(docs_of(spark, [])).count() == 0
