import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import periodic, queries
from tests.llm.helpers import docs_of, table


def plain_runs(words, least=6, times=4):
    """All maximal stretches by every period, the smallest period of each kept."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def found(words):
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words] + [len(set(words))], np.int64)
    return [tuple(map(int, r)) for r in periodic.runs_of(ids, np.zeros(len(ids), np.int64))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_any_sequence(words):
    assert found(words) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 3), st.sampled_from([2, 3, 50]))
def test_planted_periods(rng, pieces, letters):
    words = []
    for _ in range(pieces):
        words += [rng.randrange(letters) for _ in range(rng.randrange(30))]
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.3:  # a block that is nearly of a short period
            block = (block[:3] * 40)[: len(block)] + [99]
        length = int(len(block) * rng.uniform(3.5, 7))
        words += (block * 8)[:length]
    assert found(words) == plain_runs(words)


def test_long_run_is_walked_a_few_times():
    words = list(range(20)) * 20_000
    assert found(words) == [(0, 400_000, 20)]


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.int64), np.zeros(9, np.int64), 6, 3)


def plain_row(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(top or (None,) * 3),
        1000 * top[1] // top[2] if top else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_against_every_period(spark, tmp_path):
    rng = random.Random(3)
    near = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    rows = [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 300)))) for i in near]
    rows += [(10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "a"), (10_005, "ab\x0bab ab\nab ab\tab  ab")]
    rows += [(10_006, "ein é中  " * 50), (10_006, "x y " * 30), (10_007, "x y " * 30)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = [plain_row(i, t) for i, t in rows]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(r[1] for r in wanted) > 20


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if len(r["text"]) < 3000:
            assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_odd_tables(spark):
    docs = docs_of(spark, [(None, "a a a a a a b"), (None, "a a a a a a b"), (1, None)])
    docs = docs.selectExpr("doc_id", "text", "1 as runs", "'x' as collapsed", "2 as words")
    got = periodic.collapsed(docs)
    assert got.columns == docs.columns
    assert sorted((r["text"], r["runs"]) for r in got.collect()) == [("", 1), ("a b", 1), ("a b", 1)]
    assert periodic.find_runs(docs.where("false")).count() == 0
