import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import subsequence, toxicity
from tests.llm.helpers import docs_of, table

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def plain_kernel(s, t, gap=subsequence.GAP):
    """Over all pairs of equal subsequences of three letters."""
    total = 0.0
    for a in combinations(range(len(s)), 3):
        for b in combinations(range(len(t)), 3):
            if all(s[i] == t[j] and s[i].isalnum() for i, j in zip(a, b, strict=True)):
                total += gap ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc-", max_size=8), min_size=1, max_size=6), st.text("abc-", min_size=1, max_size=7))
def test_kernel(words, mark):
    alphabet = subsequence.Alphabet("abc")
    got = subsequence.kernels(words, subsequence.marked([mark, "abcab"], alphabet), alphabet)
    for word, k in zip(words, got[:, 0], strict=True):
        norm = (plain_kernel(word, word) * plain_kernel(mark, mark)) ** 0.5
        assert k == pytest.approx(plain_kernel(word, mark) / norm if norm else 0.0)


def test_long_words_are_read_whole():
    alphabet = subsequence.Alphabet("abcdefghijklmnopqrstuvwxyz")
    mark = subsequence.marked(["idiot"], alphabet)
    for at in (0, 30, 500):
        word = ("xyzwv" * 100)[:at] + "idiot" + "yzwvx" * 8
        assert subsequence.kernels([word], mark, alphabet)[0] > 0.05
        assert subsequence.kernels([word.replace("idiot", "bcbcb")], mark, alphabet)[0] == 0


def test_letters_set_apart_are_one_word():
    assert "i d i o t" in toxicity.words_of("You I D I O T there")
    assert toxicity.words_of("a b") == ["a", "b"]


@pytest.fixture(scope="module")
def scored(spark):
    docs = table(spark, SF, "documents")
    # Held-out rows with insults that are broken up, next to the same rows without them.
    ids = [i for i in range(2_000_000, 2_001_000) if zlib.crc32(str(i).encode()) % 5 == 0][:120]
    clean = docs.join(table(spark, SF, "labels").where("toxic = 0"), "doc_id").where("lang = 'en'").orderBy("doc_id")
    texts = [r.text for r in clean.limit(60).collect()]
    rng = random.Random(1)
    broken = ["i.d.i.o.t", "st-up-id", "l o s e r", "mo*ron", "path_etic", "wor.thless", "cl-own", "dis.gusting"]
    rows = []
    for n, text in enumerate(texts):
        words = text.split(" ")
        for word in rng.sample(broken, 4):
            words.insert(rng.randrange(len(words)), word)
        rows += [(ids[2 * n], text), (ids[2 * n + 1], " ".join(words))]
    both = docs.select("doc_id", "text").unionByName(docs_of(spark, rows))
    found = {r.doc_id: r for r in toxicity.score(both, table(spark, SF, "labels")).collect()}
    return found, [r[0] for r in rows[::2]], [r[0] for r in rows[1::2]]


def test_held_out_rows(spark, scored):
    found, _, _ = scored
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [(labels[i], r) for i, r in found.items() if r.held_out and i in labels]
    assert len(held) > 500
    toxic = [r.predicted for y, r in held if y == 1]
    clean = [r.predicted for y, r in held if y == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())


def test_broken_insults(scored):
    found, clean, broken = scored
    assert np.mean([found[i].predicted for i in clean]) < 0.05
    assert np.mean([found[i].predicted for i in broken]) > 0.9


def test_odd_rows(spark):
    bad, good = "you are a pathetic idiot loser. ", "the weather is fine and the river runs. "
    rows = [(i, (bad if i % 3 == 0 else good) * (1 + i % 4)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, bad * 3000), (103, "x" * 100000), (None, bad), (104, bad), (104, bad)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, 0, 0), (5, None, None), (999, 1, 1)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as toxic", "2 as score", "3 as word", "4 as held_out")
    found = toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[102].predicted == by[104].predicted == by[None].predicted == 1
    assert by[100].score == by[101].score and by[100].predicted == 0
    assert len({r.score for r in found if r.doc_id == 104}) == 1


def test_nothing_to_learn(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, None)])
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (2, 1, 0)]):
        found = toxicity.score(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert [r.score for r in found] == [0.0, 0.0]
    assert toxicity.score(docs_of(spark, []), spark.createDataFrame([], LABELS)).count() == 0
