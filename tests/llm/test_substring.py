import hashlib
import random
import re
from collections import Counter

import pytest

from graphmill.llm import substring
from tests.llm.helpers import docs_of, table

SF = "/root/testdata/sf0.001"


def plain(rows, length=35):
    """Kept words of each row, from the counts of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(docs, **kwargs):
    rows = substring.remove_repeats(docs, **kwargs).collect()
    return sorted([(r.keep.doc_id, r.n_words, r.n_removed, r.kept) for r in rows], key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(6))
def test_edited_copies_and_shared_passages(spark, seed):
    """Few different words, copies with edits, passages at ends and starts, periodic texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [[word() for _ in range(rng.randint(5, 40))] for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [word() for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            parts += rng.choice(passages) + [word() for _ in range(rng.randint(0, 6))]
        if i % 7 == 0:
            parts = (["x", "y"] * 30)[: rng.randint(5, 60)]
        if rows and i % 5 == 0:
            parts = rng.choice(rows)[1].split()
            if parts:
                parts[rng.randrange(len(parts))] = word()
        rows.append((i, " ".join(parts)))
    assert found(docs_of(spark, rows).repartition(4), length=12, k=3) == plain(rows, 12)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, "\n "), (4, long), (4, long), (None, long), (5, "a\tb\x0bc"), (6, "z " * 5000), (7, "A " + long.upper())]
    docs = docs_of(spark, rows).selectExpr("*", "1 as k1", "2 as marks", "3 as keep", "4 as kept", "5 as a")
    assert found(docs) == plain(rows)
    texts = substring.without_repeats(docs)
    assert texts.columns == docs.columns
    assert {(r.doc_id, r.text) for r in texts.collect()} >= {(4, ""), (5, "a\tb\x0bc"), (3, "\n "), (1, ""), (7, "A " + long.upper())}


def test_marks_of_a_row_that_occurs_often(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [(None, text)]).selectExpr("doc_id", "text", "explode(sequence(1, 20000)) as x")
    docs = docs.unionByName(docs_of(spark, [(1, "alone " + text[:150])]).selectExpr("*", "0 as x")).repartition(6)
    gathered, marks = [], substring._marks

    def watched(places, paths):
        found = marks(places, paths)
        gathered.append(found.selectExpr("max(size(marks))").first()[0])
        return found

    monkeypatch.setattr(substring, "_marks", watched)
    kept = substring.remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert gathered[0] <= 60 and (60, 60, 20000) in set(map(tuple, kept))


def test_places_with_the_most_frequent_context_are_not_joined_with_its_count(spark, monkeypatch):
    passage = [f"p{i}" for i in range(120)]
    texts = [[f"b{n}x{i}" for i in range(40)] + passage + [f"e{n}x{i}" for i in range(40)] for n in range(200)]
    texts.append(passage[:60] + [f"o{i}" for i in range(40)])
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    joined, kept = [], substring._stored

    def watched(df, name, paths):
        out = kept(df, name, paths)
        if name == "contexts":
            joined.append(out.selectExpr("coalesce(sum(n), 0)").first()[0])
        return out

    monkeypatch.setattr(substring, "_stored", watched)
    assert found(docs_of(spark, rows).repartition(4)) == plain(rows)
    assert joined[0] < 20


def test_empty_table(spark):
    assert found(docs_of(spark, [])) == []


def test_hash_is_of_kept_words(spark):
    from graphmill.llm.queries import query

    rows = {r.doc_id: r for r in query.queries["op7_substring_dedup"](spark, SF).collect()}
    for doc, n, gone, kept in plain([(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]):
        r = rows[doc]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
