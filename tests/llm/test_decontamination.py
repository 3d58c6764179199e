import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import decontamination
from graphmill.llm.tiling import coverage, tiles
from tests.llm.helpers import DOCS, docs_of, table

SF = "/root/testdata/sf0.001"


def plain_tiles(pattern, texts, least):
    """Mark the longest common run, from the left at equal lengths, until none is long enough."""
    done, free = set(), [set() for _ in texts]
    out = []
    while True:
        best = None
        for n, text in enumerate(texts):
            for p in range(len(pattern)):
                for t in range(len(text)):
                    k = 0
                    while (
                        p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k]
                        and p + k not in done and t + k not in free[n]
                    ):
                        k += 1
                    if k >= least and (best is None or (-k, p, n, t) < best):
                        best = (-k, p, n, t)
        if best is None:
            return out
        k, p, n, t = -best[0], *best[1:]
        out.append((k, p, n, t))
        done.update(range(p, p + k))
        free[n].update(range(t, t + k))


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, least=5, share=0.8):
    out = []
    for doc, text in docs:
        held = {}
        grams = {tuple(words(text)[i : i + least]) for i in range(len(words(text)) - least + 1)}
        for item, passage in items:
            p = words(passage)
            if any(tuple(p[i : i + least]) in grams for i in range(len(p) - least + 1)):
                c = sum(t[0] for t in plain_tiles(p, [words(text)], least)) / len(p)
                if c >= share - 1e-9:
                    held[item] = max(c, held.get(item, 0))
        out.append((doc, not held, max(held.values(), default=0.0), sorted(held) or None))
    return sorted(out, key=repr)


def found(docs, items, **kwargs):
    rows = decontamination.judge(docs, items, **kwargs).collect()
    return sorted([(r.doc_id, r.kept, r.coverage, r.item_ids) for r in rows], key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "item_id")


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.lists(st.text("abc", max_size=14), max_size=3), st.integers(1, 3))
def test_tiles_are_the_greedy_ones(pattern, texts, least):
    assert tiles(list(pattern), [list(t) for t in texts], least) == plain_tiles(pattern, texts, least)


def test_reordered_passage_is_covered():
    assert coverage(list("abcdefghij"), [list("fghijxabcde")], 5) == 1.0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = found(docs, items)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(not r[1] for r in got)


@pytest.mark.parametrize("bits", [26, 6])
def test_shuffled_cut_and_mixed_passages(spark, bits):
    """A map of 64 bits lets everything through; the result is the same."""
    rng = random.Random(3)
    word = lambda n=300: f"w{rng.randrange(n)}"
    items = [(i, " ".join(word(300 if i % 2 else 6) for _ in range(rng.randint(3, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = items[rng.randrange(12)][1].split()
        cut = rng.randint(0, len(parts))
        parts = parts[cut:] + [word() for _ in range(rng.randint(0, 3))] + parts[:cut]
        if d % 4 == 0:
            parts[rng.randrange(len(parts))] = "edit"
        docs.append((d, ", ".join([word(6) for _ in range(10)] + parts + [word(6) for _ in range(10)]).upper()))
    assert found(docs_of(spark, docs).repartition(4), items_of(spark, items), bits=bits) == plain(docs, items)


def test_odd_rows(spark):
    passage = "the quick brown fox jumps over the lazy dog again"
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "too short"), (None, "aa bb cc dd ee ff"), (5, "x x x x x x x x")]
    docs = [
        (1, None), (2, ""), (3, passage.upper()), (3, passage.upper()), (None, "Aa-bb.cc dd\nee ff"), (4, "too short"),
        (5, "x " * 3000), (6, "lazy dog again; the quick brown fox jumps over the"),
    ]
    frame = docs_of(spark, docs).selectExpr("*", "1 as item", "2 as k1", "3 as words", "4 as seed")
    rows = sorted((r.doc_id or 0, r.kept, r.item_ids) for r in decontamination.judge(frame, items_of(spark, items)).collect())
    assert rows == [
        (0, False, [None]), (1, True, None), (2, True, None), (3, False, [1]), (3, False, [1]), (4, True, None),
        (5, False, [5]), (6, True, None),
    ]
    kept = decontamination.without_leaks(frame, items_of(spark, items))
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]


def test_empty_tables(spark):
    none, docs = docs_of(spark, []), docs_of(spark, [(1, "a b c d e f")])
    assert found(none, items_of(spark, [(1, "a b c d e f")])) == []
    assert found(docs, items_of(spark, [])) == [(1, True, 0.0, None)]
    assert decontamination.without_leaks(docs, items_of(spark, [])).count() == 1
