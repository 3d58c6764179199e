import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import language
from tests.llm.helpers import table

TABLE = language.letters()
SCHEMA = "doc_id long, text string, lang string"


def plain_grams(text):
    out = Counter()
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for word in re.findall(r"(?:(?![\d_])\w)+", "".join(c if c.isalpha() else " " for c in low)):
        padded = [1, *map(ord, word), 1]
        out.update((x,) for x in padded[1:-1])
        out.update(zip(padded, padded[1:], strict=False))
        out.update(zip(padded, padded[1:], padded[2:], strict=False))
    # The edge behind a word is the one before the next.
    return out


def unpacked(gram):
    return tuple(x for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abAB éÉßñ1_.,\n中İ"), max_size=30))
def test_grams(text):
    grams, counts = language.gram_counts(text.encode(), TABLE)
    assert {unpacked(int(g)): int(n) for g, n in zip(grams, counts, strict=True)} == plain_grams(text)
    assert np.all(np.diff(grams.astype(object)) > 0)


def plain_identify(rows, size):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4
    packed = lambda g: sum(x << 21 * i for i, x in enumerate(reversed(g)))
    ranked = lambda c: sorted(c, key=lambda g: (-c[g], packed(g)))[:size]
    totals = {}
    for d, t, lang in rows:
        if fold(d) != 2 and lang is not None and plain_grams(t or ""):
            totals.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {k: {g: i for i, g in enumerate(ranked(v))} for k, v in sorted(totals.items())}
    out = []
    for d, t, _ in rows:
        own = ranked(plain_grams(t or ""))
        if not own or not profiles:
            out.append((d, fold(d) == 2, "und", 0.0))
            continue
        apart = {k: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(apart, key=lambda k: (apart[k], k))
        out.append((d, fold(d) == 2, best, 1 - apart[best] / (size * len(own))))
    return sorted(out, key=repr)


def found(docs, size=language.SIZE):
    rows = language.identify(docs, size).collect()
    return sorted([(r.doc_id, r.held_out, r.lang_pred, r.score) for r in rows], key=repr)


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(docs) == plain_identify([(r.doc_id, r.text, r.lang) for r in docs.collect()], language.SIZE)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language.identify(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_counts_that_are_handed_on_early_add_up(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    wanted = found(docs, 40)
    monkeypatch.setattr(language, "HELD", 500)
    assert found(docs.repartition(3), 40) == wanted


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?!", "de"), (4, "the and of", "en"), (4, "the and of", "en"),
            (5, "der die das", "de"), (None, "the der", None), (6, "das das", None), (7, "ab " * 5000, "xx")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as held_out", "2 as gram", "3 as n", "4 as score")
    assert found(docs, 20) == plain_identify(rows, 20)


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], SCHEMA)
    assert found(docs) == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    assert found(docs.limit(0)) == []
