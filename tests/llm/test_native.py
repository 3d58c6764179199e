"""License scans and quality rules against plain Python, on odd rows and on whole tables."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import license_scan, quality_rules
from tests.compare import checker, rows_of
from tests.llm.helpers import docs_of, table

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t ", "a", "All rights reserved", "x all rights\nreserved. ALL RIGHTS RESERVED!", "cc-by cc by cc, by",
    "général public license general public license", "one two three " * 40, "# * $ %\n# * $ %\n\n# * $ %", "É\x0bÀ\x0cb\rc d",
    "line\nline\nline\n" * 30, "the of and " + "w " * 60, "Released under the MIT License.", "license the under mit released x y z",
    "Licensed under the Apache License, Version 2.0.\nmore", "released under the license", "aaa bbb ccc aaa bbb ccc bbb ccc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files"
    " to deal in the software without restriction", "a " * 3000 + "b", "Kelvin K by cc by",
]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def counts_of(spark, texts):
    docs = docs_of(spark, list(enumerate(texts))).selectExpr("*", "1 as words", "2 as n_words", "3 as kept", "4 as lines")
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    return [
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in (rows[i] for i in range(len(texts)))
    ]


def test_counts(spark):
    assert counts_of(spark, TEXTS) == [plain_counts(t) for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\té", max_size=60), min_size=20, max_size=40))
def test_counts_of_any_text(spark, texts):
    assert counts_of(spark, texts) == [plain_counts(t) for t in texts]


def test_clean_prose_is_kept_and_junk_goes(spark):
    clean = ("the river and the " + " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(80)) + " of it. ") * 1
    junk = " ".join(f"w{i}###" for i in range(200))
    rows = quality_rules.judge(docs_of(spark, [(1, clean), (2, junk), (None, clean)])).collect()
    assert {(r.doc_id, r.kept) for r in rows} == {(1, True), (2, False), (None, True)}


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += at
        base |= {label} if at else set()
    for label, template in license_scan.TEMPLATES:
        wanted = set(template.split())
        for line in low.split("\n"):
            held = len(wanted & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))) / len(wanted)
            if held >= license_scan.CONTAINMENT - 1e-9:
                labels.add(label)
                best = max(best, held)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | labels)), 1.0 if starts else best,
    )


def test_licenses(spark):
    docs = docs_of(spark, list(enumerate(TEXTS))).selectExpr("*", "1 as t", "2 as w", "3 as label", "4 as blocks")
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == plain_scan(text), text
    assert rows[13].labels == "mit" and rows[16].labels == ""


def test_repeated_and_null_ids(spark):
    rows = [(1, "cc by 4 0 licensed under"), (1, "cc by 4 0 licensed under"), (1, "x"), (None, "released under the mit license")]
    found = license_scan.scan(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in found) == [(0, "mit"), (1, ""), (1, "cc-by"), (1, "cc-by")]


def test_empty_table(spark):
    assert license_scan.scan(docs_of(spark, [])).count() == 0
    assert quality_rules.judge(docs_of(spark, [])).count() == 0


def test_whole_tables_against_sql(spark):
    con = checker(SF)
    for module, fn in ((license_scan, license_scan.scan), (quality_rules, quality_rules.judge)):
        got = fn(table(spark, SF, "documents"))
        cursor = con.execute(module.duckdb_sql())
        assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_plans_hold_no_python(spark):
    for fn in (license_scan.scan, quality_rules.judge):
        plan = fn(table(spark, SF, "documents"))._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
