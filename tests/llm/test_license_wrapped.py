"""License notices that are wrapped over lines."""

import random
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from graphmill.llm import license_scan
from tests.llm.helpers import docs_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HEADERS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation',
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
    " with the License. You may obtain a copy of the License at http://example.org",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: one two three",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation, either version 3",
}


def plain(text):
    """Labels by templates alone: every piece of a line and the words behind it against every template."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    span = license_scan._span(license_scan.TEMPLATES, license_scan.CONTAINMENT)
    lines, labels = [re.findall(WORD, x) for x in low.split("\n")], set()
    for k, line in enumerate(lines):
        rest = line + [w for x in lines[k + 1 :] for w in x]
        for start in range(0, max(1, len(line)), span):
            end = min(start + span, len(line))
            block = set(rest[start : end + span - 1])
            for label, template in license_scan.TEMPLATES:
                wanted = set(template.split())
                if len(wanted & block) / len(wanted) >= license_scan.CONTAINMENT - 1e-9:
                    labels.add(label)
    for phrase, label in license_scan.PHRASES:
        labels |= {label} if f" {phrase} " in f" {' '.join(re.findall(WORD, low))} " else set()
    return ",".join(sorted(labels))


@pytest.mark.parametrize("prefix,end", [("", "\n"), (" * ", "\n *\n"), ("# ", "\r\n"), ("", "\n\n")])
def test_wrapped_headers(spark, prefix, end):
    texts, wanted = [], []
    for label, header in HEADERS.items():
        for width in (1, 12, 40, 72, 80):
            wrapped = end.join(prefix + x for x in textwrap.wrap(header, width, break_long_words=False))
            texts.append("import os\nx = 1 # some words before\n\n" + wrapped + "\n\nand some behind")
            wanted.append(label)
    rows = {r.doc_id: r for r in license_scan.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, label in enumerate(wanted):
        assert label in rows[i].labels.split(","), texts[i]
        assert rows[i].score >= license_scan.CONTAINMENT and rows[i].labels == plain(texts[i])


def test_words_far_apart_are_no_notice(spark):
    words = "released under the mit license".split()
    texts = ["\n".join(f"{w}\n" + "x y z\n" * 20 for w in words), "released under\nthe mit\nlicense", "mit\n" + "x " * 32 + "\nreleased under the license"]
    rows = {r.doc_id: r.labels for r in license_scan.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    assert rows == {0: "", 1: "mit", 2: ""}


def checked(spark, texts):
    """Labels by the operator, by the SQL and by plain Python."""
    rows = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    found = con.execute(f"SELECT doc_id, labels, score FROM ({license_scan.duckdb_sql()})").fetchall()
    assert {i: (labels, score) for i, labels, score in found} == rows
    assert [rows[i][0] for i in range(len(texts))] == [plain(t) for t in texts]
    return [rows[i] for i in range(len(texts))]


def test_scattered_words_of_a_long_line_are_no_notice(spark):
    words = "released under the mit license".split()
    notice = " ".join(words)
    far = " ".join(w + " x" * 3000 for w in words)
    inside = [f"{'x ' * n}{notice}{' x' * 3000}" for n in (0, 29, 32, 33, 34, 65, 2999)]
    header = " ".join(HEADERS["bsd"].split())
    inside += [f"{'x ' * n}{header}{' x' * 100}" for n in (0, 7, 20, 33)]
    found = checked(spark, [far, *inside])
    assert found[0] == ("", 0.0)
    assert [labels for labels, _ in found[1:]] == ["mit"] * 7 + ["bsd"] * 4


def test_any_lines(spark):
    rng = random.Random(3)
    known = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    texts = []
    for _ in range(150):
        words = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(12)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([*known[:8], "q"]))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", ".\n# "]) for w in words))
    checked(spark, texts)
