"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a piece of ``_span`` words of a longer line, with the words that follow
it, one fewer than ``_span``: as many words as the longest template has and a share of others. So a notice is
found on one line, inside a long line and wrapped over lines of any length, with or without blank or
comment signs between them, and words farther apart than two spans are no notice. A template is a notice in known words, and
matches a block that holds at least ``CONTAINMENT`` of its distinct words, in any order. Only words of some template can
match, so blocks are reduced to these. Their corpus-wide counts, taken over all texts, order them
from rare to frequent. Of a template that needs ``a`` words, a matching block must hold one of the
``size - a + 1`` rarest (prefix), must have ``a`` words itself (length), and its first common word
must leave enough words behind it in both orders (position); pairs that pass are verified by
intersection. Rare words are absent from nearly all texts, so nearly all end at the prefix.

The template table is a parameter; what is held on every executor is bounded by it, not by data.
Base labels are phrases whose words stand consecutively, in the whole text.

Null text is empty. Rows are scanned each for itself; repeated rows give repeated results, ids may
be null, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmill.llm.common import write

CONTAINMENT = 0.9
WORD = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A line end with all that is no word behind it.
LINE_END = r"\\n[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of the base labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of common license notices, lower case, without punctuation.
TEMPLATES = (
    ("agpl", "gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
     " that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files to deal in the software without restriction"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "copyright all rights reserved"),
)


def _lowered() -> F.Column:
    """A-Z in lower case and nothing else; ASCII texts take the faster function."""
    text = F.coalesce("text", F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), _lowered().alias("low"))
    return rows.withColumn("words", F.expr(f"regexp_extract_all(low, '{WORD}', 0)"))


def _ordered(docs: DataFrame, known: list[str]) -> dict[str, int]:
    """Template words from rare to frequent in the corpus; as many numbers as the templates have words."""
    held = _words(docs).select(F.explode(F.expr(f"filter(words, w -> w in ({_listed(known)}))")).alias("w"))
    counts = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}


def _starts() -> str:
    """Starts of all base phrases, as structs of start and label."""
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        present = " and ".join(f"array_contains(words, '{p}')" for p in parts)
        there = " and ".join(f"get(words, i + {k}) = '{p}'" if k else f"words[i] = '{p}'" for k, p in enumerate(parts))
        found.append(
            f"if({present}, transform(filter(sequence(0, size(words) - 1), i -> coalesce({there}, false)),"
            f" i -> named_struct('i', i, 'label', '{label}')), array())"
        )
    return f"concat({', '.join(found)})"


def _span(templates, containment: float) -> int:
    """Words in which a notice stands: those of the longest template, and others as far as the containment allows."""
    return math.ceil(max((len(text.split()) for _, text in templates), default=1) / containment)


def _blocks(known: list[str], span: int) -> str:
    """The known words of each piece of a line and of the ``span - 1`` words behind it."""
    ends = r"concat(array(-1), filter(transform(ws, (w, i) -> if(startswith(w, '\n'), i, -1)), i -> i >= 0))"
    # A piece starts behind a line end and behind each span-th word of a line.
    pieces = f"sequence(e, greatest(e, coalesce(get(ends, k + 1), size(ws)) - 2), {span})"
    cuts = f"flatten(get(transform(array({ends}), ends -> transform(ends, (e, k) -> {pieces})), 0))"
    last = "coalesce(get(cuts, k + 1), size(ws))"
    # A line end stands before each of the words behind the piece at most.
    more = rf"filter(slice(ws, {last} + 2, {2 * (span - 1)}), w -> not startswith(w, '\n'))"
    words = f"concat(slice(ws, c + 2, {last} - c), slice({more}, 1, {span - 1}))"
    block = f"array_distinct(filter({words}, w -> w in ({_listed(known)})))"
    blocks = f"get(transform(array({cuts}), cuts -> transform(cuts, (c, k) -> {block})), 0)"
    return f"get(transform(array(regexp_extract_all(low, '{LINE_END}|{WORD}', 0)), ws -> {blocks}), 0)"


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: base places and labels, all labels, and the best containment as score."""
    spark = docs.sparkSession
    sets = [(n, label, sorted(set(text.split()))) for n, (label, text) in enumerate(templates)]
    known = sorted({w for _, _, s in sets for w in s})
    order = _ordered(docs, known)
    prefixes, least = [], 1 << 30
    for n, label, words in sets:
        words.sort(key=order.get)
        need = math.ceil(containment * len(words) - 1e-9)
        least = min(least, need)
        prefixes += [(n, label, words, need, w, i) for i, w in enumerate(words[: len(words) - need + 1])]
    rare = sorted({p[4] for p in prefixes})
    heads = spark.createDataFrame(prefixes, "template int, label string, tokens array<string>, need int, w string, i int")

    # Blocks with a rare word, each as its distinct template words; other texts are done after this step.
    blocks = f"""if(arrays_overlap(words, array({_listed(rare)})),
        array_distinct(filter({_blocks(known, _span(templates, containment))},
        b -> size(b) >= {least} and arrays_overlap(b, array({_listed(rare)})))), array())"""
    rows = _words(docs).select(
        "doc_id",
        "t",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr(_starts()).alias("starts"),
        F.expr(blocks).alias("blocks"),
    )
    rows = spark.read.parquet(write(rows, "license-blocks"))

    ranks = spark.createDataFrame(list(order.items()), "w string, rank int")
    places = rows.where("size(blocks) > 0").select("doc_id", "t", "blocks").distinct()
    places = places.select("doc_id", "t", F.posexplode("blocks").alias("block", "b"))
    tokens = places.select("doc_id", "t", "block", "b", F.explode("b").alias("w")).join(F.broadcast(ranks), "w")
    before = Window.partitionBy("doc_id", "t", "block").orderBy("rank")
    tokens = tokens.withColumn("j", F.row_number().over(before) - 1).withColumn("size", F.size("b"))
    met = tokens.join(F.broadcast(heads), "w").where(
        "size >= need and j <= size - need and 1 + least(size(tokens) - i - 1, size - j - 1) >= need"
    )
    pairs = met.dropDuplicates(["doc_id", "t", "block", "template"])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("b", "tokens"))).where("shared >= need")
    found = pairs.groupBy("doc_id", "t").agg(
        F.collect_set("label").alias("found"), F.max(F.col("shared") / F.size("tokens")).alias("best")
    )
    found = found.select(F.col("doc_id").alias("id"), F.col("t").alias("u"), "found", "best")
    joined = rows.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("u")), "left")
    base = "array_sort(array_distinct(transform(starts, s -> s.label)))"
    return joined.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(starts) as bigint)").alias("n_base"),
        F.expr("cast(array_min(transform(starts, s -> s.i)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(starts, s -> s.i)) as bigint)").alias("last_word"),
        F.expr(f"array_join({base}, ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, coalesce(found, array()))), ',')").alias("labels"),
        F.expr("if(size(starts) > 0, 1.0D, coalesce(best, 0.0D))").alias("score"),
    )


def duckdb_sql(templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """Every block compared with every template."""
    span, known = _span(templates, containment), sorted({w for _, text in templates for w in text.split()})
    rows = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(templates))
    bases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM w WHERE "
        + " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    word, end = (pattern.replace("\\\\", "\\") for pattern in (WORD, LINE_END))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
e AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
w AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM e),
b AS ({bases}),
base AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list_sort(list(DISTINCT label)) AS labels FROM b GROUP BY r),
t AS (SELECT n, label, list_distinct(string_split(words, ' ')) AS tokens FROM (VALUES {rows}) v(n, label, words)),
s AS (SELECT r, regexp_extract_all(low, '{end}|{word}') AS ws FROM e),
n AS (SELECT r, ws, unnest(list_concat([0], [i for i in range(1, len(ws) + 1) if starts_with(ws[i], chr(10))])) AS here FROM s),
p AS (SELECT r, ws, here, lead(here, 1, len(ws) + 1) OVER (PARTITION BY r ORDER BY here) AS upto FROM n),
c AS (SELECT r, ws, upto, unnest(range(here, greatest(here + 1, upto - 1), {span})) AS cut FROM p),
g AS (SELECT r, ws, cut + 1 AS lo, least(cut + {span}, upto - 1) AS hi FROM c),
l AS (SELECT DISTINCT r, list_sort(list_intersect([{_listed(known)}], list_concat(ws[lo:hi],
        ([w for w in ws[hi + 1:hi + {2 * span}] if NOT starts_with(w, chr(10))])[1:{span - 1}]))) AS words FROM g),
m AS (SELECT r, label, len(list_intersect(l.words, t.tokens)) / len(t.tokens) AS held FROM l, t WHERE len(l.words) > 0),
f AS (SELECT r, list(DISTINCT label) AS labels, max(held) AS best FROM m WHERE held >= {containment} - 1e-9 GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
       hi::BIGINT AS last_word, coalesce(list_aggregate(base.labels, 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(f.labels, [])))),
                               'string_agg', ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM e LEFT JOIN base USING (r) LEFT JOIN f USING (r)"""
