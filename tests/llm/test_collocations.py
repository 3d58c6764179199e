import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from graphmill.llm import collocations, queries
from graphmill.llm.substring import Powers
from tests.compare import checker, differences

SCHEMA = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top=2000):
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for n in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inner[p[i : i + n]] = max(a, inner.get(p[i : i + n], 0))
        ranked = []
        for p, a in found.items():
            if inner.get(p, 0) >= a:
                continue
            cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(got):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.select(*names).collect()))


def invented(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "é", "中", "x", "\x01", "y-y", "b", "c", "d'"]
    signs = [" ", " ", " ", "  ", "\t", ". ", "\r\n", ",", " \x0b"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(120)))
        out.append((rng.choice([i, None]), text + rng.choice(["", " new YORK city ", " a b c d e f"]), rng.choice(["en", "fr", None, "und"])))
    return [*out, (1, None, "en"), (2, "", None), (3, " \n", "xx"), *out[:9]]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (20, 7)])
def test_against_counting_everything(spark, least, top):
    rows = invented(least, 60)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1))
    got = rows_of(collocations.collocations(docs.repartition(3), least=least, top=top))
    assert got == plain(rows, least, top) and len(got) > 5


def test_full_map_changes_nothing(spark):
    rows = invented(5, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(collocations.collocations(docs, least=4, bits=8)) == plain(rows, 4)


def test_colliding_fingerprints_are_told_by_their_words():
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": ["x y x y z", "x y", "y z"]})
    part = collocations.Slice(batch, Powers())
    part.number()
    at = part.starts(2)
    places, counts = collocations.alike_runs(part, at, np.zeros(len(at), np.uint64), 2)
    found = Counter()
    for p, n in zip(places.tolist(), counts.tolist(), strict=True):
        found[part.langs[part.row[p]], *part.words[p : p + 2]] += n
    assert found == {
        (b"a", b"x", b"y"): 2,
        (b"a", b"y", b"x"): 1,
        (b"a", b"y", b"z"): 2,
        (b"b", b"x", b"y"): 1,
    }


def test_products_beyond_64_bits(spark, monkeypatch):
    many = 4_000_000_000
    found = [("en", None, 3 * many, 1), ("en", "a", many, 1), ("en", "b", many + 7, 1), ("en", "a b", many - 9, 1)]
    table = spark.createDataFrame(found, "lang string, phrase string, n long, doc_id long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: table)
    score = 1000 * (many - 9) * 3 * many // (many * (many + 7))
    assert rows_of(collocations.collocations(table)) == [("en", 1, "a b", many - 9, many, many + 7, 3 * many, score)]


def test_empty_table(spark):
    assert rows_of(collocations.collocations(spark.createDataFrame([], SCHEMA))) == []


def test_sql_on_repeated_rows(spark, tmp_path):
    rows = invented(8, 30) * 12
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = checker("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = collocations.duckdb_sql()
    assert differences(spark, con, queries.op13_collocations, sql, str(tmp_path)) is None
    assert rows_of(queries.op13_collocations(spark, str(tmp_path))) == plain(rows, 100)


class Recorded:
    """Stands for a table: keeps the function of its scan instead of running it."""

    schema = {"doc_id": StructField("doc_id", LongType())}

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_last_scan_holds_one_slice(monkeypatch):
    monkeypatch.setattr(collocations, "SCANNED", 64)
    full = SimpleNamespace(value=np.full(1 << 4, np.iinfo(np.uint64).max, np.uint64))
    texts = [f"a b c{i} d" * 4 for i in range(40)]
    read = []

    def batches():
        for i in range(0, 40, 4):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"doc_id": [*range(i, i + 4)], "lang": ["en"] * 4, "text": texts[i : i + 4]})

    sums, seen = Counter(), set()
    for out in collocations._phrases(Recorded(), 2, full)(batches()):
        seen.add(len(read))
        for row in out.to_pylist():
            sums[row["lang"], row["phrase"]] += row["n"]
    assert seen == set(range(1, 11))
    assert sums["en", None] == sum(len(t.split()) for t in texts)
    assert sums["en", "a b"] == 40 and sums["en", "b c7"] == 4
