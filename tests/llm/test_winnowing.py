import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from graphmill.llm import queries, winnowing
from tests.llm.helpers import docs_of, table

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def turned(x):
    return (x << 7 | x >> 57) & MASK


def chain(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def plain_print(text):
    """Each window for itself: the smallest prefix, of equal ones the rightmost."""
    words = re.findall("[^ \t-\r]{1,40}", text or "")
    if not words:
        return []
    if len(words) < 4:
        return [(chain(words), 0)]
    grams = [turned(chain(words[i : i + 2])) ^ chain(words[i + 2 : i + 4]) for i in range(len(words) - 3)]
    picked = set()
    for i in range(max(1, len(grams) - 15)):
        window = range(i, min(i + 16, len(grams)))
        picked.add(min(window, key=lambda j: (grams[j] >> 33, -j)))
    return [(grams[i], i) for i in sorted(picked)]


def digits(found):
    return ",".join(f"{h:016x}:{p}" for h, p in found)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(i, []).append(t or "")
    order = sorted((i for i in groups if i is not None), reverse=True) + [None] * (None in groups)
    key = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    after = {i: min(groups[j], key=key) for i, j in zip(order, order[1:] + order[:1], strict=True)}
    out = []
    for i, t in rows:
        t, nxt = t or "", after[i]
        third = len(t) // 3
        changed = t[: len(t) - third] + nxt[:third]
        p, e = plain_print(t), plain_print(changed)
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((i, len(t), sha, digits(p), digits(e), alike(p, e), alike(p, plain_print(nxt))))
    return out


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def same(got, wanted):
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=repr) == sorted(wanted, key=repr)


def invented():
    rng = random.Random(4)
    words = ["a", "b", "é", "中文", "𝄞x", "c" * 95, "word", "\x01"]
    rows = []
    for i in range(80):
        n = rng.choice([1, 2, 3, 4, 5, 18, 19, 20, 21, 60, 200])
        rows.append((i * i, "".join(rng.choice(words) + rng.choice([" ", "\t", "\r\n", "  "]) for _ in range(n))))
    rows += [(7, rows[9][1]), (7, "other text of one id"), (7, "other text of one id"), (None, "null id " * 30)]
    rows += [(None, None), (-3, ""), (5, None), (10**12, " \n "), (10**12 + 1, "ab"), (10**12 + 2, "x" * 3000)]
    return rows + rows[3:9]


def test_against_every_window(spark):
    rows = invented()
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "1 as print", "2 as edited", "3 as rep", "4 as bin")
    same(winnowing.compared(docs.repartition(3)), plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a b c d e f"), (None, "g")], [(4, "a b c d e f g h")]])
def test_small_tables(spark, rows):
    same(winnowing.compared(docs_of(spark, rows)), plain(rows))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    same(queries.op12_fingerprints(spark, sf), plain(rows))


def test_shared_runs_share_a_hash(spark):
    rng = random.Random(1)
    run = [str(rng.random()) for _ in range(19)]
    texts = []
    for _ in range(40):
        before, after = ([str(rng.random()) for _ in range(rng.randrange(60))] for _ in range(2))
        texts.append(" ".join(before + run + after))
    prints = docs_of(spark, list(enumerate(texts))).select(winnowing.fingerprint(F.col("text"))["hashes"].alias("h"))
    found = [set(r["h"]) for r in prints.collect()]
    assert all(a & b for a in found for b in found)


def test_no_python_in_the_plan(spark):
    plan = queries.op12_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
