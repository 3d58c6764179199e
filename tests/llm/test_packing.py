import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphmill.llm import packing
from graphmill.llm.tokens import ChunkIds
from tests.llm.helpers import docs_of, table

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
CHUNKS = ChunkIds(most=50)


def check(rows, docs, length):
    """Every id lies in exactly one piece, and sequences are gapless and full but for the last."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in docs]
    found, runs = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
        runs[r.sequence_id].append((r.offset, r.length))
    for (doc, _), ids in zip(docs, wanted, strict=True):
        at = 0
        for r in sorted(found[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for n in runs:
        at = 0
        for offset, size in sorted(runs[n]):
            assert offset == at and size > 0
            at += size
        assert at == length or n == max(runs)
    assert sorted(runs) == list(range(len(runs)))


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = packing.pack(docs.repartition(5)).drop("ids").collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], packing.LENGTH)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 400), (4, "<|endoftext|> x<|ENDOFTEXT|>"), (5, "É́ İ ΑΣ  é"), (6, "w" * 5000)]
    rows = packing.pack(docs_of(spark, docs).repartition(3), 64).drop("ids").collect()
    check(rows, docs, 64)


def test_repeated_and_null_ids_and_clashing_names(spark):
    docs = docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 as part", "2 as ids", "3 as base")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n", [8, 5])
def test_sequences_hold_the_ids_in_order(spark, n):
    docs = docs_of(spark, [(i, "a b c") for i in range(n)])
    rows = packing.sequences(packing.pack(docs, 16), 16).orderBy("sequence_id").collect()
    ids = [x for r in rows for x in array("I", bytes(r.ids))[: r.n_ids]]
    encoded = list(array("I", ChunkIds().encode(b"a b c"))) + [2]
    assert ids == encoded * n
    assert all(len(r.ids) in (64, 4 * r.n_ids) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abzABZ éÉßñİıŉǅ.,'s1٣ ́\t\n<|>ſK中Ω"), max_size=30), st.text(max_size=12))
def test_chunks_give_the_ids_of_the_whole_text(text, other):
    for t in (text, other, text + other):
        ids = TOKENIZER.encode(t, add_special_tokens=False).ids
        assert list(array("I", CHUNKS.encode(t.encode("utf-8", "ignore")))) == ids
