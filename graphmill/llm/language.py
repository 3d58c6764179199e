"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three letters, word edges marked), most
frequent first. A text belongs to the language whose profile is least out of place: the distance sums,
over the text's own profile, how far each n-gram stands from its rank there; an n-gram that the
language's profile lacks costs the full length.

Profiles are learned from counts over all learning documents, summed by Spark before any ranking.
Only the profiles travel to the tasks: languages times ``SIZE`` entries. Equal counts rank by the
n-gram's letters; equal distances go to the first language in order of name.

Null text and text without letters is ``und`` with score 0, as is every text when nothing could be
learned. Null languages teach nothing. A null id counts as empty text in the split. Rows are judged
each for itself, repeated rows included; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from graphmill.llm.common import slices, text_bytes

SIZE, FOLDS, HELD_OUT = 300, 4, 2
#: More languages than this are taken for a mistake in the column.
LANGUAGES = 2000
UNKNOWN = "und"
#: Stands for the edge of a word; no letter has this code.
EDGE = 1
#: Entries of the counts that a learning task holds before it hands them on.
HELD = 1 << 20


def letters() -> np.ndarray:
    """For each code point its lower case letter, or the edge sign for what is no letter."""
    table = np.full(0x110000, EDGE, np.uint32)
    for code in range(0x110000):
        sign = chr(code)
        if sign.isalpha():
            low = sign.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def gram_counts(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, packed into integers in ascending order, and their counts."""
    signs = table[np.frombuffer(text.decode().encode("utf-32-le"), "<u4")].astype(np.uint64)
    signs = np.concatenate([[np.uint64(EDGE)], signs, [np.uint64(EDGE)]])
    inner = signs != EDGE
    signs = signs[np.concatenate([[True], inner[1:] | inner[:-1]])]  # one edge between words
    inner = signs != EDGE
    if not inner.any():
        return signs[:0], signs[:0]
    two = signs[:-1] << np.uint64(21) | signs[1:]
    three = (two[:-1] << np.uint64(21) | signs[2:])[inner[1:-1]]
    packed = np.sort(np.concatenate([signs[inner], two, three]))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return packed[first], np.diff(np.append(first, len(packed)))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, place = np.unique(grams, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def learned(docs: DataFrame, table: Broadcast, size: int = SIZE) -> dict[str, np.ndarray]:
    """The profile of each language: its n-grams, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(held: dict) -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

        held: dict[str, list] = {}
        entries = 0
        for batch in slices(batches):
            for text, lang in zip(text_bytes(batch), batch.column("lang").to_pylist(), strict=True):
                grams, counts = gram_counts(text, table.value)
                if len(grams):
                    held.setdefault(lang, []).append((grams, counts))
                    entries += len(grams)
                if entries > HELD:
                    held = {k: [_merged(v)] for k, v in held.items()}
                    entries = sum(len(v[0][0]) for v in held.values())
                    if entries > HELD // 2:
                        yield from handed(held)
                        held, entries = {}, 0
        yield from handed(held)

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    totals = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)
    rows = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "gram"))).gram.alias("grams"))
    found = rows.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in sorted(found, key=lambda r: r["lang"])}


class Profiles:
    """The ranks of all known n-grams in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE) -> None:
        self.names, self.size = list(profiles), size
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.rank = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for k, grams in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.known, grams), k] = np.arange(len(grams))

    def judge(self, text: bytes, table: np.ndarray) -> tuple[str, float]:
        grams, counts = gram_counts(text, table)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = grams[np.argsort(-counts, kind="stable")[: self.size]]
        place = np.searchsorted(self.known, own)
        place[place == len(self.known)] = 0
        place[self.known[place] != own] = len(self.known)
        rank = self.rank[place]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.size * len(own)))


def identify(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from those that are not held out."""
    context = docs.sparkSession.sparkContext
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    held_out = fold == HELD_OUT
    table = context.broadcast(letters())
    found = learned(docs.where(~held_out & F.col("lang").isNotNull()), table, size)
    profiles = context.broadcast(Profiles(found, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            judged = [profiles.value.judge(t, table.value) for t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x[0] for x in judged], pa.string()),
                    pa.array([x[1] for x in judged], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    schema = StructType([*rows.schema.fields[:2], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)
