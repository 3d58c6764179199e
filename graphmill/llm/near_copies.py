"""Near copies: documents whose five-word shingles are alike to ``SIMILARITY`` or more, found by wide SimHash.

A document's distinct shingles (words between white space, A-Z in lower case; fewer words: all of them) give
``PRINTS`` = 8 independent fingerprints of 64 bits. Documents with equal fingerprints collapse first: equal
shingle sets cost nothing further. The angle between two sets of similarity s is at most
arccos(2s / (1 + s)), and each bit differs with that angle's share of a half turn, so at 0.8 about 78 of 512
bits differ, with a spread of 8.

* Candidates: each of the first ``TABLES`` fingerprints is searched for codes within ``MOST`` = 8 bits, by bit
  patterns and the Gray-order index of ``grayindex``. At 0.8 a pair is met in one of four tables with a chance
  of 0.8, at 0.85 of 0.96, at 0.9 of 0.998.
* A candidate counts if all 512 bits together differ in at most ``LIMIT`` places. That is decided before it is
  linked, so a group's spanning forest holds checked links only and large groups never list their pairs.

Rows are told by hashes of id and text. One row of each component stays: the one with the smallest doc_id, null
last, then the smallest hash; of rows that agree in id and text, the one with the smallest hash of all
columns. Unlike texts of one id are unlike rows; null ids are compared like others. Null, empty and blank texts
are alike. An empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from graphmill.llm.common import drop, grams, mixed, slices, text_bytes, word_hashes, write
from graphmill.llm.components import stars
from graphmill.llm.simhash import close_links

SHINGLE, SIMILARITY = 5, 0.8
PRINTS, TABLES, MOST = 8, 4, 8
#: Differing bits of all fingerprints up to which a pair counts: those expected at SIMILARITY and most of a spread more.
LIMIT = 84
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 13
SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(PRINTS)], np.uint64)


def prints(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a text; zeros for one without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(PRINTS, np.uint64)
    found = np.unique(grams(word_hashes(words), min(shingle, len(words))))
    ones = np.zeros((PRINTS, 64), np.int64)
    for i in range(0, len(found), STEP):
        h = mixed(mixed(found[None, i : i + STEP] ^ SALTS[:, None]))
        bits = np.unpackbits(h.view(np.uint8).reshape(PRINTS, -1, 8), axis=2)
        ones += bits.sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > len(found), axis=1).view(np.uint64)[:, 0]


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """k1, k2, doc_id of every row, its fingerprints ``prints`` and the first ones as numbers f0, f1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([prints(t, shingle) for t in text_bytes(batch)]).reshape(-1, PRINTS)
            whole = pa.array([x.tobytes() for x in found], pa.binary())
            numbers = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(TABLES)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k1", "k2", "doc_id")), whole, *numbers],
                names=["k1", "k2", "doc_id", "prints", *(f"f{i}" for i in range(TABLES))],
            )

    kind = StructField("doc_id", rows.schema["doc_id"].dataType)
    rest = StructType.fromDDL("prints binary, " + ", ".join(f"f{i} long" for i in range(TABLES)))
    schema = StructType([*StructType.fromDDL("k1 long, k2 int").fields, kind, *rest.fields])
    return rows.select("k1", "k2", "doc_id", "text").mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """Row keys, under names that no column of ``docs`` has."""
    return docs.select(
        F.struct(*docs.columns).alias("row"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.hash("text").alias("k2"),
        F.col("doc_id").alias("doc_id"),
        F.col("text").alias("text"),
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """k1, k2 and doc_id of every distinct row, and of the row that stays for its component (r1, r2)."""
    spark = docs.sparkSession
    rows = spark.read.parquet(write(fingerprints(_keyed(docs), shingle), "prints"))
    numbers = [F.first(f"f{i}").alias(f"f{i}") for i in range(TABLES)]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    classes = rows.groupBy("prints").agg(F.min(order).alias("best"), *numbers)
    classes = spark.read.parquet(write(classes.withColumn("id", F.xxhash64("prints")), "classes"))
    found, paths = None, []
    for i in range(TABLES):
        links, used = close_links(classes.select(F.col(f"f{i}").alias("fp"), "id", "prints"), most, limit)
        found = links if found is None else found.unionByName(links)
        paths += used
    roots, _ = stars(found)
    drop(spark, *paths)
    rooted = classes.join(roots.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left")
    rooted = rooted.select("prints", "best", F.coalesce("root", "id").alias("root"))
    best = rooted.groupBy("root").agg(F.min("best").alias("kept"))
    named = rooted.join(best, "root").select("prints", F.col("kept.k1").alias("r1"), F.col("kept.k2").alias("r2"))
    return rows.join(named, "prints").select("k1", "k2", "doc_id", "r1", "r2").distinct()


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """The rows that remain when one document of each component stays, with all their columns."""
    stay = representatives(docs, shingle, most, limit).select(F.col("r1").alias("k1"), F.col("r2").alias("k2")).distinct()
    kept = _keyed(docs).select("row", "k1", "k2").join(stay, ["k1", "k2"], "left_semi")
    first = Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row"))
    kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
