"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case, so that punctuation and case do not hide a
passage. Seeds are runs of ``least`` words.

* All texts are scanned once. A bit map of fixed size, made from all seeds of the benchmark, lets
  nearly every word of a clean text go; what is left are runs of words all of whose seeds may be the
  benchmark's. Every tile lies in such a run.
* A text that covers enough of an item holds at least ``share * words / least`` of its seeds, hence
  one of the others' rarest (counted over all texts). Only these are joined, so that phrases found
  everywhere form no pairs.
* The runs of each pair are tiled (``tiling``): the item counts as leaked if tiles of ``least`` or more
  words cover ``share`` of its words, in whatever order.

Rows are told by hashes of id and text: repeated rows are judged alike, ids may be null. Null text has
no words; items with fewer than ``least`` words cannot be tiled and leak nowhere. Ties go to the smallest
item id. Empty tables: no documents give no rows, no items keep all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmill.llm.common import grams, slices, text_bytes, word_hashes, write
from graphmill.llm.tiling import coverage

LEAST, SHARE = 5, 0.8
#: Bits of the seed map, as a power of two: 8 MB on every executor whatever the benchmark's size.
BITS = 26
#: Bytes to words: A-Z in lower case, letters, digits and all of UTF-8 beyond ASCII; the rest parts words.
WORDS = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """Key, id, words and seed hashes of each item that can be tiled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in text_bytes(batch)]
            seeds = [grams(word_hashes(w), least).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item"),
                    batch.column("item_id"),
                    pa.array([[w.decode() for w in ws] for ws in words], pa.list_(pa.string())),
                    pa.array(seeds, pa.list_(pa.int64())),
                ],
                names=["item", "item_id", "words", "seeds"],
            )

    rows = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    kind = rows.schema["item_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"item long, item_id {kind}, words array<string>, seeds array<long>")
    return made.where(F.size("words") >= least)


def bit_map(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """The seeds' bits; merged by Spark, as many numbers at most as the map has words."""
    place = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select((place.bitwiseAND(63)).alias("bit"), F.shiftright(place, 6).alias("word"))
    merged = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[merged["word"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def candidate_runs(docs: DataFrame, least: int, shared, bits: int) -> DataFrame:
    """Row key, number, words and seeds of the runs of words whose seeds are in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches):
            words = [words_of(t) for t in text_bytes(batch)]
            ends = np.cumsum([len(w) for w in words])
            words = [w for ws in words for w in ws]
            seeds = grams(word_hashes(words), least)
            place = seeds >> np.uint64(64 - bits)
            at = np.flatnonzero(held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(ends, at, side="right")
            inside = at + least <= ends[row] if len(at) else np.zeros(0, bool)
            at, row = at[inside], row[inside]
            if not len(at):
                continue
            first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(row) > 0)])
            last = np.r_[first[1:], len(at)] - 1
            spans = [(int(a), int(b) + least) for a, b in zip(at[first], at[last], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(row[first])),
                    batch.column("k2").take(pa.array(row[first])),
                    pa.array(at[first] - np.r_[0, ends][row[first]]),
                    pa.array([[w.decode() for w in words[a:b]] for a, b in spans], pa.list_(pa.string())),
                    pa.array([seeds[a : b - least + 1].view(np.int64) for a, b in spans], pa.list_(pa.int64())),
                ],
                names=["k1", "k2", "run", "words", "seeds"],
            )

    made = docs.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 int, run long, words array<string>, seeds array<long>"
    )
    # A run is told by its place in its text, so repeated rows give theirs once.
    return made.dropDuplicates(["k1", "k2", "run"])


def _tiled(pairs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs = batch.column("words").to_pylist(), batch.column("runs").to_pylist()
            covered = [coverage(w, [x["words"] for x in r], least) for w, r in zip(words, runs, strict=True)]
            names = ["k1", "k2", "item_id"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(covered, pa.float64())], names=[*names, "coverage"]
            )

    kind = pairs.schema["item_id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"k1 long, k2 int, item_id {kind}, coverage double")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text").alias("k2"))


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """Row key (k1, k2) of ``keyed`` rows, item_id and coverage of all pairs with enough coverage."""
    spark = docs.sparkSession
    items = spark.read.parquet(write(item_seeds(items, least), "items"))
    held = bit_map(items.select(F.explode("seeds").alias("seed")), bits)
    runs = candidate_runs(docs, least, spark.sparkContext.broadcast(held), bits)
    runs = spark.read.parquet(write(runs, "runs"))

    seen = runs.select("k1", "k2", "run", F.explode("seeds").alias("seed"))
    counts = seen.groupBy("seed").agg(F.count("*").alias("n"))
    size = F.size("words")
    # Seeds of an item from rare to frequent; a leak holds one of the first ones.
    needed = F.ceil(F.lit(share) * size / least - 1e-9)
    order = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "seed")
    rare = items.select("item", F.array_distinct("seeds").alias("seeds"), needed.alias("needed"), size.alias("size"))
    spare = F.col("size") - least + 1 - F.col("needed") + 1
    rare = rare.select("item", spare.alias("spare"), F.explode("seeds").alias("seed")).join(counts, "seed", "left")
    rare = rare.withColumn("nth", F.row_number().over(order)).where("nth <= spare").select("item", "seed")
    pairs = seen.select("k1", "k2", "seed").join(rare, "seed").select("k1", "k2", "item").distinct()
    pairs = spark.read.parquet(write(pairs, "pairs"))

    wanted = pairs.join(items.select("item", F.explode(F.array_distinct("seeds")).alias("seed")), "item")
    parts = wanted.join(seen, ["k1", "k2", "seed"]).select("k1", "k2", "item", "run").distinct()
    parts = parts.join(runs.select("k1", "k2", "run", "words"), ["k1", "k2", "run"])
    grouped = parts.groupBy("k1", "k2", "item").agg(F.sort_array(F.collect_set(F.struct("run", "words"))).alias("runs"))
    ready = grouped.join(items.select("item", "item_id", "words"), "item")
    tiled = _tiled(ready.select("k1", "k2", "item_id", "words", "runs"), least)
    return tiled.where(F.col("coverage") >= share - 1e-9)


def judge(
    docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE, bits: int = BITS
) -> DataFrame:
    """One row per document: kept, the coverage of the item covered best (0 for kept rows), the leaked items."""
    rows = keyed(docs)
    found = leaks(rows, items, least, share, bits)
    found = found.groupBy("k1", "k2", "item_id").agg(F.max("coverage").alias("coverage"))
    found = found.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("item_id"))).item_id.alias("item_ids"), F.max("coverage").alias("coverage")
    )
    joined = rows.drop("text").join(found, ["k1", "k2"], "left")
    return joined.select(
        "doc_id",
        F.col("item_ids").isNull().alias("kept"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        "item_ids",
    )


def without_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows that hold no item of the benchmark, with all their columns."""
    spark = docs.sparkSession
    found = leaks(keyed(docs), items, least, share).select("k1", "k2").distinct()
    found = spark.read.parquet(write(found, "leaks"))
    key = (F.xxhash64(docs["doc_id"], docs["text"]) == found["k1"]) & (F.hash(docs["text"]) == found["k2"])
    return docs.join(found, key, "left_anti")
