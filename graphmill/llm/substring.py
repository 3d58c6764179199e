"""Substring removal by seed and extend on winnowed anchors.

A repeat is a run of ``length`` words that starts in more than one place. Every run of that many
words holds the anchor that winnowing picks in it (the smallest hash among its word grams), and equal
runs hold the same anchor at the same place. So only places of anchors are compared, about one word
in fifteen.

* Seeds: anchors met once in the corpus end there. The others are joined back to their places.
* Extension: the context of a place reaches as far left and right as a run through the anchor can.
  Places of one anchor with equal contexts extend equally far both ways: all of the context repeats,
  and such places are settled by counting, whatever their number. The most frequent context of an anchor is counted
  with the anchor, so only places with a rarer one are joined with the counts of theirs.
* Contexts of an anchor that occur once, and one place for each context that repeats, are extended
  run by run: the runs through the anchor are matched by a 128-bit hash. A run that two places share
  is a repeat; runs that overlap join to maximal repeats.

No pairs of places are formed: a passage that n documents share costs n rows. A row is told by a hash
of its id and text, so ids may be null or repeated, and repeated rows repeat each other; what is found for a row is
gathered as a set, no longer than its text however often the row occurs. Null text
has no words. Texts shorter than ``length`` words keep all of them. Other columns are kept as they are.
An empty table gives no rows. The words a text keeps are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphmill.llm.common import drop, grams, mixed, sliding, slices, text_bytes, word_hashes, write

LENGTH, ANCHOR = 35, 8
BASE = 0xD6E8FEB86659FD93


def anchors(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the winnowed anchors and their hashes; at equal hashes all are taken."""
    g = grams(h, k)
    width = length - k + 1
    least = sliding(g, width)
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(best == g)
    return at, g[at]


class Powers:
    """Powers of an odd base and of its inverse, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            ones = np.ones(size, np.uint64)
            ones[1:] = BASE
            self.up = np.multiply.accumulate(ones)
            ones[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(ones)
        return self.up, self.down


def run_hashes(h: np.ndarray, low: np.ndarray, high: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs h[low:high]."""
    up, down = powers.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h, 0x5851F42D4C957F2D) * up[: len(h)], out=sums[1:])
    return (sums[high] - sums[low]) * down[low]


def _places(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Anchor places: row key, word position, end of the context, hashes of anchor and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            out = []
            for row, text in enumerate(text_bytes(batch)):
                words = text.split()
                n = len(words)
                if n < length:
                    continue
                h = word_hashes(words)
                at, a = anchors(h, length, k)
                low, high = np.maximum(at - (length - k), 0), np.minimum(at + length, n)
                c = run_hashes(h, low, high, powers) + (at - low).astype(np.uint64) * np.uint64(BASE)
                out.append((np.full(len(at), row), at, high, a, mixed(c + (high - low).astype(np.uint64))))
            if not out:
                continue
            row, at, high, a, c = (np.concatenate(x) for x in zip(*out, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(row),
                    batch.column("k2").take(row),
                    pa.array(at.astype(np.int32)),
                    pa.array(high.astype(np.int32)),
                    pa.array(a.view(np.int64)),
                    pa.array(c.view(np.int64)),
                ],
                names=["k1", "k2", "pos", "high", "a", "c"],
            )

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 int, pos int, high int, a long, c long")


def _stored(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    paths.append(write(df, name))
    return df.sparkSession.read.parquet(paths[-1])


def _marks(places: DataFrame, paths: list[str]) -> DataFrame:
    """Per row the places whose anchor repeats: whether all of the context does, and whether to extend by runs.

    What is counted is written before it is joined: adaptive execution can then split a hot anchor's places.
    """
    place = F.xxhash64("k1", "k2", "pos")
    found = places.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    met = found.groupBy("a").agg(F.sum("n").alias("met"), F.count("*").alias("ways"), F.max(F.struct("n", "c", "first")).alias("top"))
    met = met.where("met > 1").select("a", (F.col("ways") == 1).alias("alike"), "top")
    seeds = _stored(places.join(_stored(met, "anchors", paths), "a"), "seeds", paths)
    # Of each anchor the most frequent context is known beside it; where that occurs once, all of them do.
    rest = (F.col("c") != F.col("top.c")) & (F.col("top.n") > 1)
    settled = seeds.where(~rest).select(
        "k1", "k2", "pos", "high", (F.col("top.n") > 1).alias("whole"),
        (~F.col("alike") & ((F.col("top.n") == 1) | (place == F.col("top.first")))).alias("runs"),
    )
    others = seeds.where(rest)
    classes = others.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    told = others.join(_stored(classes, "contexts", paths), ["a", "c"]).select(
        "k1", "k2", "pos", "high", (F.col("n") > 1).alias("whole"), (place == F.col("first")).alias("runs")
    )
    both = settled.unionByName(told)
    return both.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "high", "whole", "runs")).alias("marks"))


def _columns(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
    """The marks of a row as arrays."""
    marks = batch.column("marks")[row].values
    return [marks.field(i).to_numpy(zero_copy_only=False) for i in range(4)]


def _runs(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Row key, start and 128-bit hash of the runs to be matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row, text in enumerate(text_bytes(batch)):
                pos, _, _, runs = _columns(batch, row)
                h = word_hashes(text.split())
                spread = pos[runs][:, None] + np.arange(k - length, 1)[None, :]
                s = np.unique(spread[(spread >= 0) & (spread <= len(h) - length)])
                first, second = grams(h, length), grams(mixed(h, 1), length, BASE)
                out.append((np.full(len(s), row), s, first[s], second[s]))
            if not out:
                continue
            row, s, first, second = (np.concatenate(x) for x in zip(*out, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(row),
                    batch.column("k2").take(row),
                    pa.array(s.astype(np.int32)),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                ],
                names=["k1", "k2", "s", "h1", "h2"],
            )

    return rows.mapInArrow(run, "k1 long, k2 int, s int, h1 long, h2 long")


def _cut(rows: DataFrame, length: int, k: int, keep: StructField, settle: bool) -> DataFrame:
    """The kept words of each row and how many went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            has_marks, has_starts = batch.column("marks").is_valid(), batch.column("starts").is_valid()
            for row, text in enumerate(text_bytes(batch)):
                words = text.split()
                low, high = [np.zeros(0, int)], [np.zeros(0, int)]
                if has_marks[row].as_py():
                    pos, end, whole, _ = _columns(batch, row)
                    low.append(np.maximum(pos[whole] - (length - k), 0))
                    high.append(end[whole])
                if has_starts[row].as_py():
                    s = batch.column("starts")[row].values.to_numpy()
                    low.append(s)
                    high.append(s + length)
                low, high = np.concatenate(low), np.concatenate(high)
                n_words.append(len(words))
                if len(low):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    n_removed.append(len(words) - int(stay.sum()))
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words) if settle or n_removed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("keep"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["keep", "n_words", "n_removed", "kept"],
            )

    numbers = [StructField("n_words", LongType()), StructField("n_removed", LongType())]
    return rows.mapInArrow(run, StructType([keep, *numbers, StructField("kept", StringType())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, settle: bool = True) -> DataFrame:
    """``keep`` (a struct of all columns but text), n_words, n_removed and ``kept``, the text that stays.

    ``settle`` joins the words of every text by one space; without it, texts that lose nothing stay as they were.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*others).alias("keep"),
        "text",
        F.xxhash64("doc_id", "text").alias("k1"),
        F.hash("text").alias("k2"),
    )
    used: list[str] = []
    places = _stored(_places(rows, length, k), "places", used)
    marks = spark.read.parquet(write(_marks(places, used), "marks"))
    drop(spark, *used)
    used = []
    extended = rows.join(marks.where("exists(marks, m -> m.runs)"), ["k1", "k2"])
    runs = _stored(_runs(extended, length, k), "runs", used)
    shared = _stored(runs.groupBy("h1", "h2").count().where("count > 1").drop("count"), "shared", used)
    starts = runs.join(shared, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("s").alias("starts"))
    found = spark.read.parquet(write(marks.join(starts, ["k1", "k2"], "left"), "found"))
    drop(spark, *used)
    ready = rows.join(found, ["k1", "k2"], "left").select("keep", "text", "marks", "starts")
    return _cut(ready, length, k, rows.schema["keep"], settle)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """The same rows and columns with the repeats cut out of their texts; other texts stay as they were, null as empty."""
    found = remove_repeats(docs, length, k, settle=False)
    return found.select(
        *[F.col("kept").alias(c) if c == "text" else F.col("keep")[c].alias(c) for c in docs.columns]
    )
