"""Near-duplicate groups by SimHash fingerprints and a Gray-order hierarchical index.

A fingerprint is computed once per row and written. Equal fingerprints collapse first, so copies
cost nothing further. Two fingerprints within ``most`` differing bits agree on at least one of
``most + 1`` parts of their bits: each fingerprint is dealt to the groups of its masked bit patterns
(mask, pattern), and every group is searched by the index of ``grayindex``. A group that is too
large is not searched; its fingerprints are dealt again on parts of the bits that are still free,
so that groups shrink at every level and the last level's groups are small by the number of free
bits alone. A group gives a spanning forest of its links, never all pairs.

Null or empty text, and text without words, has fingerprint zero and is linked like any other.
Rows with one doc_id each keep their own fingerprint; a component's id is its smallest non-null
doc_id (null where all are null). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphmill.llm.common import drop, slices, text_bytes, write
from graphmill.llm.components import stars
from graphmill.llm.grayindex import links

WORDS, SEED, MOST = 3, 42, 3
#: Fingerprints of one bit pattern that are searched together; larger groups are dealt again.
GROUP = 1 << 15
#: Free bits at which a group is searched whatever it holds.
FEW = 21


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 majority bits over the hashes of all word shingles of a text."""
    found = text.lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-words] + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    step = 1 << 16
    for i in range(0, len(starts), step):
        block = b"".join([digest(whole[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)])
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words, seed) for t in text_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, StructType([narrow.schema["doc_id"], StructField("fp", LongType())]))


def _parts(mask: int, parts: int) -> list[int]:
    """The bits that ``mask`` leaves free, in so many parts, each joined with ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = np.array_split(np.array(free), parts)
    return [mask | sum(1 << int(i) for i in part) for part in cut]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, finer: dict[int, list[int]]) -> DataFrame:
    """The rows once for each finer mask of their mask, with the pattern under it."""
    masks = F.create_map(
        *[x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in f]))]
    )
    others = [c for c in rows.columns if c not in ("mask", "pattern")]
    dealt = rows.select(*others, F.explode(F.element_at(masks, F.col("mask"))).alias("mask"))
    return dealt.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def _search(rows: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """Spanning links (a, b) of the groups; a partition's rows come in order of their group.

    With a ``limit``, rows bear an ``id``, which links name, and ``prints``, which may differ in so many bits.
    """
    names = ["mask", "pattern", "fp"] if limit is None else ["mask", "pattern", "fp", "id"]

    def found(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])]
        more = (others[1], limit) if others else None
        order, x, y = links(np.cumsum(new), fp.view(np.uint64), most, more)
        named = (others[0] if others else fp)[order]
        return pa.RecordBatch.from_arrays([pa.array(named[x]), pa.array(named[y])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            if limit is not None:
                whole = b"".join(batch.column("prints").to_pylist())
                columns.append(np.frombuffer(whole, np.uint64).reshape(batch.num_rows, -1))
            held.append(columns)
            n += batch.num_rows
            if n < GROUP:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            mask, pattern = columns[:2]
            whole = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last group may go on in the next batch
            if cut:
                yield found(*(x[:cut] for x in columns))
            held, n = [[x[cut:] for x in columns]], n - cut
        if n:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return dealt.mapInArrow(run, "a long, b long")


def close_links(codes: DataFrame, most: int = MOST, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct) within ``most`` bits; and paths read.

    With a ``limit``, codes have an ``id``, which links name, and longer fingerprints ``prints``: links
    then connect rows within ``most`` bits of ``fp`` and ``limit`` bits of ``prints``.
    """
    spark = codes.sparkSession
    level = codes.withColumn("mask", F.lit(0).cast("long"))
    finer, found, paths = {0: _parts(0, most + 1)}, [], []
    while finer:
        dealt = _dealt(level, finer)
        masks = [m for f in finer.values() for m in f]
        free = 64 - min(m.bit_count() for m in masks)
        if free <= FEW:
            found.append(_search(dealt, most, limit))
            break
        large = dealt.groupBy("mask", "pattern").count().where(F.col("count") > GROUP).drop("count")
        paths.append(write(large, "large"))
        large = spark.read.parquet(paths[-1])
        if large.isEmpty():
            found.append(_search(dealt, most, limit))
            break
        found.append(_search(dealt.join(large, ["mask", "pattern"], "left_anti"), most, limit))
        level = dealt.join(large, ["mask", "pattern"], "left_semi").drop("pattern")
        finer = {m: _parts(m, most + 1) for m in masks}
    links_ = found[0]
    for more in found[1:]:
        links_ = links_.unionByName(more)
    return links_, paths


def near_duplicates(docs: DataFrame, most: int = MOST, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, ``fp`` and component_id of every row."""
    spark = docs.sparkSession
    rows = spark.read.parquet(write(fingerprints(docs, words, seed), "fingerprints"))
    classes_path = write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    classes = spark.read.parquet(classes_path)
    found, paths = close_links(classes.select("fp"), most)
    roots, _ = stars(found)
    drop(spark, *paths)
    rooted = classes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
