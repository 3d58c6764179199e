"""Helpers of the text operators: texts of Arrow batches, word hashes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from graphmill.session import fresh_dir

ODD = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null reads as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hashes with all bits stirred, so that sums of products of them stay well spread."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, k: int, base: int = int(ODD)) -> np.ndarray:
    """Hashes of all runs of k items: a polynomial in ``base``, built by doubling run lengths."""
    if len(h) < k:
        return h[:0]
    base %= 1 << 64
    done, length, block, size = None, 0, h, 1
    while size <= k:
        if k & size:
            if done is None:
                done, length = block, size
            else:
                n = len(h) - length - size + 1
                done = done[:n] * np.uint64(pow(base, size, 1 << 64)) + block[length : length + n]
                length += size
        if size * 2 <= k:
            n = len(block) - size
            block = block[:n] * np.uint64(pow(base, size, 1 << 64)) + block[size : size + n]
        size *= 2
    return mixed(done)


def sliding(a: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Smallest (or largest) value of every window of ``width`` items, by doubling."""
    size = 1
    while size * 2 <= width:
        a, size = pick(a[:-size], a[size:]), size * 2
    rest = width - size
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def write(df: DataFrame, name: str) -> str:
    """Writes the rows to a new table in the shared folder and returns its path."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of text, one row at least, so that what is made of them stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            yield batch.slice(int(a), int(b - a))
