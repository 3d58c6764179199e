"""Packing by concatenate and cut.

Pass one tokenises every partition of the input and writes it with running counts, so that the
order of all tokens is fixed by what is on storage and survives lost executors. Prefix sums over
the partitions' totals, one number each, give every document its place in the one long run of
tokens. Pass two cuts that run into windows of equal size; a document that crosses a window's end
becomes several pieces. No row moves: there is neither a sort nor a shuffle of tokens.

Null text is empty text: the end token alone. Rows with one doc_id are packed each for itself,
doc_id may be null or of any type, other columns are ignored, an empty table gives no pieces. Only
the last sequence is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from graphmill.llm.common import slices, text_bytes, write
from graphmill.llm.tokens import ChunkIds

LENGTH, END = 4096, 2
#: Partitions whose totals are summed together on the lower of two levels.
BLOCK = 1024


def tokenized(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """``part``, ``start`` (tokens before it in its partition), doc_id, ``n`` and ``ids`` of each row."""
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, known = TaskContext.get().partitionId(), 0, ChunkIds(vocabulary)
        for batch in slices(batches):
            ids = [known.encode(text) + last for text in text_bytes(batch)]
            starts = []
            for x in ids:
                starts.append(start)
                start += len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["part", "start", "doc_id", "n", "ids"],
            )

    narrow = docs.select("doc_id", "text")
    schema = StructType(
        [
            StructField("part", IntegerType()),
            StructField("start", LongType()),
            narrow.schema["doc_id"],
            StructField("n", LongType()),
            StructField("ids", BinaryType()),
        ]
    )
    return narrow.mapInArrow(run, schema)


def part_bases(tokens: DataFrame) -> DataFrame:
    """``part`` and the tokens before it: prefix sums within blocks of partitions, then over blocks."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    totals = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_base"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(blocks, "block").select("part", (F.col("block_base") + F.col("inside")).alias("base"))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids."""
    spark = docs.sparkSession
    tokens = spark.read.parquet(write(tokenized(docs, vocabulary, end), "tokens"))
    # One row per input partition; written, so that Spark knows its size when it picks the join.
    bases = spark.read.parquet(write(part_bases(tokens), "bases"))
    placed = tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("start"))
    placed = placed.withColumn("first", F.expr(f"at div {length}"))
    placed = placed.withColumn("last", F.expr(f"(at + n - 1) div {length}"))
    # The piece in window w: from max(at, w * length) to min(at + n, (w + 1) * length).
    piece = f"""transform(sequence(first, last), w -> named_struct(
        'sequence_id', w,
        'start', greatest(at, w * {length}) - at,
        'length', least(at + n, (w + 1) * {length}) - greatest(at, w * {length}),
        'offset', greatest(at, w * {length}) - w * {length}))"""
    cut = f"""transform({piece}, p -> named_struct('p', p,
        'ids', substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))))"""
    pieces = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.expr(cut)).alias("x"))
    return pieces.select(
        "doc_id",
        F.col("x.p.start").alias("start"),
        F.col("x.p.length").alias("length"),
        F.crc32("x.ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("x.p.sequence_id").alias("sequence_id"),
        F.col("x.p.offset").alias("offset"),
        F.col("x.ids").alias("ids"),
    )


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The packed rows: sequence_id, n_ids and ``ids``, padded unless n_ids is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"),
        F.expr("transform(sort_array(collect_list(struct(offset, ids))), x -> x.ids)").alias("parts"),
    )
    filler = pad.to_bytes(4, "little") * length
    joined = F.expr("aggregate(parts, cast('' as binary), (a, b) -> concat(a, b))")
    short = (F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) != 0) & (F.col("n_ids") < length)
    fill = F.when(short, F.substring(F.lit(filler), F.lit(1), ((length - F.col("n_ids")) * 4).cast("int")))
    return whole.select(
        "sequence_id", "n_ids", F.concat(joined, F.coalesce(fill, F.lit(b""))).alias("ids")
    )
