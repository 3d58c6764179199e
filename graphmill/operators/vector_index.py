"""A kept vector index: built once, appended to and cleared by day, read by every search.

Tables below the index folder:

- ``pivots``: vector and shard of each cell. They are chosen when the index is built and stay, so the cell of an
  item never changes. Cells whose pivots lie together share one of at most ``SHARDS`` shards.
- ``items``: id, unit vector and cell, split by day, batch and shard, and sorted by cell within a file.
- ``stale``: versions (id, batch) that a later batch has replaced.
- ``kind``: no rows; the type of the ids.

``append`` places new items only. A batch that runs again replaces its own rows; numbers of batches must rise, and
of an id that comes again the version of the latest batch counts. ``remove_days`` deletes the folders of days;
versions that were replaced before do not come back. ``search`` opens the shards and cells that some query can match
in, and gives the rows that ``vectors.knn`` gives for the same items. A table that has grown far beyond the one its
pivots were chosen from stays right, as large cells are cut into blocks, but prunes less: build it anew from
``read``. ``compact`` joins the small files of many batches.

Items without an id or without a direction (null, empty or zero vectors) are not indexed. Of rows with one id in one
batch, the latest day counts, then the greatest vector. A null day is a day of its own. Other columns are ignored;
an empty table makes an empty index, and its first items choose the pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import vectors
from graphmill.session import exists, stored

SHARDS = 256
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _id_type(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/kind").schema["id"].dataType.simpleString()


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, list[int]]:
    """Pivots and shards by cell: as many as the square root of the items they were chosen from."""
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
    return np.array([r["vec"] for r in rows], dtype="float64"), [r["shard"] for r in rows]


def _choose(items: DataFrame, path: str) -> None:
    """Pivots for these unit vectors."""
    n, _ = vectors._shape(items)
    rows: list[tuple[int, int, list[float]]] = []
    if n:
        pivots = vectors._pivots(items, math.ceil(min(math.sqrt(n), n / vectors.CELL)))
        centres = pivots[:: math.ceil(len(pivots) / SHARDS)]
        shards = (pivots @ centres.T).argmax(axis=1)
        rows = [(c, int(s), v.tolist()) for c, (s, v) in enumerate(zip(shards, pivots, strict=True))]
    table = items.sparkSession.createDataFrame(rows, "cell int, shard int, vec array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def _one_each(items: DataFrame) -> DataFrame:
    """One unit vector for each id."""
    units = vectors.unit_vectors(items.select("id", "vec", F.col("day").cast("string").alias("day")).where("id is not null"))
    last = F.max(F.struct("day", "vec"))
    return units.groupBy("id").agg(last.alias("v")).select("id", "v.vec", "v.day")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions, replaced ones too."""
    schema = f"id {_id_type(spark, path)}, vec array<double>, cell int, day string, batch long, shard int"
    return spark.read.schema(schema).parquet(f"{path}/items")


def _stale(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"id {_id_type(spark, path)}, batch long, `by` long").parquet(f"{path}/stale")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that the rows name."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _write_items(rows: DataFrame, path: str) -> None:
    # The rebalance hint cuts the files of a shard that holds much of a day.
    dealt = rows.hint("rebalance", "day", "shard").sortWithinPartitions("day", "shard", "cell")
    _write(dealt, f"{path}/items", "day", "batch", "shard")


def build(items: DataFrame, path: str) -> str:
    """A new index of ``items`` (id, vec, day) in the empty or missing folder ``path``, as batch 0."""
    if exists(items.sparkSession, f"{path}/kind"):
        raise ValueError(f"there is an index in {path}")
    rows = stored(_one_each(items), "index-items")
    _choose(rows, path)
    items.select("id").limit(0).write.parquet(f"{path}/kind")
    _place(rows, path, 0)
    return path


def _place(rows: DataFrame, path: str, batch: int) -> None:
    spark = rows.sparkSession
    pivots, shards = _cells(spark, path)
    if not len(pivots):
        _choose(rows, path)
        pivots, shards = _cells(spark, path)
    if len(pivots):
        placed = vectors._homes(rows, pivots, _id_type(spark, path), ("day",))
    else:
        placed = rows.withColumn("cell", F.lit(0))
    shard = F.element_at(F.lit(shards or [0]), F.col("cell") + 1).cast("int")
    _write_items(placed.withColumns({"batch": F.lit(batch).cast("long"), "shard": shard}), path)


def append(items: DataFrame, path: str, batch: int) -> None:
    """Add a batch of ``items`` (id, vec, day): only these are placed, and only ids of the others are read."""
    if batch < 1:
        raise ValueError("batch 0 is the build")
    rows = stored(_one_each(items), "index-items")
    spark = rows.sparkSession
    _place(rows, path, batch)
    earlier = _versions(spark, path).where(F.col("batch") < batch).select("id", "batch")
    replaced = earlier.join(rows.select("id"), "id", "left_semi").withColumn("by", F.lit(batch).cast("long"))
    _write(replaced, f"{path}/stale", "by")


def remove_days(spark: SparkSession, path: str, days: Iterable[str | None]) -> int:
    """Delete the items of these days; gives the number of days that were there."""
    names = {f"day={NO_DAY if day is None else day}" for day in days}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/items")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(at) if unquote(f.getPath().getName()) in names]
    for day in found:
        files.delete(day, True)
    return len(found)


def read(spark: SparkSession, path: str, cells: Iterable[int] | None = None) -> DataFrame:
    """The items that count: id, vec, cell, day, batch, shard; of some cells only, if named."""
    items = _versions(spark, path)
    if cells is not None:
        cells, (_, shards) = sorted(set(cells)), _cells(spark, path)
        opened = sorted({shards[c] for c in cells})
        if len(opened) < len(set(shards)):
            items = items.where(F.col("shard").isin(opened))
        if len(cells) < len(shards):
            items = items.where(F.col("cell").isin(cells))
    if exists(spark, f"{path}/stale"):
        stale = _stale(spark, path).select("id", "batch").distinct()
        if not stale.isEmpty():
            items = items.join(stale, ["id", "batch"], "left_anti")
    return items


def search(
    queries: DataFrame, path: str, k: int = 1, floor: float | None = None, *, strict: bool = False,
    scale: str = "index", skip_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest indexed items of each query (id, vec): q_id, i_id, score, rank, as ``vectors.knn`` gives them."""
    spark = queries.sparkSession
    bound, id_type = vectors._bound(floor, scale), _id_type(spark, path)
    pivots, _ = _cells(spark, path)
    if not len(pivots):
        return vectors._ranked(spark.createDataFrame([], vectors.HIT.format(id=id_type)), k, scale)

    def items_in(sizes: DataFrame) -> DataFrame:
        visited = sizes.where("n > 0").select("cell").distinct().collect()
        return read(spark, path, [r["cell"] for r in visited]).select("id", "vec", "cell")

    rule = {"bound": bound, "strict": strict, "k": k, "same": "other" if skip_self else None}
    hits = vectors._visited(vectors.unit_vectors(queries), items_in, pivots, id_type, **rule)
    return vectors._ranked(hits, k, scale)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The items that count in a new folder, with few files for each day; run between batches."""
    last = _versions(spark, path).agg(F.max("batch")).first()[0] or 0
    for name in ("pivots", "kind"):
        spark.read.parquet(f"{path}/{name}").coalesce(1).write.parquet(f"{target}/{name}")
    _write_items(read(spark, path).withColumn("batch", F.lit(last).cast("long")), target)
