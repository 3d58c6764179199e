"""Degrees of nodes kept under change: orphans and counts follow from the changes, the edge table is not read again.

``add`` reduces the edges of a batch to one signed number per end (+1 for an edge that came, -1 for one that went) and
stores these narrow rows by batch; a batch that runs again replaces its own. ``degrees`` sums them. The sums are made on
the map side, so a node that a third of all edges touch reaches its reducer as one row from each task. ``fold`` puts all
batches into one, so reading costs one row per node that ever had an edge and not one per change.

The edges must be real changes: an edge that came was not there, one that went was. An edge that starts and ends at one
node counts twice for it. Null labels and keys are values like others. Empty batches store nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.session import stored


def _ends(edges: DataFrame, sign: int) -> DataFrame:
    sides = F.array(
        F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key")),
        F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")),
    )
    return edges.select(F.explode(sides).alias("n")).select("n.*", F.lit(sign).cast("long").alias("change"))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("label", "key").agg(F.sum("change").alias("change")).where("change <> 0")


def _write(sums: DataFrame, path: str, batch: int) -> None:
    sums.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def add(path: str, batch: int, came: DataFrame | None = None, went: DataFrame | None = None) -> None:
    """Store what a batch of edges that came or went changes; batches have rising numbers from 0."""
    parts = [_ends(edges, sign) for edges, sign in ((came, 1), (went, -1)) if edges is not None]
    if not parts:
        raise ValueError("neither edges that came nor edges that went")
    _write(_summed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), path, batch)


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes since the last fold, that included."""
    changes = spark.read.parquet(path)
    folds = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_folds")
    files = folds.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folds):
        return changes
    last = max(int(f.getPath().getName().removeprefix("until=")) for f in files.listStatus(folds))
    folded = spark.read.parquet(f"{path}/_folds/until={last}")
    return changes.where(F.col("batch") > last).drop("batch").unionByName(folded)


def degrees(spark: SparkSession, path: str) -> DataFrame:
    """label, key and degree of every node that has an edge."""
    return _summed(_changes(spark, path)).withColumnRenamed("change", "degree")


def fold(spark: SparkSession, path: str) -> None:
    """Put the sums of all batches so far beside them; later reads begin there. Folded batches may not run again."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    if last is not None:
        _summed(_changes(spark, path)).write.mode("overwrite").parquet(f"{path}/_folds/until={last}")


def orphans(nodes: DataFrame, path: str, label: str) -> DataFrame:
    """Nodes of a label without an edge in either direction, as ``maintain.orphans`` gives them."""
    linked = degrees(nodes.sparkSession, path).where(F.col("label").eqNullSafe(label)).select("label", "key")
    return nodes.where(F.col("label") == label).join(linked, ["label", "key"], "left_anti")
