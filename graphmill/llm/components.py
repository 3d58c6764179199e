"""Connected components of an edge table, without gathering it anywhere.

Edges become stars around the smallest node of their component: large steps link every larger
neighbour of a node to the node's smallest one, small steps do so for smaller neighbours, until
nothing changes. Both are a minimum per node, which is reduced before the shuffle, and a join that
adaptive execution splits where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import drop, write


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    others = linked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
    return tuple(row)


def stars(edges: DataFrame) -> tuple[DataFrame, str]:
    """``a`` and the smallest node ``b`` of its component, for every node but the smallest; and the table's path.

    ``edges`` has comparable columns ``a`` and ``b``; repeated edges and loops do no harm.
    """
    spark = edges.sparkSession
    oriented = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    path = write(oriented.distinct(), "edges")
    state = _state(spark.read.parquet(path))
    while state[0]:
        step = _small(_large(spark.read.parquet(path)).distinct()).distinct()
        following = write(step, "edges")
        drop(spark, path)
        path, before = following, state
        state = _state(spark.read.parquet(path))
        if state == before:
            break
    return spark.read.parquet(path), path
