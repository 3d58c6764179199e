"""Chains of any length: where the edges of a graph lead, by pointer doubling.

``chain_ends`` follows edges from every node until the first node of a wanted label, over as many steps as it takes.
After round ``r`` the stored table holds, for each start, the ends within ``2 ** r`` steps and the nodes exactly
``2 ** r`` steps away; joining it with itself doubles the reach. A chain of ``n`` steps takes about ``log2(n)``
joins, whose rows are starts times the ways that are still open, not all pairs of nodes.

Cycles: a way that comes back to nodes without an end stays open. No shortest chain has more steps than there are
nodes, so rounds stop there and what is still open has no end. Chains that end nowhere give no row. Repeated edges
count once, edges with a null key or label lead nowhere; where ways of different length lead to one end, the
shortest counts. Other columns of the edges are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import stored

START, AT = ["src_label", "src_key"], ["dst_label", "dst_key"]


def chain_ends(edges: DataFrame, *labels: str) -> DataFrame:
    """Start and end of each chain, and its steps: src_label, src_key, dst_label, dst_key, hops.

    ``edges``: src_label, src_key, dst_label, dst_key. ``labels`` are those a chain may end at; it ends at the first.
    """
    # Dealt by rows, not by bytes: stored ways are small files, which would be read by few tasks.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = edges.select(*START, *AT).dropna().repartition(parts, *START, *AT).distinct()
    steps = steps.withColumn("hops", F.lit(1).cast("long"))
    ways = stored(steps.withColumn("ended", F.col("dst_label").isin(*labels)), "chains")
    most, reach = ways.select(*START).distinct().count(), 1
    ended, opened = F.col("ended"), ~F.col("ended")
    while reach <= most and not ways.where(opened).isEmpty():
        further = ways.select(
            F.col("src_label").alias("_label"), F.col("src_key").alias("_key"),
            F.col("dst_label").alias("_to_label"), F.col("dst_key").alias("_to_key"),
            F.col("hops").alias("_hops"), F.col("ended").alias("_ended"),
        )
        met = (F.col("dst_label") == F.col("_label")) & (F.col("dst_key") == F.col("_key"))
        doubled = ways.where(opened).join(further, met).select(
            *START, F.col("_to_label").alias("dst_label"), F.col("_to_key").alias("dst_key"),
            (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"),
        )
        both = ways.where(ended).unionByName(doubled).repartition(parts, *START, *AT)
        ways = stored(both.groupBy(*START, *AT, "ended").agg(F.min("hops").alias("hops")), "chains")
        reach *= 2
    return ways.where(ended).select(*START, *AT, "hops")
