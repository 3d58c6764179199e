"""Deletes, optional matches, orphan checks and counts over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct (label, key) pairs that occur on either side of an edge."""
    sides = F.array(
        F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key")),
        F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")),
    )
    return edges.select(F.explode(sides).alias("_n")).select("_n.*").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Edges between nodes of one label with their ends in key order, each pair once."""
    ends = {"a": F.least("src_key", "dst_key"), "b": F.greatest("src_key", "dst_key")}
    same = edges.where(F.col("src_label") == F.col("dst_label"))
    return same.select(F.col("src_label").alias("label"), "rel", *[c.alias(n) for n, c in ends.items()]).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Nodes of a label without an edge in either direction."""
    return nodes.where(F.col("label") == label).join(endpoints(edges), ["label", "key"], "left_anti")


def delete_orphans(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    alone = orphans(nodes, edges, label).select("label", "key")
    return nodes.join(alone, ["label", "key"], "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """All nodes of a label go, and every edge that touches one.

    The label is part of the edge row, so no join is needed.
    """
    kept = edges.where((F.col("src_label") != label) & (F.col("dst_label") != label))
    return nodes.where(F.col("label") != label), kept


def inferred(keep_extracted: bool = False) -> Column:
    """Condition for inferred edges: an inference source or an evidence log.

    ``keep_extracted`` spares edges that also hold extracted evidence.
    """
    hit = F.coalesce(F.col("source").contains("Inference"), F.lit(False)) | F.col("evidence_log").isNotNull()
    return hit & F.col("evidence").isNull() if keep_extracted else hit


def delete_inferred(edges: DataFrame, keep_extracted: bool = False) -> DataFrame:
    return edges.where(~inferred(keep_extracted))


def drop_properties(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Set node properties to null; the columns stay."""
    return nodes.withColumns({c: F.lit(None).cast(nodes.schema[c].dataType) for c in columns})


def unlinked(news: DataFrame, mentions: DataFrame, key: Sequence[str]) -> DataFrame:
    """News without a link, decided on the distinct linked keys."""
    return news.join(mentions.select(*key).distinct(), list(key), "left_anti")


def edge_provenance(
    edges: DataFrame, relations: Sequence[str] = ("COMPETES_WITH", "PARTNER_WITH")
) -> DataFrame:
    """Edges by origin (extracted only, inferred only, both, neither) with their share, in one pass."""
    has_text, has_log = F.col("evidence").isNotNull(), F.col("evidence_log").isNotNull()
    counted = edges.where(F.col("rel").isin(list(relations))).agg(
        F.count("*").alias("total"),
        F.count_if(has_text & ~has_log).alias("extracted_only"),
        F.count_if(~has_text & has_log).alias("inferred_only"),
        F.count_if(has_text & has_log).alias("both"),
    )
    other = F.col("total") - F.col("extracted_only") - F.col("inferred_only") - F.col("both")
    return (
        counted.withColumn("other", other)
        .select(
            F.expr(
                "stack(5, 'total', total, 'extracted_only', extracted_only, 'inferred_only', inferred_only, "
                "'both', both, 'other', other) as (origin, n)"
            ),
            "total",
        )
        .select("origin", "n", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).alias("pct"))
    )


def run_counters(news: DataFrame, mentions: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many news were linked or skipped and how many links were added."""
    per_news = mentions.groupBy(*key).agg(F.count("*").alias("links"))
    return (
        news.select(*key).distinct().join(per_news, list(key), "left")
        .agg(
            F.count("*").alias("n_news"),
            F.count_if(F.col("links").isNotNull()).alias("n_linked"),
            F.count_if(F.col("links").isNull()).alias("n_skipped"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        )
    )


def optional_match(nodes: DataFrame, edges: DataFrame, rel: str, into: str) -> DataFrame:
    """Each node with the target of its ``rel`` edge, null where it has none."""
    target = edges.where(F.col("rel") == rel).select(
        F.col("src_label").alias("label"), F.col("src_key").alias("key"), F.col("dst_key").alias(into)
    )
    return nodes.join(target, ["label", "key"], "left")


def produced_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Company and product pairs along the produces edges."""
    companies = nodes.where("label = 'Company'").select(F.col("key").alias("src_key"), F.col("name").alias("company"))
    return (
        edges.where("rel = 'PRODUCES'").select("src_key", F.col("dst_key").alias("product"))
        .join(companies, "src_key")
        .select(F.col("src_key").alias("ticker"), "company", "product")
    )


def with_labels(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Nodes of the given labels; with the stored layout this reads only their partitions."""
    return nodes.where(F.col("label").isin(list(labels)))
