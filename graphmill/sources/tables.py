"""Graph, question and result tables on shared storage.

A graph version is a directory of its own with ``nodes`` split by label and ``edges`` split by
relation, so reading one label or relation touches only its files. A job reads one version and
writes another; it never writes to the directory it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.sources.profiles import text_options


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the graph at ``path``. The rebalance hint cuts large labels into several files."""
    nodes.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.hint("rebalance", "rel").write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/edges")


# A null is written as this mark, so that empty text stays empty text.
NULL = {"nullValue": "\\N"}
# Blanks at either end of a text belong to it.
KEPT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_rows(df: DataFrame, path: str) -> None:
    """Question sets and results as delimited text with a header."""
    df.write.mode("overwrite").options(header="true", quote='"', escape='"', **KEPT, **NULL).csv(path)


def read_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(**text_options(multi_line), **KEPT, **NULL).csv(path)
