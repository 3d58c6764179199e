"""Get-or-create and last-write-wins, as one reduction per key.

Every reduction is a ``groupBy`` whose partial step runs before the shuffle, so a key that holds
a third of all rows reaches its reducer as one row per map task. Logs stay long (one row per
entry); no array grows with the number of entries of an edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["src_label", "src_key", "rel", "dst_label", "dst_key"]


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the properties of the last row in ``order``, nulls included.

    ``order`` must come from the source (a row number, a date with a tie-break), since the
    position of a row in a partition says nothing about the input.
    """
    props = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*props), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def first_write(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the properties of the first row in ``order``."""
    props = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*props), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def upsert_nodes(
    candidates: DataFrame, stored: DataFrame | None, keys: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """Merge candidate nodes into the stored ones; a candidate always wins over a stored row."""
    if stored is not None:
        stored = stored.drop(seq).withColumn(seq, F.lit(-1).cast(candidates.schema[seq].dataType))
        candidates = candidates.unionByName(stored, allowMissingColumns=True)
    return last_write(candidates, keys, [seq])


def upsert_edges(
    candidates: DataFrame, stored: DataFrame | None = None, identity: Sequence[str] = EDGE_KEY
) -> DataFrame:
    """One edge per identity. Add a property to ``identity`` to make it part of the edge."""
    if stored is not None:
        candidates = candidates.unionByName(stored, allowMissingColumns=True)
    return candidates.dropDuplicates(list(identity))


def lookup_table(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A dictionary with unique keys, the last entry of a repeated key kept."""
    kept = df.where(F.col(key).isNotNull()).select(key, *values, *[c for c in order if c not in values])
    return last_write(kept, [key], order).select(key, *values)


def stub_nodes(nodes: DataFrame, edges: DataFrame, label: str = "Company") -> DataFrame:
    """Nodes plus a bare node for each edge target that no node carries yet."""
    targets = (
        edges.where(F.col("dst_label") == label)
        .select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
        .distinct()
    )
    missing = targets.join(nodes, ["label", "key"], "left_anti")
    return nodes.unionByName(missing, allowMissingColumns=True)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; an empty result means the key is unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _met_by(log: DataFrame, new: DataFrame, part: str | None) -> DataFrame:
    """The part of a log that new rows can meet; with ``part`` Spark reads only the folders that occur in them."""
    return log if part is None else log.join(new.select(part).distinct(), part, "left_semi")


def append_absent(
    new: DataFrame,
    log: DataFrame | None,
    edge: Sequence[str],
    fact: str,
    order: Sequence[str],
    part: str | None = None,
) -> DataFrame:
    """Evidence log as long rows: a fact enters an edge once, at its earliest position.

    Entries already in ``log`` stay as they are; only facts the log lacks are added. ``part`` names
    a column that follows from edge and fact, such as a bucket of their hash, by which a stored log
    is split: the comparison then reads only the parts that new rows fall in.
    """
    fresh = first_write(new, [*edge, fact], order)
    if log is None:
        return fresh
    added = fresh.join(_met_by(log, fresh, part).select(*edge, fact), [*edge, fact], "left_anti")
    return log.unionByName(added, allowMissingColumns=True)


def append_events(
    new: DataFrame, log: DataFrame | None, edge: Sequence[str], event: Sequence[str], part: str | None = None
) -> DataFrame:
    """News history as long rows: every event is appended, a rerun of the same event is not.

    ``part`` as in ``append_absent``; the day of an event serves as well.
    """
    fresh = new.dropDuplicates([*edge, *event])
    if log is None:
        return fresh
    added = fresh.join(_met_by(log, fresh, part).select(*edge, *event), [*edge, *event], "left_anti")
    return log.unionByName(added, allowMissingColumns=True)


def log_summary(log: DataFrame, edge: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    """Edge properties that follow from its log.

    ``created`` is the date of the first entry, ``updated`` that of the last one, null while
    there is a single entry.
    """
    position = F.struct(*order)
    return (
        log.groupBy(*edge)
        .agg(
            F.count("*").alias("n_entries"),
            F.min_by(date, position).alias("created"),
            F.max_by(date, position).alias("_last"),
        )
        .withColumn("updated", F.when(F.col("n_entries") > 1, F.col("_last")))
        .drop("_last")
    )
