"""A keyed table that is updated without being rewritten: upserts, get-or-create and deletes touch only what changes.

Rows lie in buckets by a hash of their key. A batch of changes is reduced to one row per key and written beside the
rows of its buckets as a layer; nothing else is read or written. A bucket is rewritten, alone and in the same batch, once
its layers hold more than ``share`` of its rows or are more than ``DEPTH``; with ``share=0`` every bucket that a batch
touches is rewritten. So the rows written are in proportion to the rows changed, whether few keys change or many.

Nothing is overwritten but a batch's own folder. A small log says for each batch where the buckets it touched begin and
which layers they have, so a batch that failed may run again, and every earlier version can still be read, until
``forget`` deletes what only older versions refer to. The log is written last: readers never see half a batch.

Reading takes buckets without layers as they are. For the others, the keys in their layers are taken out of the base
by an anti-join (few keys, which Spark may broadcast by its own size check) and the newest row of each key added.

* Within a batch the last row in ``order`` wins; a later batch wins over an earlier one, nulls included.
* Null keys are keys like others. Empty batches change nothing. Batches have rising numbers from 1; the build is 0.
* Columns that a batch lacks are null, columns unknown to the table are refused. ``bucket``, ``batch`` and ``gone`` are
  names of the table itself and refused too.

The driver holds one log row per bucket: their number is a parameter of ``build``. A key has one row after reduction,
so no bucket grows by a hot key.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.operators.upsert import last_write
from graphmill.session import exists, stored

BUCKETS, SHARE, DEPTH = 64, 0.25, 8
OWN = ("bucket", "batch", "gone")
LOG = "bucket int, base long, n_base long, layers array<long>, n_layers long"


@dataclass
class KeptTable:
    """A stored table; ``open_table`` reads back what ``build`` was given."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    columns: T.StructType

    def _log(self, until: int | None = None, before: int | None = None) -> dict[int, T.Row]:
        """The state of every bucket that has one, as of a batch."""
        log = self.spark.read.schema(LOG + ", batch long").parquet(f"{self.path}/log")
        if until is not None:
            log = log.where(F.col("batch") <= until)
        if before is not None:
            log = log.where(F.col("batch") < before)
        state = log.groupBy("bucket").agg(F.max_by(F.struct("base", "n_base", "layers", "n_layers"), "batch").alias("s"))
        return {row["bucket"]: row["s"] for row in state.collect()}

    def last_batch(self) -> int:
        log = self.spark.read.schema(LOG + ", batch long").parquet(f"{self.path}/log")
        return log.agg(F.max("batch")).first()[0] or 0

    def _rows(self, places: Iterable[tuple[int, int]]) -> DataFrame:
        """The rows in these (batch, bucket) folders; no other folder is listed."""
        schema = T.StructType([*self.columns, T.StructField("gone", T.BooleanType())])
        schema = schema.add("batch", T.LongType()).add("bucket", T.IntegerType())
        at = [f"{self.path}/rows/batch={batch}/bucket={bucket}" for batch, bucket in places]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*at)

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        keys = others.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = [rows[k].eqNullSafe(keys[f"_{k}"]) for k in self.keys]
        return rows.join(keys, same, "left_anti")

    def _merged(self, state: dict[int, T.Row], fresh: DataFrame | None = None) -> DataFrame:
        """Rows with their bucket as of ``state``, with ``fresh`` (the newest) laid over them."""
        layered = {b for b, s in state.items() if s["layers"]}
        names = [*self.columns.names, "bucket"]
        plain = self._rows((s["base"], b) for b, s in state.items() if s["n_base"] and b not in layered)
        under = self._rows((s["base"], b) for b, s in state.items() if s["n_base"] and b in layered)
        layers = self._rows((layer, b) for b in layered for layer in state[b]["layers"])
        if fresh is not None:
            plain, under = plain.limit(0), plain.unionByName(under)
            layers = layers.unionByName(fresh.withColumn("batch", F.lit(2**62)))
        rest = [c for c in layers.columns if c not in self.keys]
        newest = layers.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*self.keys, "s.*")
        kept = self._without(under, newest).select(*names)
        return plain.select(*names).unionByName(kept).unionByName(newest.where("not gone").select(*names))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows after batch ``version``, by default after the last."""
        return self._merged(self._log(until=version)).drop("bucket")

    def _place(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, batch: int) -> dict[int, int]:
        """Replace the batch's own folder; gives the rows of each bucket."""
        names = [*self.columns.names, "gone", "bucket"]
        at = f"{self.path}/rows/batch={batch}"
        rows.select(*names).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        schema = T.StructType([T.StructField("gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        counts = self.spark.read.schema(schema).parquet(at).groupBy("bucket").count()
        return {row["bucket"]: row["count"] for row in counts.collect()}

    def _note(self, entries: list[tuple], batch: int) -> None:
        log = self.spark.createDataFrame(entries, LOG)
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def _apply(self, fresh: DataFrame, batch: int, share: float, absent_only: bool) -> None:
        last = self.last_batch()
        if batch < 1 or batch < last:
            raise ValueError(f"batch {batch} comes after batch {last}")
        state = self._log(before=batch)
        nothing = T.Row("base", "n_base", "layers", "n_layers")(batch, 0, [], 0)
        fresh = stored(self._place(fresh), "changes")
        if absent_only:
            touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
            known = self._merged({b: s for b, s in state.items() if b in touched})
            fresh = stored(self._without(fresh, known), "absent")
        counts = {r["bucket"]: r["count"] for r in fresh.groupBy("bucket").count().collect()}
        before = {b: state.get(b, nothing) for b in counts}
        full = {
            b: s for b, s in before.items()
            if s["n_layers"] + counts[b] > share * s["n_base"] or len(s["layers"]) >= DEPTH
        }
        in_full = F.col("bucket").isin(list(full))
        merged = self._merged(full, fresh.where(in_full)).withColumn("gone", F.lit(False))
        written = self._write(fresh.where(~in_full).unionByName(merged), batch)
        entries = [
            (b, batch, written.get(b, 0), [], 0) if b in full
            else (b, s["base"], s["n_base"], [*s["layers"], batch], s["n_layers"] + counts[b])
            for b, s in before.items()
        ]
        self._note(entries, batch)

    def _shaped(self, rows: DataFrame) -> DataFrame:
        unknown = set(rows.columns) - set(self.columns.names)
        if unknown:
            raise ValueError(f"columns that the table lacks: {sorted(unknown)}")
        each = [
            (F.col(f"`{c.name}`") if c.name in rows.columns else F.lit(None)).cast(c.dataType).alias(c.name)
            for c in self.columns
        ]
        return rows.select(*each, F.lit(False).alias("gone"))

    def upsert(self, rows: DataFrame, batch: int, order: Sequence[str], share: float = SHARE) -> None:
        """Rows of known keys replace the stored ones, others are added."""
        self._apply(last_write(self._shaped(rows), self.keys, order), batch, share, False)

    def add_absent(self, rows: DataFrame, batch: int, order: Sequence[str], share: float = SHARE) -> None:
        """Get-or-create: only rows of unknown keys are added; the buckets that rows fall in are read."""
        self._apply(last_write(self._shaped(rows), self.keys, order), batch, share, True)

    def remove(self, keys: DataFrame, batch: int, share: float = SHARE) -> None:
        """The rows of these keys go; keys that the table lacks do no harm."""
        gone = self._shaped(keys.select(*self.keys).distinct()).withColumn("gone", F.lit(True))
        self._apply(gone, batch, share, False)

    def forget(self, version: int) -> int:
        """Delete the folders that no version from ``version`` on refers to; gives their number."""
        needed = {(s["base"], b) for b, s in self._log(until=version).items()}
        needed |= {(layer, b) for b, s in self._log(until=version).items() for layer in s["layers"]}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        deleted = 0
        for of_batch in files.listStatus(root):
            number = int(of_batch.getPath().getName().removeprefix("batch="))
            if number > version:
                continue
            for folder in files.listStatus(of_batch.getPath()):
                name = folder.getPath().getName()
                if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in needed:
                    deleted += files.delete(folder.getPath(), True)
        return deleted


def build(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> KeptTable:
    """A new table in the empty or missing folder ``path``, as batch 0; the last row of a key in ``order`` is kept."""
    spark = rows.sparkSession
    if exists(spark, f"{path}/kind"):
        raise ValueError(f"there is a table in {path}")
    clash = set(rows.columns) & set(OWN)
    if clash:
        raise ValueError(f"names of the table itself: {sorted(clash)}")
    kind = T.StructType([T.StructField(c.name, c.dataType) for c in rows.schema])
    table = KeptTable(spark, path, list(keys), buckets, kind)
    counts = table._write(table._place(last_write(rows, keys, order).withColumn("gone", F.lit(False))), 0)
    table._note([(b, 0, n, [], 0) for b, n in counts.items()], 0)
    spark.createDataFrame([(kind.json(), list(keys), buckets)], "kind string, keys array<string>, buckets int").coalesce(
        1
    ).write.parquet(f"{path}/kind")
    return table


def open_table(spark: SparkSession, path: str) -> KeptTable:
    row = spark.read.parquet(f"{path}/kind").first()
    return KeptTable(spark, path, row["keys"], row["buckets"], T.StructType.fromJson(json.loads(row["kind"])))
