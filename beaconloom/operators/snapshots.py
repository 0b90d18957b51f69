"""Append logs that are compacted: a snapshot of current rows, and the part of the log behind it.

A log is written in segments of consecutive sequence numbers.  Compaction folds what is behind the last snapshot into a new one, in
a folder named by the sequence number that it reaches; a snapshot counts once its job has committed, so one that was
interrupted is never read and is written again.  Snapshots are bucketed by key: reading and folding join them with
the current rows of the tail, and only the tail is shuffled.

Rows are appended in the order of their sequence numbers, as they arrive: one that comes with a number which a snapshot
has already reached is not seen.  Appending a batch again changes nothing.  A row without one of its keys is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconloom.operators.latest import latest
from beaconloom.session import remove

#: Sequence numbers in one segment of a log; rows in one bucket of a snapshot, at about.
SEGMENT_SPAN, BUCKET_ROWS = 1 << 24, 1 << 20
LEAST_BUCKETS = 8


@dataclass
class Snapshot:
    reached: int
    buckets: int
    path: str


class CompactedLog:
    """A log of rows with ``keys`` and a ``seq`` below ``path``; the row of a key with the largest ``seq`` is its current one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], segment_span: int = SEGMENT_SPAN):
        self.spark, self.path, self.keys, self.span = spark, path.rstrip("/"), keys, segment_span
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField("deleted", T.BooleanType()), T.StructField("segment", T.LongType())])

    # writing

    def append(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.schema.names, F.lit(False).alias("deleted")))

    def delete(self, tombstones: DataFrame) -> None:
        """Keys that are gone, each with the ``seq`` of its deletion."""
        named = {*self.keys, "seq"}
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in named]
        self._write(tombstones.select(*self.keys, "seq", *empty).select(*self.schema.names, F.lit(True).alias("deleted")))

    def _write(self, rows: DataFrame) -> None:
        segment = F.floor(F.col("seq") / F.lit(self.span)).cast("long")
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in [*self.keys, "seq"]])
        segment = F.when(missing, F.raise_error(F.lit("a log row needs its keys and seq"))).otherwise(segment)
        rows.withColumn("segment", segment).write.partitionBy("segment").mode("append").parquet(f"{self.path}/log")

    # reading

    def _children(self, folder: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []

    def snapshots(self) -> list[Snapshot]:
        """The committed snapshots, oldest first: their folders' names are all that is listed."""
        found = []
        for name in self._children(f"{self.path}/snapshots"):
            parts = re.fullmatch(r"reached-(\d+)-buckets-(\d+)", name)
            path = f"{self.path}/snapshots/{name}"
            if parts and "_SUCCESS" in self._children(path):
                found.append(Snapshot(int(parts[1]), int(parts[2]), path))
        return sorted(found, key=lambda s: s.reached)

    def _bucketed(self, snapshot: Snapshot) -> DataFrame:
        """The snapshot with its buckets, which the files' names alone do not tell."""
        name = f"snapshot_{hashlib.sha256(snapshot.path.encode()).hexdigest()[:32]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys})"
            f" INTO {snapshot.buckets} BUCKETS LOCATION '{snapshot.path}'"
        )
        return self.spark.table(name)

    def tail(self, reached: int | None, upto: int | None = None) -> DataFrame:
        """The rows behind ``reached``; other segments are not listed, and row groups are skipped by ``seq``."""
        rows = self.spark.read.schema(self.stored).parquet(f"{self.path}/log")
        if reached is not None:
            rows = rows.where((F.col("segment") >= reached // self.span) & (F.col("seq") > reached))
        if upto is not None:
            rows = rows.where((F.col("segment") <= upto // self.span) & (F.col("seq") <= upto))
        return rows.drop("segment")

    def _current(self, snapshot: Snapshot | None, upto: int | None = None) -> DataFrame:
        changed = latest(self.tail(snapshot.reached if snapshot else None, upto), self.keys)
        if snapshot is None:
            return changed.where(~F.col("deleted")).drop("deleted")
        same = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in self.keys])
        both = self._bucketed(snapshot).alias("s").join(changed.alias("t"), same, "full_outer")
        newer = F.col("t.seq").isNotNull()
        columns = [F.when(newer, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in self.schema.names]
        return both.where(~F.coalesce(F.col("t.deleted"), F.lit(False))).select(*columns)

    def read(self) -> DataFrame:
        """The current row of each key that is not deleted."""
        found = self.snapshots()
        return self._current(found[-1] if found else None)

    # compaction

    def compact(self, upto: int | None = None) -> Snapshot | None:
        """Fold the log as far as ``upto`` (all of it, if not given) into a new snapshot; None if nothing is behind the last one."""
        found = self.snapshots()
        last = found[-1] if found else None
        behind = self.tail(last.reached if last else None, upto).agg(F.max("seq").alias("seq"), F.count("*").alias("n")).head()
        if behind["seq"] is None:
            return None
        rows = behind["n"] + (last.buckets * BUCKET_ROWS if last else 0)
        buckets = max(LEAST_BUCKETS, last.buckets if last else 0, -(-rows // BUCKET_ROWS) if not last else 0)
        if last and behind["n"] > last.buckets * BUCKET_ROWS // 2:  # it has outgrown its buckets
            buckets = 2 * last.buckets
        new = Snapshot(behind["seq"], buckets, f"{self.path}/snapshots/reached-{behind['seq']:020d}-buckets-{buckets:06d}")
        name = f"snapshot_{uuid.uuid4().hex}"
        writer = self._current(last, behind["seq"]).repartition(buckets, *self.keys).write.format("parquet").mode("overwrite")
        writer.bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", new.path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalogue's entry, not the files
        return new

    def remove_folded(self) -> None:
        """Delete older snapshots and the segments that the last one holds whole.  Nobody may be reading them any more."""
        found = self.snapshots()
        if not found:
            return
        old = [s.path for s in found[:-1]]
        for name in self._children(f"{self.path}/log"):
            segment = re.fullmatch(r"segment=(-?\d+)", name)
            if segment and (int(segment[1]) + 1) * self.span - 1 <= found[-1].reached:
                old.append(f"{self.path}/log/{name}")
        remove(self.spark, old)
