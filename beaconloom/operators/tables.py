"""Stored tables: layout, appends, reads and schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.schema import ADDED_IN_V2, EVENT_SCHEMA


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by a costly computed condition without computing it twice.

    A plain filter is pushed below the projection that computes its columns and repeats that work.
    Emitting each row as an array of one row or none keeps the filter above it.
    """
    row = F.when(condition, F.array(F.struct(*df.columns)))
    return df.select(F.explode_outer(row).alias("row")).where("row is not null").select("row.*")


def laid_out(events: DataFrame) -> DataFrame:
    """Rows of a day and host together, sorted as stored.

    ``rebalance`` clusters by day and host, merges small clusters and splits large ones, so a host
    with a third of a day's rows is written by many tasks.  The sort starts with the partition
    column, which is the order the partitioned writer needs anyway.
    """
    return events.hint("rebalance", "event_date", "hostname").sortWithinPartitions(
        "event_date", "hostname"
    )


def write_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the event table, one directory per day.

    With a ``batch``, a name that no other batch of any stream has, it gets directories of its own and
    a replay replaces just these.
    """
    if batch is None:
        laid_out(events).write.partitionBy("event_date").mode("append").parquet(path)
        return
    named = laid_out(events.withColumn("batch_id", F.lit(batch)))
    overwrite_partitions(named, path, ["event_date", "batch_id"])


def overwrite_partitions(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", **options):
    """Replace exactly the partitions that ``df`` has rows for."""
    writer = df.write.partitionBy(*by).mode("overwrite").format(fmt)
    writer.option("partitionOverwriteMode", "dynamic").options(**options).save(path)


def read_events(spark: SparkSession, path: str, schema=EVENT_SCHEMA) -> DataFrame:
    """The event table; columns that older files lack read as NULL."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def upgrade_events(events: DataFrame) -> DataFrame:
    """First-version rows with the columns of the second version as NULL."""
    missing = [f for f in EVENT_SCHEMA.fields if f.name in ADDED_IN_V2 and f.name not in events.columns]
    return events.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def downgrade_events(events: DataFrame) -> DataFrame:
    return events.drop(*ADDED_IN_V2)


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to a log table (hostnames, owners, rejects); replay-safe with the name of a ``batch``."""
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        overwrite_partitions(rows.withColumn("batch_id", F.lit(batch)), path, ["batch_id"])


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)
