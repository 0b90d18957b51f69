"""Last-write-wins views over append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``.

    An aggregate, not a window: every task keeps one row per key before the shuffle, so a key with
    a third of the rows costs no more than any other.
    """
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, "last.*").select(*log.columns)


def hostnames_seen(typed: DataFrame) -> DataFrame:
    """Last creation time by arrival, per hostname, as rows for the hostname log.

    Rows whose only fault is a number count too; those whose time cannot be read are passed over, so
    that a host keeps the last time that can.  The condition sits inside the aggregate: as a filter it would be pushed below the
    parse and have every beacon parsed twice.  With a numeric ``seq`` all buffers are of fixed width.
    """
    usable = F.col("reason").isNull() | (F.col("reason") == "bad_number")
    usable = usable & F.col("created_at").isNotNull()
    order = F.when(usable, F.col("seq"))
    return (
        typed.groupBy("hostname")
        .agg(F.max_by("created_at", order).alias("updated_at"), F.max(order).alias("seq"))
        .where("updated_at is not null")
    )


def hostname_registry(log: DataFrame) -> DataFrame:
    """Current row of each hostname."""
    return latest(log, ["hostname"])


def without_deleted(log: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the log that no later tombstone of their key removes."""
    last = tombstones.groupBy(*keys).agg(F.max("seq").alias("deleted_at"))
    gone = [F.col(f"l.{k}") == F.col(f"t.{k}") for k in keys]
    condition = F.col("l.seq") < F.col("t.deleted_at")
    for equal in gone:
        condition = condition & equal
    return log.alias("l").join(last.alias("t"), condition, "left_anti")


def latest_undeleted(log: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """``latest(without_deleted(...))`` in one aggregate and without a join.

    The last write of a key decides; if it is a tombstone, the key is gone.
    """
    marked = log.withColumn("deleted", F.lit(False)).unionByName(
        tombstones.select(*keys, "seq", F.lit(True).alias("deleted")), allowMissingColumns=True
    )
    return latest(marked, keys).where(~F.col("deleted")).drop("deleted")
