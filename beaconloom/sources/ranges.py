"""Address ranges: (ip_start, ip_end, country, city) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.functions.addresses import ip_key
from beaconloom.operators.tables import filter_once

#: Ranges that one task makes blocks of, at most, and from how many on another task is worth its start.
TASK_RANGES, FEW_RANGES = 16 * 1024, 256


def read_ranges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A range table; ``csv`` needs a header line.  Address columns are text, IPv4 or IPv6."""
    if fmt == "csv":
        table = (
            spark.read.schema("ip_start string, ip_end string, country string, city string")
            .option("header", True)
            .csv(path)
        )
    else:
        table = spark.read.format(fmt).load(path)
    return keyed_ranges(table)


def keyed_ranges(table: DataFrame) -> DataFrame:
    """Range ends as address keys; missing places as ``''``.  Unreadable ends give no range.

    A range is a few bytes and becomes up to 960 blocks: ranges are dealt to as many tasks as that takes, however few files hold
    them.  Keys are made once, not again for the filter.
    """
    count = table.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-count // FEW_RANGES)), -(-count // TASK_RANGES))
    empty = F.lit("")
    keyed = table.repartition(tasks).select(
        ip_key(F.col("ip_start")).alias("start_key"),
        ip_key(F.col("ip_end")).alias("end_key"),
        F.coalesce("country", empty).alias("country"),
        F.coalesce("city", empty).alias("city"),
    )
    return filter_once(keyed, F.expr("start_key is not null and end_key >= start_key"))
