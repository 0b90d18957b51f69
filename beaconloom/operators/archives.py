"""Hour archives and their compaction to day archives."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from beaconloom.functions import maps, texts, urls
from beaconloom.operators.tables import filter_once, overwrite_partitions
from beaconloom.session import exists, materialise, remove, remove_matching
from beaconloom.sources import archives as archive_files
from beaconloom.sources import zst_lines

HOUR_KEYS = ["host", "day", "hour"]
LINES_PER_BLOCK = 1_000_000
TASK_BYTES = 128 << 20

# Codec names; any other name means no compression.
CODECS = {"NONE": "none", "GZIP": "gzip", "Zstandard": "zstd"}


def archive_lines(beacons: DataFrame) -> DataFrame:
    """Beacons with map parameters to archive lines.

    The line is the parameter map as JSON with sorted keys.  Day and hour are those of the arrival.
    ``hostname`` keeps the name that the directory name ``host`` cannot give back.
    """
    if not isinstance(beacons.schema["params"].dataType, T.MapType):
        raise TypeError("the archive keeps all parameters: pass beacons with a parameter map")
    url = maps.parameter(F.col("params"), "u")
    plain = F.col("plain_host")
    lines = (
        beacons.select("params", "received_at", "seq", "unreadable", url.alias("url"))
        .withColumn("plain_host", urls.plain_host(F.col("url")))
        .select(
            urls.hostname(F.col("url"), plain).alias("hostname"),
            F.to_date("received_at").alias("day"),
            texts.hour_of(F.col("received_at")).alias("hour"),
            "seq",
            maps.sorted_json(F.col("params")).alias("value"),
            (F.col("unreadable").isNull() & ~urls.is_bad_url(F.col("url"), plain)).alias("fit"),
        )
    )
    return filter_once(lines, F.col("fit")).select(
        urls.archive_host(F.col("hostname")).alias("host"), "hostname", "day", "hour", "seq", "value"
    )


def _in_ranges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Split the sorted lines into ranges of ``keys``, one task each, of about ``TASK_BYTES``.

    Finding the ranges takes a second look at the rows, so ``lines`` should be a written table.
    """
    size = lines.agg(F.sum(F.octet_length("value"))).head()[0] or 0
    least = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartitionByRange(max(least, -(-size // TASK_BYTES)), *keys).sortWithinPartitions(*keys)


def write_hours(lines: DataFrame, root: str, batch: str) -> None:
    """Write lines to ``host=/day=/hour=/batch=`` directories.

    Ranges of (host, day, hour, seq) go to tasks, so a busy host is split into several files that
    follow each other in name order.  ``batch`` names sort in write order; writing a batch again
    replaces it.
    """
    keys = ["host", "day", "hour", "seq"]
    written: list[str] = []
    ordered = _in_ranges(materialise(lines, "lines", written), keys)
    batches = ordered.select(
        "value", "host", texts.day_name(F.col("day")).alias("day"), "hour", F.lit(batch).alias("batch")
    )
    overwrite_partitions(batches, root, ["host", "day", "hour", "batch"], "text")
    remove(lines.sparkSession, written)


def lines_of_day(spark: SparkSession, root: str, day: date) -> DataFrame | None:
    """Lines of one day's hour files, all hosts; None if there are none.  Other days are not listed."""
    return archive_files.read_hour_files_of_day(spark, root, f"{day.year}-{day.month}-{day.day}")


def hour_ranges(lines: DataFrame) -> DataFrame:
    """First and last line number of every hour that has lines, within the host's day.

    The window runs over hourly counts, 24 rows per host-day at most.
    """
    counts = lines.groupBy(*HOUR_KEYS).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("host", "day").orderBy("hour").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumn("last_line", F.sum("n").over(so_far)).select(
        *HOUR_KEYS, (F.col("last_line") - F.col("n") + 1).alias("first_line"), "last_line"
    )


def with_arrival_block(lines: DataFrame, size: int = LINES_PER_BLOCK) -> DataFrame:
    """Cut a numeric arrival order into blocks of ``size``, which bounds the lines per block."""
    return lines.withColumn("block", F.floor(F.col("seq") / F.lit(size)))


def number_lines(lines: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Line number of every line within its host-day: by hour, then block, then ``seq``.

    ``block`` names the columns that, with the hour, bound and order groups of lines: file and block
    for lines read from files, an arrival block otherwise.  Lines are numbered within a block only;
    a running sum over the block *counts* gives the number each block starts from.  The join uses
    the partitioning of the window, so lines are shuffled once, and no host or hour is one group.
    """
    block = block or ["block"]
    group = [*HOUR_KEYS, *block]
    counts = lines.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("host", "day").orderBy("hour", *block).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*group).orderBy("seq")
    numbered = lines.withColumn("position", F.row_number().over(within))
    return (
        numbered.join(starts, group)
        .withColumn("line_no", F.col("before") + F.col("position"))
        .drop("before", "position")
    )


def codec_of(compression: str) -> str:
    return CODECS.get(compression, "none")


def write_day_files(lines: DataFrame, root: str, compression: str = "NONE", order=("seq",)) -> None:
    """Write the lines of whole host-days in hour order, replacing earlier files of these days.

    A host-day is one file, or several in name order where a range ends inside it.  The text writer
    has no zstd codec, so that choice writes Parquet files with the same rows; ``write_day_lines_zst`` writes text.
    """
    codec = codec_of(compression)
    keys = ["host", "day", "hour", *order]
    ordered = _in_ranges(lines, keys)
    days = ordered.select("value", "host", texts.day_name(F.col("day")).alias("day"))
    overwrite_partitions(
        days, root, ["host", "day"], "parquet" if codec == "zstd" else "text", compression=codec
    )


def write_day_lines_zst(lines: DataFrame, root: str, order=("seq",)) -> None:
    """``write_day_files`` as zstd-compressed JSON lines; read them with ``read_day_lines_zst``."""
    ordered = _in_ranges(lines, ["host", "day", "hour", *order])
    days = ordered.select("host", texts.day_name(F.col("day")).alias("day"), "value")
    zst_lines.register(lines.sparkSession)
    days.write.format(zst_lines.NAME).mode("append").save(root)


def write_hour_ranges(ranges: DataFrame, root: str) -> None:
    """Write ``hour,first,last`` lines, one small file per host-day."""
    text = F.concat_ws(",", "hour", "first_line", "last_line").alias("value")
    ordered = ranges.repartition("host", "day").sortWithinPartitions("host", "day", "hour")
    days = ordered.select(text, "host", texts.day_name(F.col("day")).alias("day"))
    overwrite_partitions(days, root, ["host", "day"], "text")


def compact_day(
    spark: SparkSession, root: str, day: date, day_root: str, meta_root: str, compression: str = "NONE"
) -> None:
    """The daily job: the hour files of one day below ``root`` to day files and line ranges.

    Run again it replaces what it wrote for that day.
    """
    lines = lines_of_day(spark, root, day)
    if lines is not None:
        compact(lines, day_root, meta_root, compression)


def compact(
    lines: DataFrame, day_root: str, meta_root: str, compression: str = "NONE", order=("file", "block", "seq")
) -> None:
    """Day files and line ranges for all host-days in ``lines``, as ``read_hour_files`` gives them.

    Run again after a failure it replaces what it wrote.  Hour files may go once it has returned.
    """
    written: list[str] = []
    lines = materialise(lines, "lines", written)  # for sizes, ranges, files and counts
    write_day_files(lines, day_root, compression, order)
    write_hour_ranges(hour_ranges(lines), meta_root)
    remove(lines.sparkSession, written)


def compact_day_and_remove(
    spark: SparkSession,
    root: str,
    day: date,
    day_root: str,
    meta_root: str,
    compression: str = "NONE",
    between: Callable[[], None] | None = None,
) -> int:
    """``compact_day``, after which the hour files that went into the day files are removed; how many others are left.

    Two phases, with a table of file names as the mark between them.  Until it is committed no hour file is touched, and a job
    that runs again replaces what an interrupted one wrote; once it is, a job that runs again only removes what the mark lists, so
    that lines which arrived since then, and are in no day file, stay.  ``between`` is called when the mark is committed.
    """
    mark = f"{meta_root.rstrip('/')}/_folded/{day.isoformat()}"
    if not exists(spark, f"{mark}/_SUCCESS"):
        lines = lines_of_day(spark, root, day)
        if lines is None:
            return 0
        written: list[str] = []
        lines = materialise(lines, "lines", written)  # what is listed is what is folded, whatever arrives meanwhile
        compact(lines, day_root, meta_root, compression)
        lines.select("file").distinct().write.mode("overwrite").parquet(mark)
        remove(spark, written)
    if between:
        between()
    folded = [row["file"] for row in spark.read.schema("file string").parquet(mark).toLocalIterator()]
    remove(spark, folded)
    left = lines_of_day(spark, root, day)
    count = 0 if left is None else left.select("file").distinct().count()
    if not count:
        remove_matching(spark, archive_files.day_patterns(root, f"{day.year}-{day.month}-{day.day}"))
    return count
