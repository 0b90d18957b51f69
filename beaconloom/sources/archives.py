"""Archive files: hour files, day files and their line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.session import matching
from beaconloom.sources import zst_lines

# Two layouts: <host>/<yyyy-M-d>/<H>.json.lines and host=<host>/day=<yyyy-M-d>/hour=<H>/<part>, with a folder
# batch=<B> above the part if a stream writes its batches by name.
HOUR_PATH = (
    r"/(?:host=)?([^/]*)/(?:day=)?([0-9]+-[0-9]+-[0-9]+)/"
    r"(?:hour=)?([0-9]+)(?:\.json\.lines(?:\.gz|\.zst)?|(?:/batch=[^/]+)?/[^/]+)$"
)
EMPTY_HOST = "__HIVE_DEFAULT_PARTITION__"


def read_hour_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of hour files: host, day, hour, value, and their place (file, block, seq).

    Host, day and hour come from the path.  Lines of one block share (file, block), which bounds
    any work done per block; ``seq`` orders the lines within it.  The root of an archive that a file sink
    writes is read through the sink's log of commits: files of an unfinished batch are not seen.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    place = lambda group: F.regexp_extract(path, HOUR_PATH, group)
    decode = lambda text: F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    path = decode(F.col("_metadata.file_path"))
    # Partition directories escape special characters of the value once more.
    host = F.when(path.contains("/host="), decode(place(1))).otherwise(place(1))
    placed = lines.select(
        "value",
        path.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.when(host == EMPTY_HOST, "").otherwise(host).alias("host"),
        place(2).alias("day_name"),
        place(3).alias("hour"),
    )
    return placed.where("hour != ''").select(
        "host",
        F.to_date("day_name", "yyyy-M-d").alias("day"),
        F.col("hour").cast("int").alias("hour"),
        "file",
        "block",
        "seq",
        "value",
    )


def day_patterns(root: str, day_name: str) -> list[str]:
    """The folders of one day (yyyy-M-d) in both layouts."""
    return [f"{root}/host=*/day={day_name}", f"{root}/*/{day_name}"]


def read_hour_files_of_day(spark: SparkSession, root: str, day_name: str) -> DataFrame | None:
    """``read_hour_files`` of the folders of one day (yyyy-M-d) in both layouts; None if there are none."""
    paths = [pattern for pattern in day_patterns(root, day_name) if matching(spark, pattern)]
    return read_hour_files(spark, paths) if paths else None


def read_day_files(spark: SparkSession, root: str, compression: str = "NONE") -> DataFrame:
    """Lines of compacted day files or of line ranges: value, host, day.

    ``.gz`` files are decompressed by suffix.  Days written with the zstd codec are Parquet files.
    """
    fmt = "parquet" if compression == "Zstandard" else "text"
    rows = spark.read.schema("value string, host string, day string").format(fmt).load(root)
    return rows.select("value", F.coalesce("host", F.lit("")).alias("host"), "day")


def read_day_lines_zst(spark: SparkSession, root: str) -> DataFrame:
    """Lines of zstd-compressed day files that a finished run wrote: value, host, day, and their place (file, seq)."""
    rows = zst_lines.register(spark).read.format(zst_lines.NAME).load(root)
    return rows.select("value", "host", "day", "file", "seq")
