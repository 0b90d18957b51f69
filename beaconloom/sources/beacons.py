"""Beacons from JSON lines and from request logs.

Every reader ends in the same columns, the *beacon* shape that the operators take:

``params``       struct or map of parameters, a missing key being NULL
``headers``      lower-case header names and first values, as parallel arrays
``user_agent``   ``''`` if the header is missing
``client_ip``    first forwarded address, ``''`` if there is none
``received_at``  arrival time
``seq``          arrival order, anything that sorts
``raw``          the input text, for the rejects table
``unreadable``   reason why the input could not be read, else NULL
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconloom.functions import forms, maps, texts
from beaconloom.schema import CORRUPT, PARAMETER_STRUCT

BEACON_COLUMNS = [
    "params",
    "headers",
    "user_agent",
    "client_ip",
    "received_at",
    "seq",
    "raw",
    "unreadable",
]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines of all files that match the paths, with their place as arrival order.

    The order key is (file, block, position): positions only compare within one block, so it stays
    right however Spark groups blocks into tasks.  ``.gz`` and ``.zst`` files are decompressed.
    """
    lines = spark.read.text(paths if isinstance(paths, list) else [paths])
    return lines.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
        ).alias("seq"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


HEADER_LISTS = "map<string,array<string>>"


def _with_request_fields(
    df: DataFrame, headers_json: Column, fallback_address: Column | None = None
) -> DataFrame:
    """Add headers, user agent and client address.

    One step per column that is used more than once, so that each is computed once.
    """
    headers = F.col("headers")
    address = texts.first_address(maps.header(headers, "x-forwarded-for"))
    if fallback_address is not None:
        address = F.when(address == "", F.coalesce(fallback_address, F.lit(""))).otherwise(address)
    return (
        df.withColumn("header_lists", F.from_json(headers_json, HEADER_LISTS))
        .withColumn("headers", maps.parse_headers(F.col("header_lists")))
        .withColumns({"user_agent": maps.header(headers, "user-agent"), "client_ip": address})
        .select(*BEACON_COLUMNS)
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (``value``, ``seq``, ``received_at``) to beacons.

    Only the parameters that reach a column are parsed; the others are skipped by the JSON reader.
    """
    parsed = F.from_json("value", PARAMETER_STRUCT, {"columnNameOfCorruptRecord": CORRUPT})
    df = lines.where("value is not null").select(
        parsed.alias("params"), "seq", "received_at", F.col("value").alias("raw")
    ).withColumn(
        "unreadable",
        F.when(F.col("params").isNull() | F.col(f"params.{CORRUPT}").isNotNull(), "bad_json"),
    )
    return _with_request_fields(df, F.col("params.request_headers"))


def parse_line_maps(lines: DataFrame) -> DataFrame:
    """JSON lines to beacons with *all* parameters as a map, as the archive needs them."""
    df = lines.where("value is not null").select(
        F.from_json("value", "map<string,string>").alias("params"),
        "seq",
        "received_at",
        F.col("value").alias("raw"),
    ).withColumn("unreadable", F.when(F.col("params").isNull(), "bad_json"))
    return _with_request_fields(df, maps.parameter(F.col("params"), "request_headers"))


def parse_requests(requests: DataFrame, use_remote_address: bool = False) -> DataFrame:
    """Request log (``body``, ``query``, ``headers`` JSON, ``received_at``, ``seq``) to beacons.

    ``use_remote_address`` takes the ``remote_address`` column where no address was forwarded.
    """
    form = forms.parse_form(F.col("body"), F.col("query"), F.col("headers"))
    df = requests.where("body is not null or query is not null").select(
        form.alias("params"),
        F.col("headers").alias("headers_json"),
        "received_at",
        "seq",
        F.concat_ws("?", "body", "query").alias("raw"),
        *(["remote_address"] if use_remote_address else []),
    ).withColumn("unreadable", F.when(F.col("params").isNull(), "bad_form"))
    fallback = F.col("remote_address") if use_remote_address else None
    return _with_request_fields(df, F.col("headers_json"), fallback)


def read_beacons(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Beacons of all JSON-lines files that match the paths."""
    return parse_lines(read_lines(spark, paths))


def union_beacons(*frames: DataFrame) -> DataFrame:
    """All beacons of several sources, columns matched by name, absent ones NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
