"""Continuous intake: events, hostname log and registry, hour archives.

Events, hostname log and archive are ``foreachBatch`` jobs whose output is keyed by the stream's own identifier and the batch
id, so a batch that is replayed after a failure replaces its own output instead of adding to it, and
a stream with another checkpoint, whose batch ids start at 0 again, replaces nothing.  The sinks (``start_event_sink``,
``start_reject_sink``, ``start_archive_sink``) are Spark's own partitioned file sinks: a batch is an entry of their log of commits and
not a folder, and readers go by that log.  A sink's folder belongs to one stream.  There is no
watermark: events are stored under the day of their creation at any age, archive lines under their
arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconloom.functions import texts
from beaconloom.operators import agents, archives, events, latest, places
from beaconloom.operators.snapshots import CompactedLog
from beaconloom.operators.tables import append_log, filter_once, write_events
from beaconloom.sources import beacons

HOSTNAME_INTERVAL = "1 minute"
ARCHIVE_INTERVAL = "5 seconds"
#: Batches between compactions of a registry's log, and files that one batch writes.
COMPACT_EVERY, FLUSH_FILES = 60, 4
#: Files, at most, that a batch of a sink adds to a day of events; partitions that a batch of an archive is dealt to.
DAY_FILES, ARCHIVE_TASKS = 2, 8


def line_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines of a growing folder, with the place of each line for its arrival order."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def record_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Records of a growing folder of Parquet files that carry their own arrival time and order.

    A message queue source has the same three columns: value, timestamp and offset.
    """
    schema = "value string, seq bigint, received_at timestamp"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def arrived(batch: DataFrame) -> DataFrame:
    """Lines of one micro-batch with their arrival order, (file, block, position) for text files."""
    if "seq" in batch.columns:
        return batch.select("value", "received_at", "seq")
    place = F.struct("file", "block", F.monotonically_increasing_id().alias("position"))
    return batch.select("value", "received_at", place.alias("seq"))


def arriving(stream: DataFrame) -> DataFrame:
    """Lines of a stream for a sink.  A stream cannot number the lines of a text file: the line's hash stands for its position,
    so that ``seq`` tells the file and the block."""
    if "seq" in stream.columns:
        return stream.select("value", "received_at", "seq")
    place = F.struct("file", "block", F.xxhash64("value").alias("position"))
    return stream.select("value", "received_at", place.alias("seq"))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identifier that Spark keeps in a checkpoint from the stream's first start on."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").head()[0])["id"]


def _start(
    stream: DataFrame,
    each: Callable[[DataFrame, str], None],
    checkpoint: str,
    interval: str,
    drain: bool,
) -> StreamingQuery:
    known: list[str] = []

    def named(batch: DataFrame, batch_id: int) -> None:
        if not known:
            known.append(_stream_id(batch.sparkSession, checkpoint))
        each(batch, f"{batch_id:012d}-{known[0]}")

    writer = stream.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return writer.start()


def start_events(
    stream: DataFrame,
    rules: DataFrame,
    events_path: str,
    rejects_path: str,
    agents_path: str,
    checkpoint: str,
    ranges: DataFrame | places.Blocks | None = None,
    interval: str = ARCHIVE_INTERVAL,
    drain: bool = False,
) -> StreamingQuery:
    """Append event rows by creation day, and rejects to their own table.

    ``drain`` processes what is there and stops, which is how a last batch is flushed.  Several streams share
    ranges if they are passed as ``places.prepare`` gives them.
    """

    blocks = ranges if ranges is None or isinstance(ranges, places.Blocks) else places.prepare(ranges)  # once for all batches

    def each(batch: DataFrame, name: str) -> None:
        lines = beacons.parse_lines(arrived(batch))
        done = events.ingest(lines, rules, blocks, agents_path, name)
        write_events(done.events, events_path, name)
        append_log(done.rejects, rejects_path, name)
        done.release()

    return _start(stream, each, checkpoint, interval, drain)


def start_hostnames(
    stream: DataFrame,
    log_path: str,
    checkpoint: str,
    interval: str = HOSTNAME_INTERVAL,
    drain: bool = False,
) -> StreamingQuery:
    """Per interval, append the last creation time of every hostname seen to the hostname log.

    Nothing is remembered between batches; ``latest`` over the log resolves across them and across
    streams.  Its order is the arrival order where the stream carries one, else the time of arrival.
    """

    def each(batch: DataFrame, name: str) -> None:
        typed = events.type_beacons(beacons.parse_lines(arrived(batch)))
        seen = latest.hostnames_seen(typed)
        if "seq" not in batch.columns:
            arrival = batch.agg(F.unix_micros(F.max("received_at"))).head()[0]
            seen = seen.withColumn("seq", F.lit(arrival).cast("bigint"))
        append_log(seen, log_path, name)

    return _start(stream, each, checkpoint, interval, drain)


def start_registry(
    stream: DataFrame,
    log: CompactedLog,
    checkpoint: str,
    interval: str = HOSTNAME_INTERVAL,
    drain: bool = False,
    compact_every: int = COMPACT_EVERY,
    files: int = FLUSH_FILES,
) -> StreamingQuery:
    """The hostname registry as a stateful stream: one state for each hostname, its last creation time by arrival.

    An interval gives the hostnames that it changed, with the number of the batch as ``seq``; every ``compact_every`` batches the log
    is folded and what is folded is removed, so that it holds ``files`` files for each batch since then and those of a snapshot.
    A batch that runs again writes the same rows.  ``log`` is this stream's alone; registries of several streams are read
    together.
    """
    arrival = stream if "seq" in stream.columns else stream.withColumn("seq", F.unix_micros("received_at"))
    seen = latest.hostnames_seen(events.type_beacons(beacons.parse_lines(arrived(arrival))))

    def each(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("hostname", "updated_at", F.lit(batch_id).cast("bigint").alias("seq"))
        log.append(changed.repartition(files))
        if (batch_id + 1) % compact_every == 0:
            log.compact()
            log.remove_folded()

    writer = seen.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return writer.start()


def start_archive(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    interval: str = ARCHIVE_INTERVAL,
    drain: bool = False,
) -> StreamingQuery:
    """Append archive lines to the hour of their arrival."""

    def each(batch: DataFrame, name: str) -> None:
        lines = archives.archive_lines(beacons.parse_line_maps(arrived(batch)))
        archives.write_hours(lines, root, name)

    return _start(stream, each, checkpoint, interval, drain)


def _sink(
    rows: DataFrame, fmt: str, path: str, by: list[str], checkpoint: str, interval: str, drain: bool
) -> StreamingQuery:
    writer = rows.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return writer.start()


def start_event_sink(
    stream: DataFrame,
    rules: DataFrame,
    events_path: str,
    agents_path: str,
    checkpoint: str,
    ranges: DataFrame | places.Blocks | None = None,
    interval: str = ARCHIVE_INTERVAL,
    drain: bool = False,
    day_files: int = DAY_FILES,
) -> StreamingQuery:
    """Event rows by creation day through the file sink, exactly once.

    A batch is one plan: agents are looked up among those stored when the stream starts, the others are classified row by row,
    addresses are looked up in the ranges as they are then (pass what ``places.best_of_blocks`` gives to prepare them once).
    ``agents.extend_dimension`` over stored events adds what was new, for the next start.  A batch adds ``day_files`` files to
    a day at most, however many tasks there are and whichever host or agent is frequent.
    """
    bests = ranges
    if ranges is not None and not isinstance(ranges, places.Blocks):
        bests = places.best_of_blocks(places.prepare(ranges))
    typed = events.type_beacons(beacons.parse_lines(arriving(stream)))
    known = agents.read_dimension(stream.sparkSession, agents_path)
    rows = events.enrich_rows(typed, known, rules, bests, keep=("seq",))
    part = F.pmod(F.xxhash64("seq"), F.lit(day_files))
    dealt = rows.repartition("event_date", part).drop("seq")
    return _sink(dealt, "parquet", events_path, ["event_date"], checkpoint, interval, drain)


def start_reject_sink(
    stream: DataFrame, rejects_path: str, checkpoint: str, interval: str = ARCHIVE_INTERVAL, drain: bool = False
) -> StreamingQuery:
    """Rejects through the file sink, exactly once, one file a batch and task."""
    found = filter_once(events.type_beacons(beacons.parse_lines(arriving(stream))), F.col("reason").isNotNull())
    return _sink(events.rejects(found), "parquet", rejects_path, [], checkpoint, interval, drain)


def start_archive_sink(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    interval: str = ARCHIVE_INTERVAL,
    drain: bool = False,
    tasks: int = ARCHIVE_TASKS,
) -> StreamingQuery:
    """Archive lines to the hour of their arrival through the file sink, exactly once.

    A late line goes to its arrival hour like any other.  Lines are read by as many tasks as the batch has input for and dealt by
    their hour to ``tasks`` partitions, so that a batch adds one file to an hour; small partitions are merged and those beyond
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` split, so that a busy host is written by several tasks and an hour of it is
    several files.  Lines that one task has read stay in the order of their arrival.
    """
    lines = archives.archive_lines(beacons.parse_line_maps(arriving(stream)))
    rows = lines.select("value", "host", texts.day_name(F.col("day")).alias("day"), "hour")
    dealt = rows.hint("rebalance", tasks, "host", "day", "hour")
    return _sink(dealt, "text", root, ["host", "day", "hour"], checkpoint, interval, drain)
