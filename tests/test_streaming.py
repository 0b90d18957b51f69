import datetime as dt
import json
import os
import shutil

from pyspark.sql import functions as F

from beaconloom.operators import agents, events, latest, tables
from beaconloom.operators.snapshots import CompactedLog
from beaconloom.plans import inputs
from beaconloom.schema import EVENT_NAMES, HOSTNAME_SCHEMA
from beaconloom.session import shared_folder
from beaconloom.sources import archives as files
from beaconloom.sources import beacons
from beaconloom.streaming import jobs


def drop(folder, name, rows, moment):
    path = folder / name
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (moment, moment))


def beacon(host, created_at, **more):
    headers = json.dumps({"User-Agent": ["curl/7" if host != "b" else "Firefox/9.1"]})
    return {"u": f"https://{host}.example.com/", "created_at": created_at, "request_headers": headers, **more}


FIRST = [beacon("a", "2023-01-02 00:00:00"), beacon("b", "2023-01-03 00:00:00"), beacon("b", "2020-05-05 00:00:00")]
SECOND = [beacon("b", "2019-01-01 00:00:00"), beacon("c", "2023-01-02 00:00:00", **{"c.cls": "x"})]


def test_events_equal_batch_over_two_drains(spark, rules, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = str(tmp_path / "out")

    def drain():
        jobs.start_events(
            jobs.line_stream(spark, str(folder)), rules, f"{out}/events", f"{out}/rejects",
            f"{out}/agents", f"{out}/checkpoint", drain=True,
        ).awaitTermination()

    drop(folder, "1.json", FIRST, 1_700_000_000)
    os.makedirs(f"{shared_folder(spark)}/beaconloom", exist_ok=True)
    before = os.listdir(f"{shared_folder(spark)}/beaconloom")
    drain()
    assert os.listdir(f"{shared_folder(spark)}/beaconloom") == before  # no scratch left behind
    drop(folder, "2.json", SECOND, 1_700_000_100)
    drain()
    drain()  # nothing new
    streamed = tables.read_events(spark, f"{out}/events")
    batch = events.ingest(beacons.read_beacons(spark, f"{folder}/*"), rules)
    rows = lambda df: sorted(map(str, df.select(*EVENT_NAMES).collect()))
    assert rows(streamed) == rows(batch.events) and len(rows(streamed)) == 4
    # Late rows go to the day of their creation.
    assert os.path.isdir(f"{out}/events/event_date=2019-01-01")
    assert [r.reason for r in spark.read.parquet(f"{out}/rejects").collect()] == ["bad_number"]
    assert spark.read.parquet(f"{out}/agents").count() == 2


def test_hostnames_across_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    drop(folder, "1.json", FIRST, 1_700_000_000)
    drop(folder, "2.json", SECOND, 1_700_000_100)
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    stream = jobs.line_stream(spark, str(folder), files_per_batch=1)
    jobs.start_hostnames(stream, log, checkpoint, drain=True).awaitTermination()
    rows = tables.read_log(spark, log, HOSTNAME_SCHEMA)
    assert rows.count() == 4  # two hosts per batch
    found = {r.hostname: str(r.updated_at) for r in latest.hostname_registry(rows).collect()}
    assert found == {
        "a.example.com": "2023-01-02 00:00:00",
        "b.example.com": "2019-01-01 00:00:00",
        "c.example.com": "2023-01-02 00:00:00",
    }


def test_archive_keeps_arrival_hours_and_replays(spark, rules, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    lines = inputs.table(spark, "/root/testdata/sf0.001", "events").select(
        F.concat(F.lit('{"u":"https://h.example.com/","pid":"'), F.col("event_id"), F.lit('"}')).alias("value"),
        F.col("event_id").alias("seq"),
        F.expr("timestamp '2024-02-03 04:59:00' + make_dt_interval(0, 0, event_id % 3)").alias("received_at"),
    )
    lines.repartition(3).write.parquet(feed)
    stream = jobs.record_stream(spark, feed)
    jobs.start_archive(stream, f"{out}/hours", f"{out}/checkpoint", drain=True).awaitTermination()
    archived = files.read_hour_files(spark, f"{out}/hours")
    by_hour = {r.hour: r["count"] for r in archived.groupBy("hour").count().collect()}
    assert by_hour == {4: 334, 5: 666}
    # Archived lines enter again as beacons.
    again = events.type_beacons(beacons.read_beacons(spark, f"{out}/hours/*/*/*/*"))
    assert again.select("page_id").distinct().count() == 1000


def test_a_second_checkpoint_replaces_nothing(spark, rules, tmp_path):
    out = str(tmp_path / "out")
    for n, rows in enumerate((FIRST, SECOND)):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        drop(folder, "1.json", rows, 1_700_000_000 + n)
        stream = jobs.line_stream(spark, str(folder))
        for _ in range(2):  # the second time there is nothing new
            jobs.start_events(
                stream, rules, f"{out}/events", f"{out}/rejects", f"{out}/agents", f"{out}/checkpoint-{n}", drain=True
            ).awaitTermination()
        jobs.start_hostnames(stream, f"{out}/log", f"{out}/hosts-{n}", drain=True).awaitTermination()
        jobs.start_archive(stream, f"{out}/hours", f"{out}/archive-{n}", drain=True).awaitTermination()
    assert tables.read_events(spark, f"{out}/events").count() == 4
    assert spark.read.parquet(f"{out}/rejects").count() == 1
    assert files.read_hour_files(spark, f"{out}/hours").count() == 5
    log = tables.read_log(spark, f"{out}/log", HOSTNAME_SCHEMA)
    assert log.count() == 4
    found = {r.hostname: str(r.updated_at)[:4] for r in latest.hostname_registry(log).collect()}
    assert found == {"a.example.com": "2023", "b.example.com": "2019", "c.example.com": "2023"}


def test_registry_keeps_state_over_a_restart_and_few_files(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = CompactedLog(spark, f"{out}/log", HOSTNAME_SCHEMA, ["hostname"], segment_span=1)

    def feed(first, hosts):
        rows = [
            (json.dumps(beacon(h, f"2023-01-01 00:00:{(first + i) % 60:02d}")), first + i, dt.datetime(2023, 1, 1)) for i, h in enumerate(hosts)
        ]
        spark.createDataFrame(rows, "value string, seq long, received_at timestamp").coalesce(1).write.mode("append").parquet(source)

    def drain():
        jobs.start_registry(
            jobs.record_stream(spark, source, files_per_batch=1), log, f"{out}/checkpoint", drain=True, compact_every=2, files=1
        ).awaitTermination()
        return {r.hostname: r.updated_at.second for r in log.read().collect()}

    feed(40, ["a", "b", "a"])
    assert drain() == {"a.example.com": 42, "b.example.com": 41}
    feed(10, ["b"])  # by arrival it is older: the state knows
    feed(50, ["c", "a"])
    assert drain() == {"a.example.com": 51, "b.example.com": 41, "c.example.com": 50}
    for n in range(3):
        feed(53 + n, ["a"])
    assert drain()["a.example.com"] == 55 and drain() == {"a.example.com": 55, "b.example.com": 41, "c.example.com": 50}
    assert len(log.snapshots()) == 1
    parts = [f for _, _, names in os.walk(f"{out}/log/log") for f in names if f.endswith(".parquet")]
    assert len(parts) <= 2


def parts_of(folder, suffix):
    return [os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(suffix) and not f.startswith(".")]


def test_event_sink_is_exact_over_restarts_with_few_files(spark, rules, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drain():
        stream = jobs.line_stream(spark, str(folder))
        jobs.start_event_sink(
            stream, rules, f"{out}/events", f"{out}/agents", f"{out}/events-checkpoint", drain=True, day_files=1
        ).awaitTermination()
        jobs.start_reject_sink(stream, f"{out}/rejects", f"{out}/rejects-checkpoint", drain=True).awaitTermination()

    drop(folder, "1.json", FIRST * 20, 1_700_000_000)
    drain()
    agents.extend_dimension(tables.read_events(spark, f"{out}/events"), rules, f"{out}/agents")
    drop(folder, "2.json", SECOND, 1_700_000_100)
    drain()
    drain()  # nothing new
    streamed = tables.read_events(spark, f"{out}/events")
    batch = events.ingest(beacons.read_beacons(spark, f"{folder}/*"), rules)
    rows = lambda df: sorted(map(str, df.select(*EVENT_NAMES).collect()))
    assert rows(streamed) == rows(batch.events) and len(rows(streamed)) == 61
    assert [r.reason for r in spark.read.parquet(f"{out}/rejects").collect()] == ["bad_number"]
    # Three days in the first batch, one of them and none new in the second.
    assert len(parts_of(f"{out}/events", ".parquet")) == 4
    # What no batch has committed is not read.
    stray = parts_of(f"{out}/events", ".parquet")[0]
    shutil.copy(stray, stray.replace("part-", "part-9"))
    assert tables.read_events(spark, f"{out}/events").count() == 61


def test_archive_sink_keeps_arrival_hours_and_commits(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def drain(first, n, moment):
        rows = [(json.dumps({"u": "https://h.example.com/", "pid": str(first + i)}), first + i, moment) for i in range(n)]
        spark.createDataFrame(rows, "value string, seq long, received_at timestamp").coalesce(1).write.mode("append").parquet(feed)
        jobs.start_archive_sink(jobs.record_stream(spark, feed), f"{out}/hours", f"{out}/checkpoint", drain=True, tasks=1).awaitTermination()

    drain(0, 100, dt.datetime(2024, 2, 3, 4, 59))
    drain(100, 50, dt.datetime(2024, 2, 3, 5, 0))
    drain(150, 5, dt.datetime(2024, 2, 3, 4, 30))  # late
    parts = parts_of(f"{out}/hours", ".txt")
    assert len(parts) == 3
    shutil.copy(parts[0], parts[0].replace("part-", "part-9"))
    archived = files.read_hour_files(spark, f"{out}/hours").collect()
    assert len(archived) == 155 and len({r.value for r in archived}) == 155
    assert {(r.host, str(r.day), r.hour) for r in archived} == {("h_example_com", "2024-02-03", 4), ("h_example_com", "2024-02-03", 5)}
    assert sum(r.hour == 4 for r in archived) == 105
    # Lines of a file stand in the order of their arrival.
    for file in {r.file for r in archived}:
        numbers = [int(json.loads(r.value)["pid"]) for r in sorted((r for r in archived if r.file == file), key=lambda r: (r.block, r.seq))]
        assert numbers == sorted(numbers)


def test_archive_sink_adds_one_file_to_an_hour_unless_it_is_large(spark, tmp_path):
    rows = [(json.dumps({"u": f"https://h{i % 3}.example.com/", "pid": str(i)}), i, dt.datetime(2024, 2, 3, i % 2)) for i in range(1200)]
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows, "value string, seq long, received_at timestamp").repartition(4).write.parquet(feed)

    def drained(out):
        jobs.start_archive_sink(jobs.record_stream(spark, feed), f"{out}/hours", f"{out}/checkpoint", drain=True).awaitTermination()
        found = files.read_hour_files(spark, f"{out}/hours").collect()
        assert sorted(json.loads(r.value)["pid"] for r in found) == sorted(str(i) for i in range(1200))
        assert {(r.host, r.hour, int(json.loads(r.value)["pid"]) % 6) for r in found} == {(f"h{i % 3}_example_com", i % 2, i) for i in range(6)}
        return len(parts_of(f"{out}/hours", ".txt"))

    assert drained(str(tmp_path / "small")) == 6  # four tasks have read lines of all six hours
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        spark.conf.set(size, "1024")
        assert drained(str(tmp_path / "large")) > 6
    finally:
        spark.conf.unset(size)
