import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from beaconloom.operators import archives
from beaconloom.sources import archives as files
from beaconloom.sources import beacons

DAY = dt.date(2023, 9, 20)


@pytest.fixture
def hours(tmp_path):
    """Hour files of two hosts, in the plain layout, and a file of another day."""
    root = tmp_path / "source"
    content = {
        "alpha/2023-9-20/1.json.lines": ["a1", "a2"],
        "alpha/2023-9-20/17.json.lines": ["a3"],
        "alpha/2023-9-20/2.json.lines": ["a2b"],
        "beta/2023-9-20/2.json.lines": ["b1"],
        "beta/2023-9-21/0.json.lines": ["later"],
        "beta/2023-9-21/notes.txt": ["not an hour file"],
    }
    for name, lines in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(line + "\n" for line in lines))
    return str(root)


def test_hour_files_take_their_place_from_the_path(spark, hours):
    rows = files.read_hour_files(spark, hours).select("host", "day", "hour", "value").collect()
    assert len(rows) == 6
    assert ("alpha", DAY, 17, "a3") in [tuple(r) for r in rows]


@pytest.mark.parametrize("codec, suffix", [("NONE", "txt"), ("GZIP", "txt.gz"), ("Zstandard", "zstd.parquet"), ("other", "txt")])
def test_compaction(spark, hours, tmp_path, codec, suffix):
    days, meta = str(tmp_path / "days"), str(tmp_path / "meta")
    for _ in range(2):  # the second run replaces the first
        archives.compact_day(spark, hours, DAY, days, meta, codec)
    found = glob.glob(f"{days}/host=alpha/day=2023-9-20/part-*")
    assert found and all(name.endswith(suffix) for name in found)
    assert sorted(n for n in os.listdir(days) if "=" in n) == ["host=alpha", "host=beta"]

    def ordered(root, host, compression="NONE"):
        rows = files.read_day_files(spark, root, compression).where(F.col("host") == host)
        return [r.value for r in rows.collect()]

    # Files in name order, lines in file order.
    values = []
    for name in sorted(found):
        fmt = "parquet" if codec == "Zstandard" else "text"
        values += [r.value for r in spark.read.format(fmt).load(name).collect()]
    assert values == ["a1", "a2", "a2b", "a3"]
    assert ordered(days, "beta", codec) == ["b1"]
    assert ordered(meta, "alpha") == ["1,1,2", "2,3,3", "17,4,4"]
    assert ordered(meta, "beta") == ["2,1,1"]


def test_only_the_days_files_are_read(spark, hours):
    lines = archives.lines_of_day(spark, hours, DAY)
    named = {r.file for r in lines.select("file").distinct().collect()}
    assert named and all("/2023-9-20/" in name for name in named) and set(lines.inputFiles()) and all("2023-9-20" in f for f in lines.inputFiles())
    assert archives.lines_of_day(spark, hours, dt.date(1999, 1, 1)) is None


def test_line_numbers(spark, hours):
    lines = files.read_hour_files(spark, hours)
    numbered = archives.number_lines(lines, block=["file", "block"])
    found = {r.value: r.line_no for r in numbered.where("host = 'alpha'").collect()}
    assert found == {"a1": 1, "a2": 2, "a2b": 3, "a3": 4}
    ranges = archives.hour_ranges(lines)
    joined = numbered.join(ranges, ["host", "day", "hour"])
    assert joined.where("line_no not between first_line and last_line").count() == 0


def test_line_numbers_do_not_depend_on_blocks(spark):
    """A third of all lines belongs to one host and hour."""
    lines = spark.range(3000).select(
        F.expr("case when id % 3 = 0 then 'hot' else concat('h', id % 5) end").alias("host"),
        F.lit(DAY).alias("day"),
        F.expr("case when id % 3 = 0 then 7 else cast(id % 4 as int) end").alias("hour"),
        F.expr("(id * 7919) % 3000").alias("seq"),
    )
    results = []
    for size in (10, 700, 10_000):
        numbered = archives.number_lines(archives.with_arrival_block(lines, size))
        results.append(sorted(tuple(r) for r in numbered.select("host", "hour", "seq", "line_no").collect()))
    assert results[0] == results[1] == results[2]
    by_host = {}
    for host, hour, seq, line_no in results[0]:
        by_host.setdefault(host, []).append((hour, seq, line_no))
    for rows in by_host.values():
        assert [r[2] for r in sorted(rows)] == list(range(1, len(rows) + 1))


def test_numbering_shuffles_lines_once(spark):
    lines = spark.range(10).selectExpr(
        "concat('h', id % 2) as host", "date_add(date '2023-01-01', cast(id as int)) as day",
        "cast(id % 3 as int) as hour", "id as seq", "'x' as value",
    )
    plan = archives.number_lines(archives.with_arrival_block(lines))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 3  # lines, counts, and their running sum


def test_archive_lines_and_hours(spark, tmp_path):
    rows = [
        {"u": "https://a.b.example.com/x?p=1&q=2", "z": "1", "a": "<2>", "request_headers": "{}"},
        {"u": "", "z": "no host"},
        {"u": "http://[2001:db8::1]/", "z": "v6"},
        {"u": "http://h:80a/", "z": "bad url"},
    ]
    lines = spark.createDataFrame(
        [(json.dumps(r), i, dt.datetime(2023, 9, 5, 23, 59, i)) for i, r in enumerate(rows)]
        + [("oops", 9, None), (None, 10, None)],
        "value string, seq bigint, received_at timestamp",
    )
    kept = archives.archive_lines(beacons.parse_line_maps(lines))
    found = {r.seq: (r.host, r.hostname, str(r.day), r.hour, r.value) for r in kept.collect()}
    assert sorted(found) == [0, 1, 2]
    assert found[0] == (
        "a_b_example_com",
        "a.b.example.com",
        "2023-09-05",
        23,
        '{"a":"\\u003c2\\u003e","request_headers":"{}","u":"https://a.b.example.com/x?p=1\\u0026q=2","z":"1"}',
    )
    root = str(tmp_path / "hours")
    for _ in range(2):
        archives.write_hours(kept, root, "000000000001")
    archives.write_hours(kept.where("seq = 0"), root, "000000000002")
    again = files.read_hour_files(spark, root)
    hosts = sorted(r.host for r in again.collect())
    assert hosts == ["", "2001:db8::1", "a_b_example_com", "a_b_example_com"]
    assert {str(r.day) for r in again.collect()} == {"2023-09-05"}
    with pytest.raises(TypeError):
        archives.archive_lines(beacons.parse_lines(lines))


def test_hours_are_removed_in_two_phases(spark, tmp_path):
    """Interrupted before, at and after the mark, the job loses no line and removes only what is in the day files."""
    day, root, days, meta = dt.date(2023, 4, 5), str(tmp_path / "hours"), str(tmp_path / "days"), str(tmp_path / "meta")

    def write(batch, hour, values):
        rows = [(v, "h:1.example", day, hour, i) for i, v in enumerate(values)]
        archives.write_hours(spark.createDataFrame(rows, "value string, host string, day date, hour int, seq long"), root, batch)

    def stored():
        return sorted(r.value for r in files.read_day_files(spark, days).collect())

    class Stop(Exception):
        pass

    def stop():
        raise Stop

    def late():
        write("2", 7, ["late"])
        raise Stop

    write("0", 3, ["a", "b"])
    write("1", 4, ["c"])
    archives.compact_day(spark, root, day, days, meta)  # as far as an interrupted first phase may have come
    assert archives.lines_of_day(spark, root, day).count() == 3
    with pytest.raises(Stop):
        archives.compact_day_and_remove(spark, root, day, days, meta, between=late)
    assert archives.lines_of_day(spark, root, day).count() == 4 and stored() == ["a", "b", "c"]
    for _ in range(2):
        assert archives.compact_day_and_remove(spark, root, day, days, meta) == 1  # the late line stays where it is
        assert [r.value for r in archives.lines_of_day(spark, root, day).collect()] == ["late"] and stored() == ["a", "b", "c"]
    other = dt.date(2023, 4, 6)
    assert archives.compact_day_and_remove(spark, root, other, days, meta) == 0
    spare = str(tmp_path / "spare")
    root = str(tmp_path / "more")
    write("0", 3, ["x"])
    assert archives.compact_day_and_remove(spark, root, day, spare, spare + "-meta") == 0
    assert archives.lines_of_day(spark, root, day) is None
    assert archives.compact_day_and_remove(spark, root, day, spare, spare + "-meta", between=lambda: None) == 0


def test_zstd_lines_are_committed_at_once_and_replaced(spark, tmp_path, monkeypatch):
    from beaconloom.sources import zst_lines

    root = str(tmp_path / "days")
    assert zst_lines.Reader(root).committed() == []
    columns = "host string, day date, hour int, seq long, value string"
    day = dt.date(2024, 3, 1)
    rows = [(f"h/{n % 3}" if n % 4 else "", day, n % 24, n, json.dumps({"n": n, "t": "\u2028\u00e9 x"}, ensure_ascii=False)) for n in range(900)]
    lines = spark.createDataFrame(rows, columns).repartition(5)
    archives.write_day_lines_zst(lines, root)
    read = lambda: files.read_day_lines_zst(spark, root)
    assert sorted(r.value for r in read().collect()) == sorted(r[4] for r in rows)
    assert {r.host for r in read().collect()} == {"", "h/0", "h/1", "h/2"} and {r.day for r in read().collect()} == {"2024-3-1"}
    # File names and places in them give the order by hour and arrival.
    found = [json.loads(r.value)["n"] for r in read().where("host = 'h/1'").orderBy("file", "seq").collect()]
    assert found == sorted((n for n in range(900) if n % 4 and n % 3 == 1), key=lambda n: (n % 24, n))
    # A run that fails is not seen; one that ends replaces the host-days that it has lines of.
    monkeypatch.setattr(zst_lines.Writer, "commit", lambda self, messages: 1 / 0)
    one = spark.createDataFrame([("h/1", day, 0, 0, "{}"), ("new", day, 0, 0, "{}")], columns)
    with pytest.raises(Exception):
        archives.write_day_lines_zst(one, root)
    assert read().count() == 900
    monkeypatch.undo()
    archives.write_day_lines_zst(one, root)
    assert read().where("host = 'h/1'").count() == 1 and read().where("host = 'h/2'").count() == sum(n % 4 > 0 and n % 3 == 2 for n in range(900))
