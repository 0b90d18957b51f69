"""Every registered query against its SQL counterpart, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from beaconloom.plans.oracles import ORACLES
from beaconloom.plans import queries
from beaconloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer orders events pages".split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}


def connected(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return connected(FOLDER)


#: Rows with several faults at once are too few in the smallest tables.
LARGER, IN_LARGER = "/root/testdata/sf0.01", ["rejects", "beacon_events", "stream_events", "stream_event_sink"]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries()) & set(entry.oracle_sql())


def compare(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    result = duck.execute(ORACLES[name])
    kinds = {column[0]: str(column[1]) for column in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    order = sorted(df.columns)
    at = [list(kinds).index(column) for column in order]
    expected = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)
    found = sorted((tuple(row[c] for c in order) for row in df.collect()), key=repr)
    assert found == expected and found


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", IN_LARGER)
def test_query_on_more_rows(spark, name):
    compare(spark, connected(LARGER), name, LARGER)


@pytest.mark.parametrize("name", ["stream_rejects", "stream_registry", "stream_event_sink", "stream_hosts", "stream_archive_sink"])
def test_batches_are_read_by_several_tasks(spark, monkeypatch, name):
    reader, seen = queries.jobs.record_stream, []

    def noted(spark, folder, files_per_batch):
        seen.append((folder, files_per_batch))
        return reader(spark, folder, files_per_batch)

    monkeypatch.setattr(queries.jobs, "record_stream", noted)
    monkeypatch.setattr(queries, "FEED_ROWS", 1000)
    compare(spark, connected(LARGER), name, LARGER)
    for folder, files in set(seen):
        sizes = spark.read.parquet(folder).groupBy("_metadata.file_path").count().collect()
        assert files > 1 and len(sizes) == files * (2 if name == "stream_hosts" else 4)
        assert max(row["count"] for row in sizes) <= 2000


def test_streams_share_prepared_ranges(spark, duck, monkeypatch):
    prepare, calls = queries.places.prepare, []
    monkeypatch.setattr(queries.places, "prepare", lambda *given: calls.append(given) or prepare(*given))
    compare(spark, duck, "stream_events", FOLDER)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["stream_archive", "stream_archive_sink"])
def test_arrival_times_travel_with_the_lines(spark, duck, monkeypatch, name):
    make, calls = queries.inputs.form_requests, []
    monkeypatch.setattr(queries.inputs, "form_requests", lambda *given: calls.append(given) or make(*given))
    compare(spark, duck, name, FOLDER)
    assert len(calls) == 1
