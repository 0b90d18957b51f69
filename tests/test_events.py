import json

import pytest
from pyspark.sql import functions as F

from beaconloom.operators import events, latest, tables
from beaconloom.schema import EVENT_COLUMNS, EVENT_NAMES, EVENT_SCHEMA, EVENT_SCHEMA_V1, HOSTNAME_SCHEMA
from beaconloom.sources import beacons, ranges

CHROME = (
    "Mozilla/5.0 (Windows NT 10.0; WOW64) AppleWebKit/600.1 (KHTML, like Gecko) "
    "Chrome/99.1.2345.6 Safari/600.1"
)


def beacon(**changes):
    """A beacon of our own making; a change to None removes the key.  ``__`` stands for a dot."""
    headers = {"User-Agent": [CHROME], "Cf-Ipcountry": ["BG"], "Cf-Ipcity": ["Varna"]}
    headers["X-Forwarded-For"] = ["10.0.0.7, 10.0.0.8", "10.9.9.9"]
    row = {
        "u": "https://store.example.com/cart?a=1",
        "created_at": "2023-03-04 05:06:07",
        "pid": "ab12cd34",
        "rt.si": "session-one",
        "rt.sl": "3",
        "v": "3.1.4",
        "c.cls": "0.25",
        "et.fid": "1",
        "ua.vnd": "Example Maker",
        "ua.plt": "Desk64",
        "mob.etype": "4g",
        "mob.dl": "10",
        "mob.rtt": "50",
        "scr.xy": "1700x920",
        "dom.sz": "73111",
        "nt_con_st": "1700000000100",
        "nt_con_end": "1700000000342",
        "c.t.fps": "1c,*4*9",
    }
    row.update({key.replace("__", "."): value for key, value in changes.items()})
    row = {key: value for key, value in row.items() if value is not None}
    row.setdefault("request_headers", json.dumps(headers))
    return json.dumps(row)


@pytest.fixture
def load(spark, tmp_path, rules):
    def run(*lines, ranges_=None, name="a.json.lines"):
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
        return events.ingest(
            beacons.read_beacons(spark, f"{tmp_path}/*.json.lines"), rules, ranges_, keep=("seq",)
        )

    return run


def count(done, predicate="true"):
    return events.count_where(done.events, predicate).head().n


def test_all_fields(load):
    done = load(beacon())
    assert done.events.columns == [*EVENT_NAMES, "seq"]
    assert [f.dataType for f in done.events.drop("seq").schema] == [f.dataType for f in EVENT_SCHEMA]
    for predicate in [
        "true",
        "event_date = date '2023-03-04'",
        "created_at = timestamp '2023-03-04 05:06:07'",
        "hostname = 'store.example.com'",
        "url = 'https://store.example.com/cart?a=1'",
        "cumulative_layout_shift = 0.25",
        "first_input_delay = 1",
        f"user_agent = '{CHROME}'",
        "device_type = 'desktop'",
        "browser_name = 'Chrome' and browser_version = '99.1.2345'",
        "operating_system = 'Windows' and operating_system_version = '10'",
        "device_manufacturer is null",
        "ua_vnd = 'Example Maker' and ua_plt = 'Desk64'",
        "mob_etype = '4g' and mob_dl = 10 and mob_rtt = 50",
        "connect_duration = 242 and dns_duration is null",
        "screen_width = 1700 and screen_height = 920",
        "dom_sz = 73111",
        "redirect_duration = 0 and redirects_count = 0",
        "geo_country_code = 'BG' and geo_city_name = 'Varna'",
        "event_type = 'visit_page' and session_id = 'session-one' and session_length = 3",
        "next_hop_protocol = '' and scr_bpp = '' and data_saver_on is null",
    ]:
        assert count(done, predicate) == 1, predicate


@pytest.mark.parametrize("missing", [True, False])
def test_empty_and_missing_fields(load, missing):
    value = None if missing else ""
    headers = json.dumps({"Cf-Ipcountry": [""], "Cf-Ipcity": [""]})
    changes = {"c__cls": value, "et__fid": value, "ua__vnd": value, "ua__plt": value, "u": ""}
    done = load(beacon(**changes, request_headers=headers))
    for predicate in [
        "cumulative_layout_shift is null and first_input_delay is null",
        "user_agent is null and browser_version is null and operating_system_version is null",
        "device_type = 'unknown' and browser_name = 'Other' and operating_system = 'Other'",
        "ua_vnd is null and ua_plt is null and device_manufacturer is null",
        "hostname = '' and url = ''",
        "geo_country_code = '' and geo_city_name = ''",
    ]:
        assert count(done, predicate) == 1, predicate


def test_rounded_downlink_and_event_kinds(load):
    done = load(
        beacon(mob__dl="10.7", rt__quit=""),
        beacon(mob__dl="10.3"),
        beacon(http_initiator="spa", rt__quit=""),
    )
    assert count(done, "mob_dl = 11 and event_type = 'quit_page'") == 1
    assert count(done, "mob_dl = 10 and event_type = 'visit_page'") == 1
    assert count(done, "event_type = 'spa'") == 1


def test_rejects_and_hostnames(spark, load, tmp_path):
    done = load(
        "not json",
        beacon(u="http://h:80a/"),
        beacon(c__cls="0,5", u="https://one.example.com/", created_at="2023-01-01 00:00:01"),
        beacon(u="https://two.example.com/", created_at="2023-01-01 00:00:02"),
        beacon(u="https://two.example.com/", created_at="2022-01-01 00:00:00"),
        beacon(u="https://three.example.com/", created_at="yesterday"),
        beacon(u="https://four.example.com/", created_at=""),
    )
    reasons = [r.reason for r in done.rejects.orderBy("seq").collect()]
    assert reasons == ["bad_json", "bad_url", "bad_number", "bad_created_at", "bad_created_at"]
    assert done.rejects.where("raw is null").count() == 0
    assert done.typed.where("reason is null and raw is not null").count() == 0
    assert count(done) == 2
    # By arrival, not by time; faulty numbers count, unreadable times do not.
    seen = latest.hostnames_seen(done.typed)
    found = {r.hostname: str(r.updated_at) for r in seen.collect()}
    assert found == {
        "one.example.com": "2023-01-01 00:00:01",
        "two.example.com": "2022-01-01 00:00:00",
    }


def test_absent_creation_time_is_arrival(spark):
    lines = spark.sql(
        "select value, bigint(1) as seq, timestamp '2024-05-06 07:08:09.9' as received_at"
        " from values ('{}'), ('{\"created_at\":\"\"}') as t(value)"
    )
    typed = events.type_beacons(beacons.parse_lines(lines))
    rows = {(str(r.created_at), r.reason) for r in typed.select("created_at", "reason").collect()}
    assert rows == {("2024-05-06 07:08:09", None), ("None", "bad_created_at")}


def test_forms_give_the_same_events(spark, rules):
    requests = spark.createDataFrame(
        [
            ("u=https%3A%2F%2Fa.example.com%2F&mob.dl=2.5&mob.dl=9", "pid=x1", '{"user-agent":["curl/8"]}', 1),
            ("u=%zz", None, None, 2),
            (None, None, None, 3),
        ],
        "body string, query string, headers string, seq bigint",
    ).withColumns(
        {
            "received_at": F.lit("2024-01-02 03:04:05").cast("timestamp"),
            "remote_address": F.lit("10.1.2.3"),
        }
    )
    done = events.ingest(beacons.parse_requests(requests), rules, keep=("seq",))
    row = done.events.collect()
    assert len(row) == 1
    assert (row[0].hostname, row[0].mob_dl, row[0].page_id) == ("a.example.com", 3, "x1")
    assert (row[0].user_agent, str(row[0].created_at)) == ("curl/8", "2024-01-02 03:04:05")
    assert [tuple(r) for r in done.rejects.select("seq", "reason").collect()] == [(2, "bad_form")]
    addressed = beacons.parse_requests(requests, use_remote_address=True)
    assert {r.client_ip for r in addressed.collect()} == {"10.1.2.3"}
    assert {r.client_ip for r in beacons.parse_requests(requests).collect()} == {""}


def test_same_rows_for_any_partitioning(spark, rules):
    lines = spark.range(400).selectExpr("id as seq").withColumns(
        {
            "value": F.format_string(
                '{"u":"https://h%d.example.com/","created_at":"2023-01-01 00:00:%02d","mob.dl":"%d.5"}',
                F.col("seq") % 7,
                F.col("seq") % 60,
                F.col("seq") % 9,
            ),
            "received_at": F.lit("2024-01-02 03:04:05").cast("timestamp"),
        }
    )
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        typed = events.type_beacons(beacons.parse_lines(lines.repartition(partitions)))
        seen = latest.hostname_registry(latest.hostnames_seen(typed))
        results.append(sorted(map(str, seen.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) == 7


def test_event_table_layout_and_versions(spark, load, tmp_path):
    path = str(tmp_path / "table")
    rows = load(beacon(), beacon(created_at="2023-03-05 00:00:00", mob__dl="7")).events.drop("seq")
    old = tables.downgrade_events(rows.where("event_date = date '2023-03-04'"))
    assert old.columns == EVENT_SCHEMA_V1.names
    tables.laid_out(old).write.partitionBy("event_date").parquet(path)
    tables.write_events(rows.where("event_date = date '2023-03-05'"), path)
    both = tables.read_events(spark, path)
    assert both.schema.names == EVENT_NAMES
    found = {str(r.event_date): r.mob_dl for r in both.collect()}
    assert found == {"2023-03-04": None, "2023-03-05": 7}
    assert tables.upgrade_events(old).where("mob_etype is null and mob_dl is null").count() == 1
    plan = both.where("event_date = date '2023-03-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    # A replayed batch replaces its own rows only.
    for _ in range(2):
        tables.write_events(rows, str(tmp_path / "batches"), batch='1-a')
    tables.write_events(rows, str(tmp_path / "batches"), batch='1-b')
    assert tables.read_events(spark, str(tmp_path / "batches")).count() == 4


def test_only_needed_parameters_are_parsed(spark):
    lines = spark.createDataFrame([("{}", 1)], "value string, seq bigint").withColumn(
        "received_at", F.current_timestamp()
    )
    typed = events.type_beacons(beacons.parse_lines(lines)).select("mob_dl")
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert "mob.dl" in plan and "nt_con_st" not in plan and "request_headers" not in plan


def test_places_by_header_and_address(spark, load):
    table = spark.createDataFrame(
        [("10.0.0.0", "10.0.0.255", "GB", None), ("10.0.0.7", "10.0.0.7", "BG", "Sofia")],
        "ip_start string, ip_end string, country string, city string",
    )

    def with_headers(**headers):
        named = {key.replace("_", "-"): [value] for key, value in headers.items()}
        return beacon(request_headers=json.dumps(named))

    done = load(
        with_headers(X_Forwarded_For="10.0.0.7"),
        with_headers(X_Forwarded_For="10.0.0.8"),
        with_headers(X_Forwarded_For="10.0.0.8", CF_IPCOUNTRY=' " DE " '),
        with_headers(X_Forwarded_For="10.0.0.8", cf_ipcity="Ulm"),
        with_headers(X_Forwarded_For="nowhere"),
        ranges_=ranges.keyed_ranges(table),
    )
    rows = done.events.orderBy("seq").select("geo_country_code", "geo_city_name").collect()
    assert [tuple(r) for r in rows] == [("BG", "Sofia"), ("GB", ""), ("DE", ""), ("", "Ulm"), ("", "")]


def test_hostname_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for seq, moment in [(1, "2022-08-27 05:53:00"), (2, "2022-08-27 06:53:00.125")]:
        row = spark.createDataFrame([("host1", moment, seq)], "hostname string, t string, seq bigint")
        tables.append_log(
            row.select("hostname", F.col("t").cast("timestamp").alias("updated_at"), "seq"), path
        )
    registry = latest.hostname_registry(tables.read_log(spark, path, HOSTNAME_SCHEMA)).collect()
    assert [(r.hostname, str(r.updated_at)) for r in registry] == [("host1", "2022-08-27 06:53:00.125000")]


def test_numbers_that_do_not_fit_are_rejected(load):
    done = load(
        beacon(rt__sl="40000"),
        beacon(pt__lcp="99999999999"),
        beacon(et__fid="10.5"),
        beacon(dom__sz="1e3"),
        beacon(dom__sz="n/a", rt__sl="", mem__used="123456789012"),
    )
    assert [r.reason for r in done.rejects.collect()] == ["bad_number"] * 4
    assert count(done, "dom_sz is null and session_length is null and mem_used = 123456789012") == 1


def test_no_number_is_too_large_for_the_job_or_changed(load):
    """Every numeric column, with a number that its type cannot hold, one that is not whole where it must be, and none."""
    numeric = {key for name, kind, rule, key in EVENT_COLUMNS if rule == "whole"} | {"mob.dl", "c.cls"}
    lines = [beacon(**{key.replace(".", "__"): given}) for key in sorted(numeric) for given in ("9" * 40, "-" + "9" * 40, "1e400")]
    lines += [beacon(scr__xy=size) for size in ("99999999999x5", "5x99999999999", "1e9x5", "-3000000000x-1", "5.5x7")]
    lines += [beacon(c__cls="1e40"), beacon(c__cls="-1e40"), beacon(mob__dl="99999999999"), beacon(mob__dl="1e40")]
    done = load(*lines, beacon(scr__xy="x"), beacon(scr__xy="wide x high"), beacon(mob__dl="fast"), beacon(nt_con_end="9" * 40))
    assert [r.reason for r in done.rejects.collect()] == ["bad_number"] * len(lines)
    assert count(done) == 4 and count(done, "connect_duration = 65535") == 1


def test_the_first_of_several_reasons_is_given(load):
    faults = {
        "bad_url": {"u": "http://bad host/"},
        "bad_number": {"rt__sl": "40000"},
        "bad_number ": {"c__cls": "0,5"},
        "bad_number  ": {"scr__xy": "99999999999x5"},
        "bad_created_at": {"created_at": "soon"},
    }
    names = list(faults)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    done = load(*[beacon(**faults[a], **faults[b]) for a, b in pairs])
    assert [r.reason for r in done.rejects.orderBy("seq").collect()] == [a.strip() for a, _ in pairs]


def test_a_host_keeps_its_last_readable_time(load):
    done = load(
        beacon(created_at="2023-01-01 00:00:01"),
        beacon(created_at="2022-01-01 00:00:02"),
        beacon(created_at="soon"),
    )
    assert [str(r.updated_at) for r in latest.hostnames_seen(done.typed).collect()] == ["2022-01-01 00:00:02"]
