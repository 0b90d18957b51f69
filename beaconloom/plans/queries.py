"""Queries over the general tables, one or more per operator.

Each takes the session and the folder of the tables, and reads whole tables.  Results use plain
types (text for dates and times, 64-bit numbers) so that other engines can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconloom.functions import timelines as timeline_functions
from beaconloom.functions import urls
from beaconloom.operators import (
    agents,
    archives,
    events,
    latest,
    lookups,
    places,
    subscriptions,
    tables,
    timelines,
)
from beaconloom.operators.snapshots import CompactedLog
from beaconloom.plans import inputs
from beaconloom.schema import (
    EVENT_NAMES,
    EVENT_SCHEMA,
    EVENT_SCHEMA_V1,
    HOSTNAME_SCHEMA,
    OWNER_SCHEMA,
    TIMESTAMP_TEXT,
)
from beaconloom.session import materialise, scratch_path, tune
from beaconloom.sources import agent_rules, archives as archive_files, beacons, ranges
from beaconloom.streaming import jobs

AS_OF = "1998-06-01 12:00:00"
V2_SINCE = "2024-01-15"
DAY = date(2024, 1, 15)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under the name of its function."""

    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return function(tune(spark), folder)

    QUERIES[function.__name__] = tuned
    return tuned


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, whole numbers as 64-bit, floats as doubles."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, TIMESTAMP_TEXT)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.FloatType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _typed_once(spark: SparkSession, folder: str) -> DataFrame:
    """Typed beacons for a single use, not written."""
    return events.type_beacons(beacons.parse_lines(inputs.beacon_lines(spark, folder)))


def _typed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Typed beacons, written once: what follows filters and prunes columns, not JSON text.

    Only the parameters behind ``columns`` are parsed.
    """
    typed = _typed_once(spark, folder)
    return materialise(typed.select(*(columns or typed.columns)), "typed")


def _good(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    needed = ("reason", *columns) if columns else ()
    return events.accepted(_typed(spark, folder, *needed))


def _good_once(spark: SparkSession, folder: str) -> DataFrame:
    """Typed beacons that can be stored, for a single use, not written."""
    return tables.filter_once(_typed_once(spark, folder), F.col("reason").isNull())


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.keyed_ranges(inputs.address_ranges(spark, folder))


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return beacons.parse_requests(inputs.form_requests(spark, folder))


def _archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive_lines(_forms(spark, folder))


def _arrived_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Archive lines that carry their arrival time: it travels in the arrival order, which the operator leaves as it is."""
    forms = _forms(spark, folder).withColumn("seq", F.struct("seq", "received_at"))
    return archives.archive_lines(forms).select("value", "seq.seq", "seq.received_at")


# -- beacons to events ------------------------------------------------------------------------


@query
def beacon_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every beacon as one 58-column event row, with user agent and place."""
    lines = beacons.parse_lines(inputs.beacon_lines(spark, folder))
    rules = agent_rules.default_rules(spark)
    done = events.ingest(lines, rules, _ranges(spark, folder), keep=("seq",))
    return plain(done.events)


@query
def count_where(spark: SparkSession, folder: str) -> DataFrame:
    """Counts under the kinds of predicate that are asked of the event table."""
    good = _good_once(spark, folder)
    predicates = {
        "all": "true",
        "greater": "cumulative_layout_shift > 2.25",
        "equal": "first_input_delay = 24",
        "text": "mob_etype = '3g' and ua_vnd = 'Example Maker'",
        "null": "ua_plt is null",
    }
    return events.count_each(good, predicates)


@query
def event_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Page visits, quits and requests by initiator."""
    good = _good_once(spark, folder)
    return good.groupBy("event_type").agg(F.count("*").alias("n"))


@query
def screen_sizes(spark: SparkSession, folder: str) -> DataFrame:
    good = _good_once(spark, folder)
    return plain(good.groupBy("screen_width", "screen_height").agg(F.count("*").alias("n")))


@query
def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages per hostname."""
    pages = inputs.table(spark, folder, "pages")
    host = urls.hostname(F.col("url")).alias("hostname")
    return pages.select(host).groupBy("hostname").agg(F.count("*").alias("n"))


@query
def timing_delta(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["seq", "connect_duration", "dns_duration", "first_byte_duration"]
    return plain(_typed_once(spark, folder).select(*columns))


@query
def round_param(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_typed_once(spark, folder).select("seq", "mob_dl"))


@query
def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Creation time, with the arrival time where it is absent, and the day it falls on."""
    return plain(_good_once(spark, folder).select("seq", "created_at", "event_date"))


@query
def rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Beacons and form requests that cannot be stored, with the reason."""
    from_lines = _typed(spark, folder, "seq", "reason")
    typed_forms = events.type_beacons(_forms(spark, folder)).select("seq", "reason")
    from_forms = materialise(typed_forms, "typed_forms")
    both = beacons.union_beacons(
        from_lines.withColumn("source", F.lit("lines")), from_forms.withColumn("source", F.lit("forms"))
    )
    return both.where("reason is not null").select("source", "seq", "reason")


@query
def form_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of form-encoded requests; repeated keys keep the first value."""
    value = lambda key: F.try_element_at("params", F.lit(key))
    return _forms(spark, folder).select(
        "seq",
        value("u").alias("u"),
        value("rt.si").alias("rt_si"),
        value("n").alias("n"),
        value("flag").alias("flag"),
        value("mob.dl").alias("mob_dl"),
        value("label").alias("label"),
        F.size("params").cast("bigint").alias("parameters"),
        "unreadable",
    )


@query
def form_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Agent and header place of form requests whose archive lines enter again as beacons."""
    requests = inputs.form_requests(spark, folder, headers=True)
    lines = archives.archive_lines(beacons.parse_requests(requests))
    again = beacons.parse_lines(lines.select("value", "seq", F.col("day").cast("timestamp").alias("received_at")))
    return events.type_beacons(again).select(
        "seq", "user_agent", F.col("header_country").alias("country"), F.col("header_city").alias("city"), "lookup_ip"
    )


@query
def event_table(spark: SparkSession, folder: str) -> DataFrame:
    """Write the day-partitioned table, then read some of its days."""
    path = scratch_path(spark, "events")
    good = _good(spark, folder)
    missing = [f for f in EVENT_SCHEMA.fields if f.name not in good.columns]
    rows = good.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    tables.write_events(rows.select(*EVENT_NAMES), path)
    days = tables.read_events(spark, path).where("event_date between '2024-01-10' and '2024-01-20'")
    return plain(
        days.groupBy("event_date", "hostname").agg(
            F.count("*").alias("n"), F.sum("largest_contentful_paint").alias("paint")
        )
    )


@query
def schema_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Days written with the first version of the table, later days with the second, read as one."""
    path = scratch_path(spark, "versions")
    good = _good(spark, folder)
    columns = [c for c in EVENT_SCHEMA_V1.names if c in good.columns]
    old = good.where(F.col("event_date") < F.lit(V2_SINCE)).select(*columns)
    new = good.where(F.col("event_date") >= F.lit(V2_SINCE)).select(
        *columns, "mob_dl", "mob_rtt", "mob_etype"
    )
    tables.laid_out(old).write.partitionBy("event_date").parquet(path)
    tables.laid_out(new).write.partitionBy("event_date").mode("append").parquet(path)
    return plain(
        tables.read_events(spark, path)
        .groupBy("event_date")
        .agg(
            F.count("*").alias("n"),
            *[F.count(c).alias(f"{c}_known") for c in ("mob_dl", "mob_rtt", "mob_etype")],
            F.sum("mob_dl").alias("mob_dl_total"),
        )
    )


# -- dimensions -------------------------------------------------------------------------------


def _agent_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _good(spark, folder, "seq", "event_date", "user_agent").drop("reason")


@query
def ua_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct user agents with browser, system, brand, type and number of events."""
    found = agents.distinct_agents(_agent_rows(spark, folder))
    return agents.classify_agents(found, agent_rules.default_rules(spark))


@query
def ua_rules_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same dimension by a rule file of some hundred rules, written as JSON lines and read back.

    The first rules are the default ones; behind them one for each market segment in each nation.
    """
    path = scratch_path(spark, "rules")
    groups = inputs.table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()
    more = groups.select(
        F.lit("browser").alias("kind"),
        (F.col("c_nationkey") + 1000).cast("bigint").alias("rule_no"),
        F.concat("c_mktsegment", F.lit("-"), "c_nationkey", F.lit(r"/([0-9]+)\.([0-9]+)")).alias("regex"),
        F.col("c_mktsegment").alias("family"),
    )
    rules = agent_rules.default_rules(spark).select(*agent_rules.FIELDS)
    rules.unionByName(more, allowMissingColumns=True).write.json(path)
    found = agents.distinct_agents(_agent_rows(spark, folder))
    return agents.classify_agents(found, agent_rules.read_rules(spark, path))


@query
def ua_rules_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """The same dimension by a YAML file of over a thousand rules.

    The format has versions in groups 2 to 4, so rules that have them from group 1 on get an empty group in front.
    """
    path = f"{scratch_path(spark, 'rules')}.yaml"
    groups = inputs.table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()
    numbered = groups.withColumn("release", F.explode(F.sequence(F.lit(1), F.lit(10))))
    more = numbered.select(
        F.lit("browser").alias("kind"),
        (F.col("c_nationkey") * 10 + F.col("release") + 1000).cast("bigint").alias("rule_no"),
        F.concat_ws("-", "c_mktsegment", "c_nationkey", "release", F.lit(r"([0-9]+)\.([0-9]+)")).alias("regex"),
        F.col("c_mktsegment").alias("family"),
    )
    rules = agent_rules.default_rules(spark).select(*agent_rules.FIELDS).unionByName(more, allowMissingColumns=True)
    shifted = F.col("v1") == "$1"
    rules = rules.withColumn("regex", F.concat(F.when(shifted, F.lit("()")).otherwise(F.lit("")), "regex"))
    rules = rules.withColumn("v1", F.when(~shifted, F.col("v1")))
    sections = []
    for section, kind in agent_rules.YAML_SECTIONS.items():
        fields = [F.col(field).alias(key) for key, field in agent_rules.YAML_FIELDS[kind].items() if field not in ("v2", "v3")]
        entry = F.when(F.col("kind") == kind, F.struct("rule_no", F.struct("regex", *fields).alias("entry")))
        sections.append(F.transform(F.array_sort(F.collect_list(entry)), lambda numbered: numbered["entry"]).alias(section))
    rules.agg(*sections).select(F.to_json(F.struct("*"))).coalesce(1).write.text(path)  # JSON is YAML
    found = agents.distinct_agents(_agent_rows(spark, folder))
    return agents.classify_agents(found, agent_rules.read_rules(spark, path))


@query
def ua_increment(spark: SparkSession, folder: str) -> DataFrame:
    """The same dimension, grown in two steps, the second for agents not seen in the first."""
    rows = _agent_rows(spark, folder)
    rules = agent_rules.default_rules(spark)
    path = scratch_path(spark, "agent_dim")
    agents.extend_dimension(rows.where(F.col("event_date") < F.lit(V2_SINCE)), rules, path, 0)
    return agents.extend_dimension(rows, rules, path, 1)


@query
def ua_join(spark: SparkSession, folder: str) -> DataFrame:
    """Events per browser and device type, by the join for dimensions too large to broadcast."""
    rows = _agent_rows(spark, folder)
    found = agents.classify_agents(
        agents.distinct_agents(rows), agent_rules.default_rules(spark)
    )
    dim = materialise(found, "agent_dim")
    joined = lookups.lookup_join(rows, dim, "user_agent", broadcast_bytes=0, hot_keys=20)
    named = agents.with_agent_defaults(joined)
    return named.groupBy("browser_name", "device_type").agg(F.count("*").alias("n"))


@query
def geo_range(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every address by ranges, the narrowest that holds it."""
    lines = beacons.parse_lines(inputs.beacon_lines(spark, folder))
    rows = materialise(lines.select("seq", F.col("client_ip").alias("lookup_ip")), "addresses")
    return _located(rows, _ranges(spark, folder))


@query
def geo_range_v6(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the addresses and ranges of an IPv6 network."""
    known = inputs.visits(spark, folder).where(f"not ({inputs.MISSING})")
    address = F.when(F.expr("event_id % 11 != 0"), F.expr(inputs.v6(inputs.ADDRESS)))
    rows = materialise(known.select(F.col("event_id").alias("seq"), address.alias("lookup_ip")), "addresses")
    return _located(rows, ranges.keyed_ranges(inputs.address_ranges(spark, folder, inputs.v6)))


def _located(rows: DataFrame, of: DataFrame) -> DataFrame:
    found = places.locate(places.distinct_addresses(rows), of)
    dim = materialise(found, "places")
    joined = lookups.lookup_join(rows, dim, "lookup_ip")
    empty = F.lit("")
    return joined.select(
        "seq",
        F.coalesce("ip_country", empty).alias("country"),
        F.coalesce("ip_city", empty).alias("city"),
    )


@query
def geo_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Place by headers, or by address where both header values are empty."""
    rows = _typed(spark, folder, "seq", "header_country", "header_city", "lookup_ip")
    found = places.locate(places.distinct_addresses(rows), _ranges(spark, folder))
    joined = lookups.lookup_join(rows, materialise(found, "places"), "lookup_ip")
    country, city = places.fallback_place()
    return joined.select("seq", country.alias("country"), city.alias("city"))


# -- last-write-wins tables -------------------------------------------------------------------


@query
def host_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Hostname log written and read back, current row per hostname."""
    path = scratch_path(spark, "hostnames")
    tables.append_log(latest.hostnames_seen(_typed_once(spark, folder)), path)
    log = tables.read_log(spark, path, HOSTNAME_SCHEMA)
    return plain(latest.hostname_registry(log))


@query
def subscription_register(spark: SparkSession, folder: str) -> DataFrame:
    return plain(subscriptions.register(inputs.owner_requests(spark, folder)))


def _owner_view(spark: SparkSession, folder: str) -> DataFrame:
    """Owners as of the log of registrations and deletions, both written and read back."""
    log_path, deletes_path = scratch_path(spark, "owners"), scratch_path(spark, "owner_deletes")
    tables.append_log(subscriptions.register(inputs.owner_requests(spark, folder)), log_path)
    tables.append_log(inputs.owner_deletes(spark, folder), deletes_path)
    log = tables.read_log(spark, log_path, OWNER_SCHEMA)
    return subscriptions.owners(log, spark.read.parquet(deletes_path))


@query
def owners_current(spark: SparkSession, folder: str) -> DataFrame:
    """Last registration per owner and hostname that was not deleted after it."""
    return plain(_owner_view(spark, folder))


@query
def registry_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Owners from a log that is written in four batches and compacted after the second and, in part, after the third."""
    given, gone = subscriptions.register(inputs.owner_requests(spark, folder)), inputs.owner_deletes(spark, folder)
    last = inputs.owner_requests(spark, folder).agg(F.max("seq")).head()[0] or 0
    log = CompactedLog(spark, scratch_path(spark, "owner_log"), OWNER_SCHEMA, subscriptions.OWNER_KEYS, segment_span=max(last // 16, 1))
    for batch in range(4):
        span = F.col("seq").between(batch * last // 4 + (batch > 0), (batch + 1) * last // 4)
        log.append(given.where(span))
        log.delete(gone.where(span))
        if batch == 1:
            log.compact()
        elif batch == 2:
            log.compact(upto=5 * last // 8)
    return plain(log.read())


@query
def owner_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """All registrations that no later deletion removes."""
    log = subscriptions.register(inputs.owner_requests(spark, folder))
    left = latest.without_deleted(
        log, inputs.owner_deletes(spark, folder), subscriptions.OWNER_KEYS
    )
    return plain(left)


@query
def subscriptions_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """One row per subscription; some are shared by several hostnames here."""
    requests = inputs.owner_requests(spark, folder)
    shared = requests.withColumn("request_id", F.col("seq") % 3)
    view = subscriptions.owners(subscriptions.register(shared))
    return plain(subscriptions.subscriptions(view))


@query
def subscription_get(spark: SparkSession, folder: str) -> DataFrame:
    """The subscription with a given identifier: here the last one in text order."""
    view = _owner_view(spark, folder)
    last = F.max_by(F.struct(*view.columns), "subscription_id").alias("last")
    wanted = view.agg(last).where("last is not null").select("last.*")
    return plain(subscriptions.subscriptions(wanted).select("subscription_id", "subscription_expire_at", "hostname"))


@query
def subscription_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Status, at a fixed time, of every subscription ever given out."""
    asked = subscriptions.register(inputs.owner_requests(spark, folder)).select(
        "subscription_id", "hostname"
    )
    as_of = F.lit(AS_OF).cast("timestamp")
    found = subscriptions.lookup(asked, _owner_view(spark, folder), as_of)
    return found.select("subscription_id", "hostname", "status")


# -- archives ---------------------------------------------------------------------------------


@query
def archive_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Line ranges of every hour within its host-day."""
    return plain(archives.hour_ranges(_archive_lines(spark, folder)))


@query
def archive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Archive lines with their number in the day file.  They are written once, and then counted and numbered."""
    written = materialise(_archive_lines(spark, folder), "lines")
    lines = archives.with_arrival_block(written, size=500)
    return plain(
        archives.number_lines(lines).select("host", "day", "hour", "seq", "line_no", "value")
    )


@query
def archive_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hour files written and read back."""
    root = scratch_path(spark, "hours")
    archives.write_hours(_archive_lines(spark, folder), root, "000000000000")
    lines = archive_files.read_hour_files(spark, root)
    return plain(lines.select("host", "day", "hour", "value"))


def _compacted(spark: SparkSession, folder: str, codec: str) -> tuple[str, str]:
    day_root, meta_root = scratch_path(spark, "days"), scratch_path(spark, "meta")
    lines = materialise(_archive_lines(spark, folder), "lines")
    archives.compact(lines, day_root, meta_root, codec, order=("seq",))
    return day_root, meta_root


@query
def archive_day(spark: SparkSession, folder: str) -> DataFrame:
    """One day's hour files, the first of a month, compacted by the daily job; its lines in file order by number."""
    root, days, meta = (scratch_path(spark, name) for name in ("hours", "days", "meta"))
    archives.write_hours(_archive_lines(spark, folder), root, "000000000000")
    archives.compact_day(spark, root, DAY, days, meta)
    lines = archive_files.read_day_files(spark, days)
    return plain(lines.select("host", "day", "value"))


class _Crash(Exception):
    pass


@query
def archive_day_removed(spark: SparkSession, folder: str) -> DataFrame:
    """The daily job with removal of the hour files, interrupted between its phases and run again."""
    root, days, meta = (scratch_path(spark, name) for name in ("hours", "days", "meta"))
    archives.write_hours(_archive_lines(spark, folder), root, "000000000000")

    def crash() -> None:
        raise _Crash

    try:
        archives.compact_day_and_remove(spark, root, DAY, days, meta, between=crash)
    except _Crash:
        pass
    if archives.compact_day_and_remove(spark, root, DAY, days, meta) or archives.lines_of_day(spark, root, DAY) is not None:
        raise RuntimeError("hour files were left")
    return plain(archive_files.read_day_files(spark, days).select("host", "day", "value"))


@query
def archive_days_gzip(spark: SparkSession, folder: str) -> DataFrame:
    """Lines compacted to compressed day files, which are then read back."""
    day_root, _ = _compacted(spark, folder, "GZIP")
    return plain(archive_files.read_day_files(spark, day_root).select("host", "day", "value"))


@query
def archive_days_zstd(spark: SparkSession, folder: str) -> DataFrame:
    day_root, _ = _compacted(spark, folder, "Zstandard")
    return plain(archive_files.read_day_files(spark, day_root, "Zstandard").select("host", "day", "value"))


@query
def archive_days_zst_text(spark: SparkSession, folder: str) -> DataFrame:
    """Day files of zstd-compressed lines, written twice, the second time in place of the first, and read back."""
    root = scratch_path(spark, "zst-days")
    lines = materialise(_archive_lines(spark, folder), "lines")
    archives.write_day_lines_zst(lines.where("seq % 2 = 0"), root)
    archives.write_day_lines_zst(lines, root)
    return plain(archive_files.read_day_lines_zst(spark, root).select("host", "day", "value"))


@query
def archive_meta_files(spark: SparkSession, folder: str) -> DataFrame:
    """Line-range files of compacted days."""
    _, meta_root = _compacted(spark, folder, "NONE")
    return plain(archive_files.read_day_files(spark, meta_root).select("host", "day", "value"))


@query
def archive_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Compacted day files read as beacons again: events per hostname and type."""
    day_root, _ = _compacted(spark, folder, "GZIP")
    again = events.type_beacons(beacons.read_beacons(spark, f"{day_root}/*/*"))
    return (
        events.accepted(again)
        .groupBy("hostname", "session_id")
        .agg(F.count("*").alias("n"), F.sum("mob_dl").alias("mob_dl_total"))
    )


# -- timelines --------------------------------------------------------------------------------


def _timelines(spark: SparkSession, folder: str) -> DataFrame:
    keys = T.StructType([T.StructField(k, T.StringType()) for k in ("u", "c.t.mousepct", "c.t.fps", "c.t.log")])
    parsed = F.from_json("value", keys).alias("params")
    lines = inputs.beacon_lines(spark, folder).where("value is not null").select("seq", parsed)
    return lines.select(
        "seq",
        urls.hostname(F.col("params.u")).alias("hostname"),
        F.col("params")["c.t.mousepct"].alias("mouse"),
        F.col("params")["c.t.fps"].alias("fps"),
        F.col("params")["c.t.log"].alias("log"),
    )


@query
def timeline_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Length, sum and maximum of mouse timelines per hostname, from runs."""
    runs = timelines.with_runs(_timelines(spark, folder), "mouse")
    stats = timelines.timeline_stats(runs, ["hostname"])
    return stats.withColumns({c: F.col(c).try_cast("bigint") for c in ("buckets", "total")})


@query
def timeline_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Beacons, sum and maximum per bucket of the mouse timelines."""
    runs = timelines.with_runs(_timelines(spark, folder), "mouse")
    rows = timelines.bucket_rows(runs, ["seq"])
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest")
    )


@query
def timeline_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Beacons, sum and maximum per mode for every stretch of buckets over which they stay the same, endless timelines included."""
    texts = _timelines(spark, folder).select("log", F.substring("log", 1, 1).alias("mode"))
    found = timelines.bucket_intervals(timelines.with_runs(texts, "log"), ["mode"])
    return found.withColumn("total", F.col("total").try_cast("bigint"))


@query
def timeline_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines of all modes with faulty and endless ones: statistics, bucket rows written, or why they are refused."""
    texts = _timelines(spark, folder).select("seq", "log")
    runs = materialise(timelines.with_runs(texts, "log"), "runs")
    stats = timelines.timeline_stats(runs, ["seq"])
    rows = timelines.bucket_rows(runs, ["seq"]).groupBy("seq").agg(F.count("*").alias("n"))
    refused = timelines.refused(runs, "log").select("seq", "reason")
    found = texts.select("seq").join(stats, "seq", "left").join(rows, "seq", "left").join(refused, "seq", "left")
    return found.select(
        "seq",
        *[F.col(c).try_cast("bigint").alias(c) for c in ("buckets", "total")],
        "largest",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        "reason",
    )


@query
def timeline_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Frame-rate timelines decoded to arrays, shown as text."""
    numbers = timeline_functions.decode(F.col("fps"))
    return _timelines(spark, folder).select("seq", F.array_join(numbers, ",").alias("numbers"))


# -- streams ----------------------------------------------------------------------------------


#: Records in one file of a feed, at about: some 2 KB of JSON each.
FEED_ROWS = 32 * 1024


def _feed_files(records: int, batches: int) -> int:
    """Files of one batch, where so many records make up so many batches: a batch is read by as many tasks as it needs."""
    return max(1, -(-records // (batches * FEED_ROWS)))


def _two_feeds(lines: DataFrame, files: int | None = None) -> list[str]:
    """Every record in one of two feeds; with ``files`` each of so many files."""
    folders = [scratch_path(lines.sparkSession, "feed") for _ in range(2)]
    for half, folder in enumerate(folders):
        part = lines.where(F.col("seq") % 2 == half).select("value", "seq", "received_at")
        (part.repartition(files, "seq") if files else part).write.parquet(folder)
    return folders


def _in_turns(spark: SparkSession, lines: DataFrame, feed: str, start: Callable[[DataFrame], None], turns: int = 2) -> None:
    """Lines in arrival order in ``2 * turns`` parts, each a batch of a few files; after every second part the stream is started again.

    Each part is asked of ``lines`` by its span of ``seq``: pass a written table unless they are cheap to select by it.
    """
    lines, parts = lines.select("value", "seq", "received_at"), 2 * turns
    known = lines.agg(F.max("seq").alias("last"), F.count("*").alias("n")).head()
    last, files = known["last"] or 0, _feed_files(known["n"], parts)
    for part in range(parts):
        span = F.col("seq").between(part * last // parts + (part > 0), (part + 1) * last // parts)
        lines.where(span).repartition(files, "seq").write.mode("append").parquet(feed)
        if part % 2:
            start(jobs.record_stream(spark, feed, files_per_batch=files))


@query
def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by two streams with checkpoints of their own, drained into one event table and read back."""
    out, blocks = scratch_path(spark, "stream_events"), places.prepare(_ranges(spark, folder))
    for half, feed in enumerate(_two_feeds(inputs.beacon_lines(spark, folder))):
        jobs.start_events(
            jobs.record_stream(spark, feed),
            agent_rules.default_rules(spark),
            f"{out}/events",
            f"{out}/rejects",
            f"{out}/agents",
            f"{out}/checkpoint-{half}",
            ranges=blocks,
            drain=True,
        ).awaitTermination()
    return plain(tables.read_events(spark, f"{out}/events"))


@query
def stream_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hostname registry by two streams into one log, each in several batches."""
    out, lines = scratch_path(spark, "stream_hosts"), inputs.beacon_lines(spark, folder)
    files = _feed_files(lines.count(), 4)
    for half, feed in enumerate(_two_feeds(lines, files=2 * files)):
        jobs.start_hostnames(
            jobs.record_stream(spark, feed, files_per_batch=files), f"{out}/log", f"{out}/checkpoint-{half}", drain=True
        ).awaitTermination()
    log = tables.read_log(spark, f"{out}/log", HOSTNAME_SCHEMA)
    return plain(latest.hostname_registry(log).select("hostname", "updated_at"))


@query
def stream_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Hostname registry by a stateful stream, stopped half way and resumed, its log compacted on the way."""
    out = scratch_path(spark, "stream_registry")
    log = CompactedLog(spark, f"{out}/log", HOSTNAME_SCHEMA, ["hostname"], segment_span=2)

    def start(stream: DataFrame) -> None:
        jobs.start_registry(stream, log, f"{out}/checkpoint", drain=True, compact_every=3).awaitTermination()

    _in_turns(spark, inputs.beacon_lines(spark, folder), f"{out}/feed", start)
    return plain(log.read().select("hostname", "updated_at"))


@query
def stream_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Hour archive by two streams, from lines that carry their arrival time."""
    out = scratch_path(spark, "stream_archive")
    for half, feed in enumerate(_two_feeds(_arrived_lines(spark, folder))):
        jobs.start_archive(
            jobs.record_stream(spark, feed), f"{out}/hours", f"{out}/checkpoint-{half}", drain=True
        ).awaitTermination()
    lines = archive_files.read_hour_files(spark, f"{out}/hours")
    return plain(lines.select("host", "day", "hour", "value"))


@query
def stream_event_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Events through the partitioned file sink, stopped half way and resumed; agents are stored in between, as a daily job does."""
    out, rules = scratch_path(spark, "stream_event_sink"), agent_rules.default_rules(spark)
    bests = places.best_of_blocks(places.prepare(_ranges(spark, folder)))

    def start(stream: DataFrame) -> None:
        jobs.start_event_sink(
            stream, rules, f"{out}/events", f"{out}/agents", f"{out}/checkpoint", bests, drain=True
        ).awaitTermination()
        agents.extend_dimension(tables.read_events(spark, f"{out}/events"), rules, f"{out}/agents")

    _in_turns(spark, inputs.beacon_lines(spark, folder), f"{out}/feed", start)
    return plain(tables.read_events(spark, f"{out}/events"))


@query
def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejects through the file sink, stopped half way and resumed, read back."""
    out = scratch_path(spark, "stream_rejects")

    def start(stream: DataFrame) -> None:
        jobs.start_reject_sink(stream, f"{out}/rejects", f"{out}/checkpoint", drain=True).awaitTermination()

    _in_turns(spark, inputs.beacon_lines(spark, folder), f"{out}/feed", start)
    return plain(spark.read.schema("seq bigint, reason string").parquet(f"{out}/rejects"))


@query
def stream_archive_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Hour archive through the partitioned text sink, stopped half way and resumed, read back by its log of commits."""
    out = scratch_path(spark, "stream_archive_sink")

    def start(stream: DataFrame) -> None:
        jobs.start_archive_sink(stream, f"{out}/hours", f"{out}/checkpoint", drain=True).awaitTermination()

    _in_turns(spark, materialise(_arrived_lines(spark, folder), "turn_lines"), f"{out}/feed", start)
    lines = archive_files.read_hour_files(spark, f"{out}/hours")
    return plain(lines.select("host", "day", "hour", "value"))
