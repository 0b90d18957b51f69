"""Beacon to event row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconloom.functions import dates, numbers, texts, urls
from beaconloom.operators import agents, places
from beaconloom.operators.lookups import lookup_join
from beaconloom.operators.tables import filter_once
from beaconloom.schema import DELTAS, EVENT_COLUMNS, EVENT_NAMES, JSON_NUMBER_KEYS
from beaconloom.session import materialise, remove


def _accessor(beacons: DataFrame):
    """Raw value of a parameter, NULL if it is missing, from a struct or a map of parameters."""
    params = F.col("params")
    if isinstance(beacons.schema["params"].dataType, T.MapType):
        return lambda key: F.try_element_at(params, F.lit(key))
    return lambda key: params[key]


def type_beacons(beacons: DataFrame) -> DataFrame:
    """All typed columns that need no dimension, the dimension keys, and the reject reason.

    One projection, no shuffle.  ``raw`` is kept for rejected rows only, so that what is carried to
    the joins is the narrow typed row and not the beacon.
    """
    value = _accessor(beacons)
    text = lambda key: F.coalesce(value(key), F.lit(""))

    # The arrival time stands in for an absent creation time, not for an empty one.
    created_text = F.coalesce(value("created_at"), dates.timestamp_text(F.col("received_at")))
    created_at, country, city = F.col("_created_at"), F.col("_country"), F.col("_city")
    header_country, header_city = places.header_place(F.col("headers"))
    width, height = texts.screen_size(text("scr.xy"))

    derived: dict[str, Column] = {
        "event_date": F.to_date(created_at),
        "hostname": urls.hostname(text("u"), F.col("_plain_host")),
        "created_at": created_at,
        "event_type": texts.event_type(value("rt.quit"), text("http_initiator")),
        "user_agent": texts.not_empty(F.col("user_agent")),
        "redirect_duration": F.lit(0),
        "redirects_count": F.lit(0),
        "cumulative_layout_shift": numbers.json_decimal(text("c.cls")),
        "screen_width": numbers.whole(width, "int"),
        "screen_height": numbers.whole(height, "int"),
        "mob_dl": numbers.rounded(text("mob.dl")),
    }
    for name, (start, end) in DELTAS.items():
        derived[name] = numbers.clamped_delta(text(start), text(end))

    columns = []
    for name, kind, rule, key in EVENT_COLUMNS:
        if rule == "derived":
            column = derived[name].cast(kind)
        elif rule == "text":
            column = text(key)
        elif rule == "text_null":
            column = texts.not_empty(text(key))
        elif rule == "whole":
            column = numbers.whole(text(key), kind)
        else:
            continue
        columns.append(column.alias(name))

    # A number that its column cannot hold must not become NULL unseen.  Most columns have a value.
    source = {name: text(key) for name, _, rule, key in EVENT_COLUMNS if rule == "whole"}
    source |= {"screen_width": width, "screen_height": height, "mob_dl": text("mob.dl"), "cumulative_layout_shift": text("c.cls")}
    left = [F.when(F.col(name).isNull(), given) for name, given in source.items()]
    misfit = F.concat_ws("\x01", *left).rlike(rf"(?:^|\x01){numbers.DECIMAL[1:-2]}(?:\x01|\z)")

    # One chain of reasons: the first that holds is given.  Misfits and times are told from the typed columns.
    numbers_fit = numbers.are_json_numbers_or_empty([value(key) for key in JSON_NUMBER_KEYS])
    early = (
        F.when(F.col("unreadable").isNotNull(), F.col("unreadable"))
        .when(urls.is_bad_url(text("u"), F.col("_plain_host")), "bad_url")
        .when(~numbers_fit, "bad_number")
    )
    late = F.when(misfit, "bad_number").when(F.col("created_at").isNull(), "bad_created_at")
    return (
        beacons.withColumns(
            {
                "_plain_host": urls.plain_host(text("u")),
                "_created_at": dates.created_at(created_text),
                "_country": header_country,
                "_city": header_city,
            }
        )
        .select(
            *columns,
            "seq",
            country.alias("header_country"),
            city.alias("header_city"),
            F.when((country == "") & (city == ""), texts.not_empty(F.col("client_ip"))).alias(
                "lookup_ip"
            ),
            early.alias("_reason"),
            "raw",
            "params",
        )
        .withColumn("reason", F.coalesce("_reason", late))
        .drop("_reason", "params")
        .withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))
    )


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("reason").isNull())


def rejects(typed: DataFrame) -> DataFrame:
    """Rows that cannot be stored: arrival order, reason, input."""
    return typed.where(F.col("reason").isNotNull()).select("seq", "reason", "raw")


def enrich(
    typed: DataFrame, agent_dim: DataFrame, place_dim: DataFrame | None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Event rows in table order from typed rows and the two dimensions."""
    rows = lookup_join(accepted(typed), agent_dim, "user_agent")
    if place_dim is not None:
        rows = lookup_join(rows, place_dim, "lookup_ip")
    else:
        rows = rows.withColumns({c: F.lit("") for c in ("ip_country", "ip_city")})
    return _in_table_order(rows, keep)


def enrich_rows(
    typed: DataFrame, known: DataFrame, rules: DataFrame, bests: places.Blocks | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Event rows in table order, each row enriched by itself, as a stream needs it."""
    rows = agents.classify_rows(filter_once(typed, F.col("reason").isNull()), known, rules)
    rows = places.locate_rows(rows, bests or places.Blocks(typed, ()))
    return _in_table_order(rows, keep)


def _in_table_order(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of the table, from rows with the facts of their agent and place."""
    country, city = places.fallback_place()
    rows = agents.with_agent_defaults(rows).withColumns(
        {"geo_country_code": country, "geo_city_name": city}
    )
    return rows.select(*EVENT_NAMES, *keep)


@dataclass
class Ingested:
    """Outcome of one batch of beacons: typed rows, event rows and rejects."""

    typed: DataFrame
    events: DataFrame
    rejects: DataFrame
    scratch: list[str]

    def release(self) -> None:
        """Delete the intermediate tables, once the events and rejects are stored."""
        remove(self.typed.sparkSession, self.scratch)


def ingest(
    beacons: DataFrame,
    rules: DataFrame,
    ranges: DataFrame | places.Blocks | None = None,
    agent_table: str | None = None,
    batch: str | None = None,
    keep: tuple[str, ...] = (),
) -> Ingested:
    """Beacons to event rows.

    The beacons are parsed once, into a narrow typed table; the dimension keys are then distinct
    scans of one column of it, and only distinct keys are classified and located.  With an
    ``agent_table`` only agents that no earlier run has classified are, and they are added to it.
    """
    scratch: list[str] = []
    typed = materialise(type_beacons(beacons), "typed", scratch)
    good = accepted(typed)
    if agent_table is None:
        found = agents.classify_agents(agents.distinct_agents(good), rules)
        agent_dim = materialise(found, "agents", scratch)
    else:
        agent_dim = agents.extend_dimension(good, rules, agent_table, batch, scratch)
    place_dim = None
    if ranges is not None:
        if not isinstance(ranges, places.Blocks):
            ranges = places.prepare(ranges, scratch)
        found = places.locate(places.distinct_addresses(good), ranges)
        place_dim = materialise(found, "places", scratch)
    return Ingested(typed, enrich(typed, agent_dim, place_dim, keep), rejects(typed), scratch)


def count_each(events: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Rows that satisfy each of several named predicates (predicate, n), in one pass."""
    counts = [F.count_if(F.expr(p)).alias(f"_{i}") for i, p in enumerate(predicates.values())]
    pairs = [F.struct(F.lit(name).alias("predicate"), F.col(f"_{i}").alias("n")) for i, name in enumerate(predicates)]
    return events.agg(*counts).select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")


def count_where(events: DataFrame, predicate: str | Column = "true") -> DataFrame:
    """Number of rows that satisfy a predicate, as a one-row DataFrame."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return events.where(condition).agg(F.count("*").alias("n"))
