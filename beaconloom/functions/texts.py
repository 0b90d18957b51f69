"""Small text rules: screen size, header cleanup, event type, version strings, day and hour names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_empty(text: Column) -> Column:
    """NULL in place of empty text."""
    return F.when(text != "", text)


def screen_size(text: Column) -> tuple[Column, Column]:
    """``WxH`` to (width, height) text; both empty unless there are exactly two parts."""
    parts = F.split(F.coalesce(text, F.lit("")), "x")
    pair = F.size(parts) == 2
    empty = F.lit("")
    return (
        F.when(pair, F.try_element_at(parts, F.lit(1))).otherwise(empty),
        F.when(pair, F.try_element_at(parts, F.lit(2))).otherwise(empty),
    )


def clean_header(text: Column) -> Column:
    """Trim, drop one leading and one trailing double quote, trim again; NULL reads as ``''``."""
    return F.regexp_extract(
        F.coalesce(text, F.lit("")), r'(?s)^\s*"?\s*(.*?)\s*"?\s*$', 1
    )


def event_type(quit_parameter: Column, initiator: Column) -> Column:
    """The initiator if there is one; else quit or visit by mere presence of the quit parameter."""
    return (
        F.when(initiator != "", initiator)
        .when(quit_parameter.isNotNull(), F.lit("quit_page"))
        .otherwise(F.lit("visit_page"))
    )


def version_text(*parts: Column) -> Column:
    """Join the non-empty parts with dots; NULL if there are none."""
    return not_empty(F.concat_ws(".", *[not_empty(p) for p in parts]))


def first_address(forwarded_for: Column) -> Column:
    """First element of a comma-separated address list; ``''`` if the header is missing."""
    return F.split(F.coalesce(forwarded_for, F.lit("")), ",")[0]


def day_name(day: Column) -> Column:
    """Day directory name, not padded: 2023-9-5."""
    return F.date_format(day, "yyyy-M-d")


def hour_of(ts: Column) -> Column:
    return F.hour(ts)
