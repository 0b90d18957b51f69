"""Form-encoded request text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconloom.functions.maps import first_per_key

# A raw semicolon or a broken escape makes the whole request unreadable.
UNREADABLE = r";|%(?![0-9A-Fa-f]{2})"


def is_bad_form(body: Column, query: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(body, empty).rlike(UNREADABLE) | F.coalesce(query, empty).rlike(UNREADABLE)


def _pairs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "&"), lambda pair: pair != "")


def parse_form(body: Column, query: Column, headers_json: Column | None = None) -> Column:
    """Body, then query string, to a map; the first value of a repeated key wins.

    The headers, if given and not NULL, become the parameter ``request_headers``, under which the
    archive keeps them.  NULL for an unreadable request.
    """
    pairs = F.concat(_pairs(body), _pairs(query))
    keys = F.transform(pairs, lambda p: F.try_url_decode(F.substring_index(p, "=", 1)))
    values = F.transform(
        pairs,
        lambda p: F.try_url_decode(
            F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))
        ),
    )
    if headers_json is not None:
        none = F.array().cast("array<string>")
        given = headers_json.isNotNull()
        keys = F.concat(keys, F.when(given, F.array(F.lit("request_headers"))).otherwise(none))
        values = F.concat(values, F.when(given, F.array(headers_json)).otherwise(none))
    return F.when(~is_bad_form(body, query), first_per_key(keys, values))
