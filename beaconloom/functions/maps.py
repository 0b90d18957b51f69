"""Parameter and header maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_per_key(keys: Column, values: Column) -> Column:
    """Build a map from parallel arrays; the first value of a repeated key wins.

    Building the map directly would raise on a repeated key, so repeats are resolved first; without
    repeats, the usual case, the arrays are used as they are.
    """

    def built(arrays: Column) -> Column:
        unique, position = F.array_distinct(arrays["keys"]), lambda k: F.array_position(arrays["keys"], k).cast("int") - 1
        firsts = F.transform(unique, lambda k: F.get(arrays["values"], position(k)))
        return F.when(
            F.size(unique) == F.size(arrays["keys"]), F.map_from_arrays(arrays["keys"], arrays["values"])
        ).otherwise(F.map_from_arrays(unique, firsts))

    # As the element of an array, so that the arrays are made once, not again for every key.
    arrays = F.array(F.struct(keys.alias("keys"), values.alias("values")))
    return F.get(F.transform(arrays, built), F.lit(0))


def parse_headers(lists: Column) -> Column:
    """Map of header lists to parallel arrays of lower-case names and first values.

    Names that differ only in case would clash as map keys; in arrays the first one is found first.
    """
    return F.struct(
        F.transform(F.map_keys(lists), lambda name: F.lower(name)).alias("names"),
        F.transform(F.map_values(lists), lambda values: F.get(values, F.lit(0))).alias("values"),
    )


def header(headers: Column, name: str) -> Column:
    """First value of a header by its lower-case name, ``''`` if it is missing."""
    at = F.array_position(headers["names"], F.lit(name)).cast("int") - 1
    return F.coalesce(F.get(headers["values"], at), F.lit(""))


def first_values(lists: Column) -> Column:
    """Map of lists to map of first values; an empty list gives ``''``."""
    return F.transform_values(lists, lambda _, v: F.coalesce(F.get(v, F.lit(0)), F.lit("")))


def parameter(params: Column, key: str) -> Column:
    """Value of a key in a parameter map, ``''`` if it is missing."""
    return F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(""))


def sorted_json(params: Column) -> Column:
    """Map to one JSON object with sorted keys.

    ``< > &`` and the two Unicode line separators are written as ``\\u`` escapes.  They can only
    occur inside JSON strings, so replacing them in the finished text is exact.
    """
    text = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(params))))
    for char, escape in [
        ("&", "\\u0026"),
        ("<", "\\u003c"),
        (">", "\\u003e"),
        ("\u2028", "\\u2028"),
        ("\u2029", "\\u2029"),
    ]:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text
