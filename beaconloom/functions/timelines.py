"""Interaction timelines: a mode digit, then run-length encoded numbers.

Modes: ``0`` one character per number (64-character alphabet), ``1`` base-36 numbers separated by
commas, ``2`` two digits per number with ``__`` for 100.  In all of them ``*n*`` repeats the number
that follows n times and ``.n.`` is one large number, n being base 36.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64 characters of mode 0, in the order of their numbers.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"

# Groups: 1 the last closed repeat count, 2 a wrapped number with its dots, 3 a plain number.
# An opening * or . that is never closed is skipped.
LEAD = r"(?:\*([^*]*)\*|\.(?![^.]*\.)|\*(?![^*]*\*))*+"
TOKENS = {
    "0": rf"(?s){LEAD}(?:(\.[^.]*\.)|(.)|\z)",
    "1": rf"(?s){LEAD}(?:(\.[^.]*\.)|([^,]*,|[^,]+\z)|\z)",
    "2": rf"(?s){LEAD}(?:(\.[^.]*\.)|(..?)|\z)",
}
# Twelve base-36 digits always fit 64 signed bits, thirteen up to the largest number; longer ones are malformed.
BASE36 = r"^0*[0-9A-Za-z]{1,12}\z"
LONG_BASE36 = r"^0*[0-9A-Za-z]{13}\z"
LARGEST_BASE36 = "1y2p0ij32e8e7"
# Timelines of more buckets are not made an array.
MAX_ARRAY = 1 << 20

RUN = "array<struct<value:bigint,times:bigint>>"


def _base36(text: Column) -> Column:
    fits = text.rlike(LONG_BASE36) & (F.lower(F.substr(text, F.lit(-13), F.lit(13))) <= LARGEST_BASE36)
    return F.when(text.rlike(BASE36) | fits, F.conv(text, 36, 10).cast("bigint")).when(
        text == "", F.lit(0).cast("bigint")
    )


def _plain(mode: str, text: Column) -> Column:
    if mode == "0":
        # An unknown character counts as 0.
        return F.greatest(F.instr(F.lit(ALPHABET), text) - 1, F.lit(0)).cast("bigint")
    if mode == "1":
        return _base36(F.rtrim(text, F.lit(",")))
    # A pair cut short has no value; other pairs that are not digits count as 0.
    return (
        F.when(F.length(text) < 2, F.lit(None).cast("bigint"))
        .when(text == "__", F.lit(100).cast("bigint"))
        .when(text.rlike(r"^[0-9]{2}\z"), text.try_cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )


def _runs_of_mode(mode: str, body: Column) -> Column:
    pattern = F.lit(TOKENS[mode])
    tokens = F.arrays_zip(
        F.regexp_extract_all(body, pattern, F.lit(1)).alias("times"),
        F.regexp_extract_all(body, pattern, F.lit(2)).alias("wrapped"),
        F.regexp_extract_all(body, pattern, F.lit(3)).alias("plain"),
    )
    numbers = F.filter(tokens, lambda t: (t["wrapped"] != "") | (t["plain"] != ""))
    return F.transform(
        numbers,
        lambda t: F.struct(
            F.when(
                t["wrapped"] != "",
                _base36(F.substr(t["wrapped"], F.lit(2), F.length(t["wrapped"]) - 2)),
            )
            .otherwise(_plain(mode, t["plain"]))
            .alias("value"),
            # No repeat, or a repeat of 0, still gives the number once.
            F.greatest(_base36(t["times"]), F.when(_base36(t["times"]).isNotNull(), 1))
            .cast("bigint")
            .alias("times"),
        ),
    ).cast(RUN)


def decode_runs(text: Column) -> Column:
    """Timeline text to runs of (value, times), never expanded, whatever the repeat counts are.

    ``''`` gives no runs; an unknown mode, an unreadable number or half a pair gives NULL.
    """
    mode, body = F.substring(text, 1, 1), F.substr(text, F.lit(2))
    runs = F.when(text == "", F.array().cast(RUN))
    for name in TOKENS:
        runs = runs.when(mode == name, _runs_of_mode(name, body))
    unreadable = lambda run: run["value"].isNull() | run["times"].isNull()
    # Through a lambda variable, so that the runs are decoded once for the check and the result.
    checked = F.transform(F.array(runs), lambda rs: F.when(~F.exists(rs, unreadable), rs))
    return F.get(checked, F.lit(0))


def length(runs: Column) -> Column:
    """Buckets of a timeline; the largest 64-bit number if there are more."""
    most = F.lit((1 << 63) - 1)
    return F.aggregate(
        runs, F.lit(0).cast("bigint"), lambda sum_, r: F.coalesce(F.try_add(sum_, r["times"]), most)
    )


def expand_runs(runs: Column) -> Column:
    """Runs to the plain array of numbers; NULL beyond ``MAX_ARRAY``, where the runs are to be exploded instead."""
    numbers = F.flatten(
        F.transform(runs, lambda r: F.array_repeat(r["value"], r["times"].cast("int")))
    )
    return F.when(length(runs) <= MAX_ARRAY, numbers)


def decode(text: Column) -> Column:
    """Timeline text to an array of numbers."""
    return expand_runs(decode_runs(text))
