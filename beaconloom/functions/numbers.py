"""Numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``\z`` is the very end; ``$`` would also match before a final line break.
WHOLE = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
JSON_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"

MAX_DELTA = 65535
LONG_MAX = 9223372036854775807


def whole(text: Column, kind: str = "bigint") -> Column:
    """Text to a whole number; NULL for anything else.

    The cast itself takes padded text.  Blanks and control characters sort before ``+`` and digits,
    so comparing the first and last character rules them out without a regular expression.
    """
    unpadded = (text >= "+") & (F.substring(text, -1, 1) >= "0")
    return F.when(unpadded, text.try_cast(kind))


def are_json_numbers_or_empty(texts: list[Column]) -> Column:
    """Whether every text is a JSON number, empty or missing; one match over all of them."""
    joined = F.concat_ws("\x01", *[F.coalesce(text, F.lit("")) for text in texts])
    more = rf"(?:\x01(?:{JSON_NUMBER})?){{{len(texts) - 1}}}"
    return joined.rlike(rf"^(?:{JSON_NUMBER})?{more}\z")


def json_decimal(text: Column) -> Column:
    """JSON number text to a float; NULL for empty or missing text and for numbers beyond its range."""
    value = text.try_cast("float")
    return F.when(text.rlike(rf"^{JSON_NUMBER}\z") & (F.abs(value) < F.lit(float("inf"))), value)


def _tick(text: Column) -> Column:
    # Not a number counts as 0, a number too long for 64 bits as the nearest limit.
    limit = F.when(text.startswith("-"), F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    zero = F.lit(0).cast("bigint")
    return F.coalesce(whole(text), F.when(text.rlike(WHOLE), limit).otherwise(zero))


def clamped_delta(start: Column, end: Column) -> Column:
    """``end - start`` held to 0..65535; NULL if either end is missing or empty."""
    first, last = _tick(start), _tick(end)
    inside = F.least(
        F.greatest(F.try_subtract(last, first), F.lit(0).cast("bigint")),
        F.lit(MAX_DELTA).cast("bigint"),
    )
    # A difference beyond 64 bits wraps round: huge positive reads as negative and the reverse.
    wrapped = F.when(last >= 0, F.lit(0)).otherwise(F.lit(MAX_DELTA)).cast("bigint")
    return F.when((start != "") & (end != ""), F.coalesce(inside, wrapped)).cast("int")


def rounded(text: Column) -> Column:
    """Decimal text to the nearest whole number, halves away from zero, in 32-bit precision.

    NULL for empty or malformed text and for values outside the 32-bit float range.
    """
    value = text.try_cast("float").cast("double")
    usable = text.rlike(DECIMAL) & (F.abs(value) < F.lit(float("inf")))
    # Exact: a 32-bit value plus one half always fits a 64-bit float.
    return F.when(usable, (F.signum(value) * F.floor(F.abs(value) + 0.5)).try_cast("int"))
