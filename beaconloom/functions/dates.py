"""Timestamps, trial periods and subscription identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconloom.schema import TIMESTAMP_TEXT

TRIAL_MONTHS = 3
CREATED_AT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def created_at(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp; NULL for anything else."""
    return F.when(text.rlike(CREATED_AT), text.try_cast("timestamp"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_TEXT)


def trial_end(now: Column, months: int = TRIAL_MONTHS) -> Column:
    """``now`` plus calendar months; a day the target month lacks rolls into the next month.

    30 November plus three months is 1 March (or 29 February in no year at all), where
    ``add_months`` alone would stop at the last day of February.
    """
    first_of_target = F.add_months(F.trunc(now, "MM"), months)
    day = F.date_add(first_of_target, F.dayofmonth(now) - 1)
    time_of_day = now - F.date_trunc("DAY", now)
    return day.cast("timestamp") + time_of_day


def subscription_id(expires_at: Column, request_id: Column | None = None) -> Column:
    """Expiry day and a unique part, joined by ``|``.

    Pass ``request_id`` for results that a rerun can repeat; a random identifier is used without it.
    """
    unique = F.uuid() if request_id is None else request_id.cast("string")
    return F.concat_ws("|", F.date_format(expires_at, "yyyy-MM-dd"), unique)


def is_expired(expires_at: Column, as_of: Column) -> Column:
    """Strictly after the expiry; at the very moment of expiry it still holds."""
    return as_of > expires_at
