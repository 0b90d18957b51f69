"""Owners, their hostnames and trial subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconloom.functions import dates
from beaconloom.operators.latest import latest, latest_undeleted

OWNER_KEYS = ["username", "hostname"]


def register(requests: DataFrame, request_id: str | None = "request_id") -> DataFrame:
    """Registrations (``username``, ``hostname``, ``registered_at``, ``seq``) to owner rows.

    The trial runs three calendar months from the registration.
    """
    expires = dates.trial_end(F.col("registered_at"))
    unique = F.col(request_id) if request_id else None
    return requests.select(
        "username",
        "hostname",
        dates.subscription_id(expires, unique).alias("subscription_id"),
        expires.alias("subscription_expire_at"),
        "seq",
    )


def owners(log: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Current owner row of each (username, hostname)."""
    if tombstones is None:
        return latest(log, OWNER_KEYS)
    return latest_undeleted(log, tombstones, OWNER_KEYS)


def subscriptions(view: DataFrame) -> DataFrame:
    """One row per subscription; if several hostnames share one, the last written."""
    columns = ["subscription_id", "subscription_expire_at", "hostname", "seq"]
    return latest(view.select(*columns), ["subscription_id"])


def subscription(view: DataFrame, subscription_id: str) -> DataFrame:
    """The subscription with an identifier, or no row."""
    found = view.where(F.col("subscription_id") == subscription_id).limit(1)
    return found.select("subscription_id", "subscription_expire_at", "hostname")


def lookup(requests: DataFrame, view: DataFrame, as_of: Column) -> DataFrame:
    """Requests (``subscription_id``, ``hostname``) with FOUND, NOT_FOUND or EXPIRED as ``status``."""
    keys = ["subscription_id", "hostname"]
    known = latest(view.select(*keys, "subscription_expire_at", "seq"), keys).drop("seq")
    status = (
        F.when(F.col("subscription_expire_at").isNull(), "NOT_FOUND")
        .when(dates.is_expired(F.col("subscription_expire_at"), as_of), "EXPIRED")
        .otherwise("FOUND")
    )
    return requests.join(known, keys, "left").withColumn("status", status)
