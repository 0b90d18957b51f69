"""IP address text to a fixed-width key.

A key is the 128-bit address as 32 lower-case hex digits, IPv4 in its IPv6-mapped form, so keys of
both families compare correctly as strings and need no 128-bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUP = r"[0-9A-Fa-f]{1,4}"
MAPPED = "00000000000000000000ffff"


def _v4_hex(text: Column) -> Column:
    """Four octets to eight hex digits; call only on valid text."""
    octets = F.transform(F.split(text, r"\."), lambda o: F.lpad(F.hex(o.try_cast("bigint")), 2, "0"))
    return F.lower(F.array_join(octets, ""))


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def _hex_groups(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")


def ip_key(text: Column) -> Column:
    """Address text to its key; NULL if it is not an address (zones and leading zeros are not)."""
    address = F.coalesce(text, F.lit(""))
    is_v4 = address.rlike(rf"^{IPV4}\z")

    # An embedded IPv4 tail is rewritten as two hex groups, then only hex groups are left.
    tail = F.regexp_extract(address, rf":({IPV4})\z", 1)
    tail_hex = _v4_hex(tail)
    v6 = F.when(
        tail != "",
        F.concat(
            F.substr(address, F.lit(1), F.length(address) - F.length(tail)),
            F.substring(tail_hex, 1, 4),
            F.lit(":"),
            F.substring(tail_hex, 5, 4),
        ),
    ).otherwise(address)
    halves = F.split(v6, "::")
    left = _groups(F.try_element_at(halves, F.lit(1)))
    right = F.coalesce(
        _groups(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>")
    )
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = rf"^{GROUP}(?::{GROUP}){{7}}\z"
    short = rf"^(?:{GROUP}(?::{GROUP})*)?::(?:{GROUP}(?::{GROUP})*)?\z"
    is_v6 = v6.rlike(full) | (v6.rlike(short) & (missing >= 1))
    v6_hex = F.concat(
        _hex_groups(left), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), _hex_groups(right)
    )
    return F.when(is_v4, F.concat(F.lit(MAPPED), _v4_hex(address))).when(is_v6, v6_hex)
