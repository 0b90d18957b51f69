"""Country and city: from the proxy's headers, else from the address."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconloom.functions.addresses import ip_key
from beaconloom.functions.maps import header
from beaconloom.functions.texts import clean_header
from beaconloom.session import materialise

# The headers that carry the pair, in lower case.
COUNTRY_HEADER = "cf-ipcountry"
CITY_HEADER = "cf-ipcity"

KEY_DIGITS = 32
DIGITS = "0123456789abcdef"


def header_place(headers: Column) -> tuple[Column, Column]:
    return (
        clean_header(header(headers, COUNTRY_HEADER)),
        clean_header(header(headers, CITY_HEADER)),
    )


@dataclass(frozen=True)
class Blocks:
    """Ranges cut into aligned blocks: a row for each, and the lengths (1 to 32 digits) that blocks have."""

    rows: DataFrame
    lengths: tuple[int, ...]


def _digit(key: str, at: Column) -> Column:
    return F.instr(F.lit(DIGITS), F.substr(F.col(key), at, F.lit(1))) - 1


def _names(key: str, at: Column, low: Column, high: Column) -> Column:
    """Blocks that share the digits of ``key`` before ``at`` and have ``low`` to ``high`` there."""
    head = F.substr(F.col(key), F.lit(1), at - 1)
    steps = F.transform(
        F.sequence(low, high), lambda d: F.concat(head, F.substr(F.lit(DIGITS), d + 1, F.lit(1)))
    )
    return F.when(low <= high, steps).otherwise(F.array().cast("array<string>"))


def _aligned() -> Column:
    """The fewest aligned blocks, by hexadecimal digits, that make up a range: at most 960.

    A network is one block.  Else, at the digit where start and end part, the digits between them are
    whole blocks.  Below, on the start's side those above its digit are, on the end's side those below;
    where only zeros (start) or fs (end) follow, the digit itself is one too.
    """
    part, from_, to = F.col("_part"), F.col("_from"), F.col("_to")

    def level(at: Column) -> Column:
        first = _digit("start_key", at) + F.when(from_ <= at, 0).otherwise(1)
        last = _digit("end_key", at) - F.when(to <= at, 0).otherwise(1)
        none = F.array().cast("array<string>")
        left = F.when(from_ >= at, _names("start_key", at, first, F.lit(15))).otherwise(none)
        right = F.when(to >= at, _names("end_key", at, F.lit(0), last)).otherwise(none)
        between = F.when(at == part, _names("start_key", at, first, last))
        return between.when(at > part, F.concat(left, right)).otherwise(none)

    # Above the parting digit there are none, nor below the last one that is not just zeros (start) or fs (end).
    blocks = F.flatten(F.transform(F.sequence(part, F.greatest(part, from_, to).cast("bigint")), level))
    whole = (from_ < part) & (to < part) & (part > 1)
    return (
        F.when(F.col("start_key") == F.col("end_key"), F.array("start_key"))
        .when(whole, F.array(F.substr(F.col("start_key"), F.lit(1), part - 1)))
        .otherwise(blocks)
    )


def range_blocks(ranges: DataFrame) -> DataFrame:
    """One row per range and aligned block, with the range's width."""
    same = lambda at: F.substr("start_key", at, F.lit(1)) == F.substr("end_key", at, F.lit(1))
    apart = F.transform(F.sequence(F.lit(1), F.lit(KEY_DIGITS)), lambda at: ~same(at))
    # The width is measured below the explosion: beside it, it would be computed again for every block.
    measured = ranges.withColumns(
        {
            "width": _width(),
            "_part": F.array_position(apart, True),
            "_from": F.length(F.rtrim("start_key", F.lit("0"))),
            "_to": F.length(F.rtrim("end_key", F.lit("f"))),
        }
    )
    return measured.select(*ranges.columns, "width", F.explode(_aligned()).alias("block"))


def prepare(ranges: DataFrame, written: list[str] | None = None) -> Blocks:
    """Ranges ready for any number of lookups, written once."""
    rows = materialise(range_blocks(ranges), "range_blocks", written)
    lengths = rows.select(F.length("block").alias("n")).distinct().collect()  # 32 at most
    return Blocks(rows, tuple(sorted(r["n"] for r in lengths)))


def _width() -> Column:
    """End less start as two 64-bit halves, the carry taken from the upper one; pairs compare as numbers do."""
    half = lambda key, at: F.conv(F.substring(key, at, 16), 16, 10).cast("decimal(20,0)")
    upper = half("end_key", 1) - half("start_key", 1)
    lower = half("end_key", 17) - half("start_key", 17)
    carry = lower < 0
    return F.struct(
        F.when(carry, upper - 1).otherwise(upper).alias("upper"),
        F.when(carry, lower + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(lower).alias("lower"),
    )


def _rank() -> Column:
    """The least is the best: the narrowest range, of these the latest start, by the complement of its digits."""
    later = F.translate("start_key", "0123456789abcdef", "fedcba9876543210").alias("later")
    return F.struct("width", later, "country", "city")


def best_of_blocks(blocks: Blocks, written: list[str] | None = None) -> Blocks:
    """The best range of each block, written once: what ``locate_rows`` looks up."""
    best = blocks.rows.groupBy("block").agg(F.min(_rank()).alias("best"))
    return Blocks(materialise(best, "block_bests", written), blocks.lengths)


def locate_rows(rows: DataFrame, bests: Blocks) -> DataFrame:
    """Add ``ip_country`` and ``ip_city`` by ``lookup_ip`` to each row, NULL where nothing is found.

    The same choice as ``locate`` makes, without a group, so that a stream can use it: one equi-join for each length that blocks
    have (32 at most), with a block at most once on the right, so that rows never multiply.
    """
    keyed, found = rows.withColumn("_ip_key", ip_key(F.col("lookup_ip"))), []
    # Rows without an address meet no block: spread out, should a join shuffle.
    key = F.coalesce("_ip_key", F.concat(F.lit("-"), F.xxhash64("seq").cast("string")))
    for n in bests.lengths:
        of_length = bests.rows.where(F.length("block") == n).select(F.col("block").alias(f"_block{n}"), F.col("best").alias(f"_best{n}"))
        keyed = keyed.join(of_length, F.substring(key, 1, n) == F.col(f"_block{n}"), "left")
        found.append(F.col(f"_best{n}"))
    if not found:
        return rows.withColumns({name: F.lit(None).cast("string") for name in ("ip_country", "ip_city")})
    best = F.array_min(F.array(*found))
    return keyed.select(*rows.columns, best["country"].alias("ip_country"), best["city"].alias("ip_city"))


def distinct_addresses(rows: DataFrame) -> DataFrame:
    """Each address that needs a lookup once, with the number of rows that have it."""
    return (
        rows.where(F.col("lookup_ip").isNotNull())
        .groupBy("lookup_ip")
        .agg(F.count("*").alias("n"))
    )


def locate(addresses: DataFrame, ranges: DataFrame | Blocks) -> DataFrame:
    """Place of each distinct address (``lookup_ip``, ``n``); the narrowest range that holds it wins.

    Ranges may overlap in any way.  Of equally narrow ones the later wins, then the smaller country and
    city.  A plain range condition would be planned as a nested loop, and a join by coarse buckets pairs
    whatever shares one.  Here an address is in a range exactly if one of its leading parts is a block
    of it, so the join is an equality, its rows are the ranges that hold the address, and nothing is
    compared in vain.  Addresses in no range, or that are none, are left out.
    """
    blocks = ranges if isinstance(ranges, Blocks) else prepare(ranges)
    keyed = addresses.select("lookup_ip", "n", ip_key(F.col("lookup_ip")).alias("ip_key"))
    # No filter on the key: it would be pushed below the distinct and parse every row's address.
    heads = [F.substring("ip_key", 1, n) for n in blocks.lengths]
    names = F.array(*heads) if heads else F.array().cast("array<string>")
    # Never broadcast the addresses: their estimate leaves out that each becomes a row for every length.
    asked = keyed.select("*", F.explode(names).alias("block")).hint("merge")
    inside = asked.join(blocks.rows, "block")
    best = inside.groupBy("lookup_ip", "n").agg(F.min(_rank()).alias("best"))
    return best.select(
        "lookup_ip",
        "n",
        F.col("best.country").alias("ip_country"),
        F.col("best.city").alias("ip_city"),
    )


def fallback_place() -> tuple[Column, Column]:
    """Header pair, or the pair found by address if both header values are empty.

    It is the pair that falls back, never one of its two fields.
    """
    country, city = F.col("header_country"), F.col("header_city")
    missing = (country == "") & (city == "")
    empty = F.lit("")
    return (
        F.when(missing, F.coalesce("ip_country", empty)).otherwise(country),
        F.when(missing, F.coalesce("ip_city", empty)).otherwise(city),
    )
