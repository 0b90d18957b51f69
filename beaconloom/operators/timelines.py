"""Interaction timelines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconloom.functions.timelines import MAX_ARRAY, decode_runs, length
from beaconloom.session import materialise

# Rows that one step writes of a run; and the buckets beyond which a timeline can only be an attack: a
# client would have to record a bucket each millisecond for 24 days.
CHUNK = 1 << 16
MAX_BUCKETS = 1 << 31
# Buckets of the longest timeline whose runs all begin and end at a 64-bit number.
MOST_COUNTABLE = (1 << 63) - 2


def with_runs(df: DataFrame, column: str) -> DataFrame:
    """Add the decoded ``runs`` of a timeline column; NULL for malformed text."""
    return df.withColumn("runs", decode_runs(F.col(column)))


def run_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: the keys, ``value`` and ``times``.

    The outer form, filtered afterwards: for the plain one Spark adds a filter on the array, which
    decodes it a second time.
    """
    runs = df.select(*keys, F.explode_outer("runs").alias("run")).where("run is not null")
    return runs.select(*keys, "run.value", "run.times")


def timeline_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets, sum and largest value per key, from runs: no bucket is ever written out.

    Sums are 38-digit decimals, as a hostile timeline claims more than 64 bits hold; NULL beyond these.
    """
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    return (
        run_rows(df, keys)
        .groupBy(*keys)
        .agg(
            F.try_sum(wide("times")).alias("buckets"),
            F.try_sum(wide("value") * wide("times")).alias("total"),
            F.max("value").alias("largest"),
        )
    )


def _placed_runs(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The keys and ``run`` (value, times, start) of timelines of up to ``most`` buckets, start by a running sum within the array."""
    starts = F.transform(
        "runs",
        lambda run, at: F.struct(
            run["value"].alias("value"),
            run["times"].alias("times"),
            F.aggregate(
                F.slice("runs", 1, at), F.lit(0).cast("bigint"), lambda sum_, r: sum_ + r["times"]
            ).alias("start"),
        ),
    )
    fitting = F.when(length(F.col("runs")) <= most, starts)
    return df.select(*keys, F.explode_outer(fitting).alias("run")).where("run is not null")


def bucket_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bucket: the keys, ``bucket`` from 0, and ``value``.

    Runs are cut into chunks; each chunk then gives its rows, so that memory does not grow with the run.  Timelines beyond
    ``MAX_BUCKETS`` are refused as a whole: see ``refused``; ``bucket_intervals`` takes them too.
    """
    runs = _placed_runs(df, keys, MAX_BUCKETS)
    end = F.col("run.start") + F.col("run.times") - 1
    chunks = runs.select(
        *keys, "run", end.alias("end"), F.explode(F.sequence("run.start", end, F.lit(CHUNK).cast("bigint"))).alias("first")
    )
    buckets = F.sequence("first", F.least(F.col("first") + CHUNK - 1, F.col("end")))
    return chunks.select(*keys, F.explode(buckets).alias("bucket"), F.col("run.value").alias("value"))


def _pieces() -> Column:
    """A run [start, end) as the fewest aligned stretches: ``level``, whose power of two is the length, and the number of the stretch.

    Up to the roundest number between start and end the stretches grow, behind it they shrink.
    """
    grow = F.filter(F.sequence(F.lit(0), "_top"), lambda level: F.call_function("shiftright", F.col("_middle") - F.col("start"), level) % 2 == 1)
    shrink = F.filter(F.sequence(F.lit(0), "_top"), lambda level: F.call_function("shiftright", F.col("end") - F.col("_middle"), level) % 2 == 1)
    one = F.lit(1).cast("bigint")
    up = lambda level: F.call_function("shiftright", F.col("start") - 1 + F.call_function("shiftleft", one, level), level)
    down = lambda level: F.call_function("shiftright", F.col("end"), level) - 1
    pair = lambda level, number: F.struct(level.alias("level"), number.alias("number"))
    return F.concat(
        F.transform(grow, lambda level: pair(level, up(level))), F.transform(shrink, lambda level: pair(level, down(level)))
    )


def bucket_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """The aggregates of ``bucket_rows`` without its rows: for each interval of buckets over which they stay the same, the keys,
    ``first_bucket``, ``last_bucket``, ``n`` timelines, ``total`` and ``largest``; totals as in ``timeline_stats``.

    Rows grow with the runs and the logarithm of their lengths, whatever lengths they claim.  A run becomes aligned
    stretches, of which a place is in one for each level at most; equal stretches are summed up before they are shuffled.
    The aggregates of a place where some run begins or ends are those of all stretches that it is in, by an equi-join.
    Intervals end before the next such place: the next row of its range of places, or the first one of the next range.
    Timelines beyond ``MOST_COUNTABLE`` buckets are left out as a whole: see ``refused``.
    """
    end = F.col("run.start") + F.col("run.times")
    runs = _placed_runs(df, keys, MOST_COUNTABLE).select(*keys, "run.value", F.col("run.start").alias("start"), end.alias("end"))
    value = F.col("value").cast("decimal(19,0)")
    # Many timelines share their runs: once for each is all that is kept.
    runs = materialise(
        runs.groupBy(*keys, "start", "end").agg(
            F.count("*").alias("n"), F.try_sum(value).cast("decimal(38,0)").alias("total"), F.max("value").alias("largest")
        ),
        "runs",
    )
    sums = [F.sum("n").alias("n"), F.try_sum("total").alias("total"), F.max("largest").alias("largest")]
    whole = runs.withColumn("_top", F.length(F.bin(F.col("start").bitwiseXOR(F.col("end")))) - 1)
    whole = whole.withColumn("_middle", F.expr("shiftleft(shiftright(end, _top), _top)"))
    pieces = whole.select(*keys, F.explode(_pieces()).alias("piece"), "n", "total", "largest")
    pieces = pieces.groupBy(*keys, "piece").agg(*sums)

    places = runs.select(*keys, F.explode(F.array("start", "end")).alias("place")).distinct()
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(62)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("place"), level).alias("number")),
    )
    around = places.select(*keys, "place", F.explode(levels).alias("piece"))
    same = [around[k].eqNullSafe(pieces[k]) for k in keys] + [around["piece"] == pieces["piece"]]
    met = around.join(pieces, same, "left").select(*[around[k] for k in keys], "place", "n", "total", "largest")
    steps = met.groupBy(*keys, "place").agg(*sums)

    order = [*keys, "place"]
    ranges = steps.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "steps")
    firsts = ranges.groupBy("part").agg(F.min(F.struct(*order)).alias("begin"))  # a row for each task
    behind = firsts.select("part", F.lead("begin").over(Window.orderBy("part")).alias("behind"))
    following = F.lead(F.struct(*order)).over(Window.partitionBy("part").orderBy(*order))
    done = ranges.withColumn("following", following).join(F.broadcast(behind), "part")
    last = F.coalesce("following", "behind")["place"] - 1
    return done.where("n is not null").select(
        *keys, F.col("place").alias("first_bucket"), last.alias("last_bucket"), "n", "total", "largest"
    )


def refused(df: DataFrame, column: str, arrays: bool = False, most: int = MAX_BUCKETS) -> DataFrame:
    """Timelines that give no bucket rows though they have text, with the ``reason``; no intervals, if ``most`` is ``MOST_COUNTABLE``.

    For ``arrays``, those that ``expand_runs`` makes no array of: also ``long_timeline``, which ``bucket_rows`` writes out.
    """
    reason = F.when(F.col("runs").isNull(), "bad_timeline").when(
        length(F.col("runs")) > most, "endless_timeline"
    )
    if arrays:
        reason = reason.when(length(F.col("runs")) > MAX_ARRAY, "long_timeline")
    return df.where(F.col(column).isNotNull()).withColumn("reason", reason).where("reason is not null")
