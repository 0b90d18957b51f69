import random

from pyspark.sql import functions as F

from beaconloom.functions import timelines as codec
from beaconloom.operators import timelines


LARGEST = (1 << 63) - 1


def decoded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", codec.decode(F.col("t")).alias("d")).orderBy("i").collect()
    return [r.d for r in rows]


def test_golden(spark):
    cases = {
        "07.2s..1a.b": [7, 100, 46, 11],
        "0*c*3zA": [3] * 12 + [35, 36],
        "0.0000000000000001z.": [71],
        "11y2p0ij32e8e7": [LARGEST],
        "0azAZ_-9!": [10, 35, 36, 61, 62, 63, 9, 0],
        "1a,b,1c": [10, 11, 48],
        "1*3*a,b": [10, 10, 10, 11],
        "1a,,b,": [10, 0, 11],
        "2*5*0031__": [0, 0, 0, 0, 0, 31, 100],
        "2x1": [0],
        "": [],
        "0": [],
        "0*3*": [],
        "0*3*.7": [7, 7, 7],
        "05*7": [5, 7],
        "0*0*5": [5],
        "0*2**3*5": [5, 5, 5],
    }
    assert decoded(spark, list(cases)) == list(cases.values())


def test_malformed(spark):
    assert decoded(spark, ["2123", "9123", None, "0.1y2p0ij32e8e8.", "1a!,b", "0*!*5"]) == [None] * 6


def _base36(n):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    return digits[n] if n < 36 else _base36(n // 36) + digits[n % 36]


def _encode(rng, mode, numbers):
    """Encode runs with wrapped numbers and repeats at random; an inverse for testing."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def base36(n):
        text = digits[n % 36]
        return text if n < 36 else base36(n // 36) + text

    out, expected = mode, []
    for value in numbers:
        times = rng.choice([1, 1, 2, 40])
        expected += [value] * times
        out += f"*{base36(times)}*" if times > 1 or rng.random() < 0.2 else ""
        if mode == "1":
            out += base36(value) + ","
        elif mode == "0":
            out += codec.ALPHABET[value] if value < 64 else f".{base36(value)}."
        else:
            out += "__" if value == 100 else f"{value:02d}"
    return out, expected


def test_round_trip(spark):
    rng = random.Random(11)
    pairs = []
    for mode, top in (("0", 5000), ("1", 10**15), ("2", 100)):
        for _ in range(40):
            numbers = [rng.choice([rng.randint(0, 63), rng.randint(0, top)]) for _ in range(rng.randint(0, 30))]
            pairs.append(_encode(rng, mode, numbers))
    assert decoded(spark, [text for text, _ in pairs]) == [numbers for _, numbers in pairs]


def test_rows_and_stats(spark):
    df = spark.createDataFrame(
        [("p1", "0*3*5a"), ("p1", "0_"), ("p2", "2__"), ("p3", "2123"), ("p4", "0*zzzzzzz*1"), ("p5", "1*1y2p0ij32e8e7*1y2p0ij32e8e7")],
        "page string, t string",
    )
    runs = timelines.with_runs(df, "t")
    rows = timelines.bucket_rows(runs.where("page = 'p1'"), ["page"]).collect()
    assert sorted((r.bucket, r.value) for r in rows) == [(0, 5), (0, 62), (1, 5), (2, 5), (3, 10)]
    # A claim of 78 billion buckets is counted, but not written out.
    stats = {r.page: (r.buckets, r.total, r.largest) for r in timelines.timeline_stats(runs, ["page"]).collect()}
    assert stats == {"p1": (5, 87, 62), "p2": (1, 100, 100), "p4": (36**7 - 1, 36**7 - 1, 1), "p5": (LARGEST, LARGEST**2, LARGEST)}
    refused = {r.page: r.reason for r in timelines.refused(runs, "t").collect()}
    assert refused == {"p3": "bad_timeline", "p4": "endless_timeline", "p5": "endless_timeline"}
    arrays = {r.page: r.d for r in runs.select("page", codec.expand_runs(F.col("runs")).alias("d")).collect()}
    assert arrays["p4"] is None and arrays["p5"] is None
    assert timelines.bucket_rows(runs, ["page"]).where("page = 'p4'").count() == 0


def test_long_runs_are_written_in_chunks(spark):
    count = 3 * timelines.CHUNK + 17
    df = spark.createDataFrame([(f"1b,*{_base36(count)}*c,d",)], "t string")
    rows = timelines.bucket_rows(timelines.with_runs(df.withColumn("k", F.lit(1)), "t"), ["k"])
    found = rows.groupBy("value").agg(F.count("*"), F.min("bucket"), F.max("bucket")).collect()
    assert sorted(map(tuple, found)) == [(11, 1, 0, 0), (12, count, 1, count), (13, 1, count + 1, count + 1)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("0a",)], "t string").select(codec.decode(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_timelines_too_long_for_an_array_have_a_reason(spark):
    runs = spark.createDataFrame(
        [("fits", [(1, 1 << 20)]), ("long", [(1, 1 << 20), (2, 1)]), ("endless", [(1, (1 << 31) + 1)]), ("bad", None)],
        "t string, runs array<struct<value: bigint, times: bigint>>",
    )
    reasons = {r.t: r.reason for r in timelines.refused(runs, "t", arrays=True).collect()}
    assert reasons == {"long": "long_timeline", "endless": "endless_timeline", "bad": "bad_timeline"}
    assert {r.t for r in timelines.refused(runs, "t").collect()} == {"endless", "bad"}


def test_intervals_agree_with_bucket_rows(spark):
    draw = random.Random(11)
    texts = []
    for i in range(60):
        runs = [f"*{draw.choice(['1', '3', '7', 'g', '1s', '2k'])}*{draw.choice('0aZ')}" for _ in range(draw.randrange(5))]
        texts.append((draw.choice(["a", "b", None]), "0" + "".join(runs)))
    texts += [("a", None), ("a", ""), ("b", "9x"), ("c", "0*1000*a0")]
    df = timelines.with_runs(spark.createDataFrame(texts, "k string, t string"), "t")
    expected = {}
    for r in timelines.bucket_rows(df, ["k"]).collect():
        expected.setdefault((r.k, r.bucket), []).append(r.value)
    found = timelines.bucket_intervals(df, ["k"]).collect()
    spread = {(r.k, b): (r.n, int(r.total), r.largest) for r in found for b in range(r.first_bucket, r.last_bucket + 1)}
    assert spread == {at: (len(v), sum(v), max(v)) for at, v in expected.items()}
    assert sum(r.last_bucket - r.first_bucket + 1 for r in found) == len(expected)


def test_intervals_of_endless_timelines(spark):
    end = "1y2p0ij32e8e6"  # two less than 2**63 buckets, and one more than can be counted
    texts = ["1*5*a", f"1*{end}*b", f"1*{end}*b,c", "1*zzzzzzzzz*5"]
    df = timelines.with_runs(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    rows = sorted(tuple(map(int, r)) for r in timelines.bucket_intervals(df, []).collect())
    long = 36**9 - 1
    assert rows == [(0, 4, 3, 26, 11), (5, long - 1, 2, 16, 11), (long, (1 << 63) - 3, 1, 11, 11)]
    left = timelines.refused(df, "t", most=timelines.MOST_COUNTABLE).collect()
    assert [(r.t, r.reason) for r in left] == [(texts[2], "endless_timeline")]
    empty = timelines.with_runs(spark.createDataFrame([], "t string"), "t")
    assert timelines.bucket_intervals(empty, []).collect() == []
