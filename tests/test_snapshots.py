import random

import pytest
from pyspark.sql import types as T

from beaconloom.operators.snapshots import CompactedLog

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("seq", T.LongType())])


class Both:
    """A log and what should be in it."""

    def __init__(self, spark, path):
        self.spark, self.log, self.rows, self.seq = spark, CompactedLog(spark, str(path), SCHEMA, ["k"], segment_span=100), {}, 0

    def step(self, seed, n, deletes=0):
        rng = random.Random(seed)
        written, gone = [], []
        for _ in range(n):
            self.seq += 1
            key = rng.choice(["hot", "", *[f"k{i}" for i in range(40)]])
            written.append((key, self.seq * 7, self.seq))
            self.rows[key] = written[-1]
        for _ in range(deletes):
            self.seq += 1
            key = rng.choice(["hot", *[f"k{i}" for i in range(50)]])
            gone.append((key, self.seq))
            self.rows.pop(key, None)
        self.log.append(self.spark.createDataFrame(written, SCHEMA))
        if gone:
            self.log.delete(self.spark.createDataFrame(gone, "k string, seq long"))

    def check(self):
        assert sorted(map(tuple, self.log.read().collect()), key=repr) == sorted(self.rows.values(), key=repr)


@pytest.fixture
def both(spark, tmp_path):
    return Both(spark, tmp_path / "log")


def test_reads_are_the_same_at_every_stage(both):
    both.step(1, 150)
    both.check()
    first = both.log.compact()
    assert first.reached == 150
    both.check()
    both.step(2, 120, deletes=12)
    both.check()
    assert both.log.compact().reached == 282 and both.log.compact() is None
    both.check()
    both.step(3, 30, deletes=5)
    both.check()
    both.log.remove_folded()
    assert len(both.log.snapshots()) == 1
    assert sorted(n for n in both.log._children(f"{both.log.path}/log") if n.startswith("segment")) == ["segment=2", "segment=3"]
    both.check()


def test_a_snapshot_may_stop_before_the_end(both):
    both.step(4, 90, deletes=9)
    both.step(5, 90, deletes=9)
    assert both.log.compact(upto=120).reached == 120
    both.check()


def test_an_interrupted_snapshot_is_not_read(spark, both):
    both.step(6, 80)
    both.log.compact()
    both.step(7, 80, deletes=3)
    half = f"{both.log.path}/snapshots/reached-{both.seq:020d}-buckets-000008"
    spark.createDataFrame([("wrong", 1, 1)], SCHEMA).write.parquet(half)
    (path := __import__("pathlib").Path(half) / "_SUCCESS").unlink()
    both.check()
    assert both.log.compact().path == half and path.exists()
    both.check()


def test_only_snapshot_and_tail_are_read(both):
    both.step(8, 450)
    both.log.compact()
    both.step(9, 20)
    query = both.log.read()._jdf.queryExecution()
    plan = query.executedPlan().toString()
    # each side is scanned once, and only the tail is shuffled
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange ") and plan.count("FileScan") == 2
    assert "Bucketed: true" in plan and "PartitionFilters: [isnotnull(segment" in plan
    snapshot = plan[plan.index("snapshot_") - 400 : plan.index("snapshot_")]
    assert "Exchange" not in snapshot
    assert ">= 4)" in plan[plan.index("PartitionFilters: [isnotnull(segment") :][:80]
    both.check()


def test_rows_without_a_key_are_an_error(spark, both):
    with pytest.raises(Exception, match="needs its keys"):
        both.log.append(spark.createDataFrame([(None, 1, 1)], SCHEMA))
