import datetime as dt

from pyspark.sql import functions as F

from beaconloom.operators import latest, subscriptions, tables
from beaconloom.schema import OWNER_SCHEMA

SCHEMA = "username string, hostname string, registered_at timestamp, request_id string, seq bigint"
T0 = dt.datetime(2023, 5, 1, 12)
HOUR = dt.timedelta(hours=1)


def registered(spark, *rows):
    return subscriptions.register(spark.createDataFrame(list(rows), SCHEMA))


def test_register_twice_keeps_the_later(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(registered(spark, ("test1", "hostname1", T0, "a", 1)), path)
    tables.append_log(registered(spark, ("test1", "hostname1", T0 + HOUR, "b", 2)), path)
    view = subscriptions.owners(tables.read_log(spark, path, OWNER_SCHEMA)).collect()
    assert len(view) == 1
    assert (view[0].username, view[0].subscription_id) == ("test1", "2023-08-01|b")
    assert view[0].subscription_expire_at == dt.datetime(2023, 8, 1, 13)


def test_delete_and_register_again(spark):
    log = registered(spark, ("u", "h1", T0, "a", 1), ("u", "h2", T0, "b", 2), ("u", "h1", T0, "c", 5))
    deletes = spark.createDataFrame(
        [("u", "h1", 3), ("u", "h2", 4), ("u", "h3", 9)], "username string, hostname string, seq bigint"
    )
    rows = latest.without_deleted(log, deletes, subscriptions.OWNER_KEYS).collect()
    assert [(r.hostname, r.seq) for r in rows] == [("h1", 5)]
    both_ways = [
        subscriptions.owners(log, deletes),
        latest.latest(latest.without_deleted(log, deletes, subscriptions.OWNER_KEYS), ["username", "hostname"]),
    ]
    assert sorted(map(str, both_ways[0].collect())) == sorted(map(str, both_ways[1].collect()))
    assert subscriptions.owners(log, deletes.limit(0)).count() == 2


def test_get_lookup_and_list(spark):
    log = registered(spark, ("u", "h1", T0, "a", 1), ("v", "h2", T0, "a", 2), ("w", "h3", T0 + 24 * HOUR, "b", 3))
    view = subscriptions.owners(log)
    listed = {r.subscription_id: r.hostname for r in subscriptions.subscriptions(view).collect()}
    assert listed == {"2023-08-01|a": "h2", "2023-08-02|b": "h3"}
    assert subscriptions.subscription(view, "2023-08-02|b").head().hostname == "h3"
    assert subscriptions.subscription(view, "none").count() == 0
    asked = spark.createDataFrame(
        [("2023-08-01|a", "h1"), ("2023-08-01|a", "h3"), ("2023-08-02|b", "h3")],
        "subscription_id string, hostname string",
    )

    def status(moment):
        found = subscriptions.lookup(asked, view, F.lit(moment).cast("timestamp"))
        return [r.status for r in found.orderBy("subscription_id", "hostname").collect()]

    assert status("2023-08-01 12:00:00") == ["FOUND", "NOT_FOUND", "FOUND"]
    assert status("2023-08-01 12:00:01") == ["EXPIRED", "NOT_FOUND", "FOUND"]


def test_latest_combines_before_the_shuffle(spark):
    log = spark.range(100).selectExpr("id % 3 as key", "id as seq", "id * 2 as value")
    view = latest.latest(log, ["key"])
    assert sorted((r.key, r.value) for r in view.collect()) == [(0, 198), (1, 194), (2, 196)]
    assert "partial_max_by" in view._jdf.queryExecution().executedPlan().toString()
