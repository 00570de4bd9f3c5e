from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.plans.stream_queries import PORTIONS, arrivals
from quarry.streaming import telemetry as W

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def portion(spark, *rows):
    return spark.createDataFrame([(START + timedelta(minutes=m), u, "x", 1.0) for m, u in rows], "ts timestamp, user_id long, event_type string, value double")


def test_rows_behind_the_watermark_are_dropped_and_state_is_bounded(spark):
    rows = arrivals(spark, SF)
    feed = W.fed(rows, lambda r: W.sessions(r, "6 hours", "5 days"), PORTIONS)
    n, late = rows.count(), rows.where(F.col("portion") >= 6).count() + rows.where("portion between 4 and 5").where(F.datediff("ts", F.lit("2024-01-01")) < 10).count()
    assert sum(p["rows"] for p in feed.progress) == n and late > n / 20
    dropped = sum(p["dropped"] for p in feed.progress)
    assert 0.8 * late <= dropped <= late  # the last of them end before the watermark and are held
    assert max(p["held"] for p in feed.progress) < n / 2
    whole = W.sessions(rows, "6 hours")
    assert feed.out().agg(F.sum("n")).first()[0] <= n - dropped < whole.agg(F.sum("n")).first()[0]


def test_a_session_goes_on_over_a_restart_and_a_late_row_does_not_reopen_it(spark):
    feed = W.Feed(lambda r: W.sessions(r, "30 minutes", "1 hour"), portion(spark))
    feed.take(portion(spark, (0, 1), (10, 1)))
    feed.take(portion(spark, (35, 1), (36, 2)))  # within 30 minutes of the portion before
    feed.take(portion(spark, (50, 1)))  # a row that is older than the newest, but not late
    feed.take(portion(spark, (600, 3)))
    feed.take(portion(spark, (20, 1), (601, 3)))
    feed.take(portion(spark, (20, 1), (602, 3)))
    got = {(r.user_id, r.start, r.end, r.n) for r in feed.out().collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got == {(1, at(0), at(80), 4), (2, at(36), at(66), 1)}
    assert sum(p["dropped"] for p in feed.progress) == 2


def test_an_empty_portion_changes_nothing(spark):
    feed = W.Feed(lambda r: W.windowed(r, "10 minutes", None, "10 minutes"), portion(spark))
    feed.take(portion(spark, (1, 1)))
    feed.take(portion(spark))
    assert feed.out().count() == 0
    feed.take(portion(spark, (100, 1)))
    feed.take(portion(spark))
    assert [(r.n, r.total) for r in feed.out().collect()] == [(1, 1.0)]
