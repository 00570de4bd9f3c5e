"""Streams over the events with rows that come too late, beside their batch replay in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.session import table
from quarry.streaming import telemetry as W

PORTIONS = 9

# Five days are a portion. Each tenth event, but for those of the last portion, comes four portions late,
# which is behind the watermark of five days. What ends behind the last watermark isn't closed.
ON_TIME = """d AS (SELECT *, least(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5), 5) AS portion FROM events),
e AS (SELECT * FROM d WHERE event_id % 10 > 0 OR portion = 5), w AS (SELECT max(ts) - INTERVAL 5 day AS mark FROM e)"""


def arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    portion = F.least(F.floor(F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date")) / 5), F.lit(5))
    late = (F.col("event_id") % 10 == 0) & (portion < 5)
    return e.select("ts", "user_id", "event_type", "value", (portion + F.when(late, 4).otherwise(0)).alias("portion"))


@query(f"""WITH {ON_TIME}, g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 0 ELSE 1 END AS first FROM e), n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 hour) AS end_us, count(*) AS n FROM n GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 hour <= (SELECT mark FROM w)""")
def str05_session_stream(spark, sf_dir):
    out = W.fed(arrivals(spark, sf_dir), lambda rows: W.sessions(rows, "6 hours", "5 days"), PORTIONS).out()
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"""WITH {ON_TIME}, s AS (SELECT time_bucket(INTERVAL 2 hour, ts) - INTERVAL (i.range * 2) hour AS start, event_type, value FROM e, range(3) i)
SELECT epoch_us(start) AS start_us, epoch_us(start + INTERVAL 6 hour) AS end_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM s WHERE start + INTERVAL 6 hour <= (SELECT mark FROM w) GROUP BY start, event_type""")
def str05_sliding_stream(spark, sf_dir):
    out = W.fed(arrivals(spark, sf_dir), lambda rows: W.windowed(rows, "6 hours", "2 hours", "5 days"), PORTIONS).out()
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_type", "n", F.round("total", 2).alias("total"))
