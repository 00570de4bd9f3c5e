from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.plans import catalog

SF = "/root/testdata/sf0.01"
ACTIONS = {"view": "reserve", "click": "reserve", "purchase": "ack"}
IDLE, MOST = 10_000_000, 3


def plain(events):
    """{message: (status, attempt, reason)} of (event_id, event_type, microseconds), told apart in whole microseconds."""
    messages = defaultdict(list)
    for event_id, kind, at in events:
        messages[f"m-{event_id // 6}"].append((at, ACTIONS.get(kind, "fail")))
    found = {}
    for message, rows in messages.items():
        status, attempt, since, reason = "pending", 0, None, None
        for at, action in sorted(rows):
            if status == "reserved" and action != "ack" and at - since >= IDLE:
                status, attempt = "pending", attempt - 1
            reason = "ok"
            if status in ("acked", "dead"):
                reason = "finished"
            elif action == "reserve" and status == "reserved":
                reason = "already_reserved"
            elif action == "reserve":
                status, attempt, since = "reserved", attempt + 1, at
            elif status != "reserved":
                reason = "not_reserved"
            elif action == "ack":
                status = "acked"
            else:
                status = "dead" if attempt >= MOST else "pending"
        found[message] = (status, attempt, reason)
    return found


def replayed(spark, path):
    return {r.message_id: (r.status, r.attempt, r.reason) for r in catalog.queries()["str02_delivery"](spark, path).collect()}


def test_a_reservation_is_idle_after_seconds(spark, tmp_path):
    messages = [
        [("view", 0.0), ("error", 9.5), ("click", 10.0), ("signup", 19.0), ("view", 20.0), ("error", 29.999999)],  # three failures
        [("view", 0.1), ("click", 10.099999)],
        [("view", 0.1), ("click", 10.1)],  # taken back: the second reservation is the first attempt again
        [("view", 0.0), ("error", 12.0)],
        [("view", 0.0), ("error", 3.0), ("click", 4.0), ("purchase", 40.0), ("error", 41.0)],
    ]
    rows = [(6 * i + j, kind, 1_704_067_200_000_000 + round(at * 1e6)) for i, m in enumerate(messages) for j, (kind, at) in enumerate(m)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, us long")
    events.select("event_id", "event_type", F.timestamp_micros("us").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    want = {"m-0": ("dead", 3, "ok"), "m-1": ("reserved", 1, "already_reserved"), "m-2": ("reserved", 1, "ok"), "m-3": ("pending", 0, "not_reserved"), "m-4": ("acked", 2, "finished")}
    assert plain(rows) == want and replayed(spark, str(tmp_path)) == want


@pytest.mark.parametrize("faster", [1, 100])
def test_messages_are_those_of_a_plain_replay(spark, tmp_path, faster):
    """All events of the table, at their times and a hundred times as fast."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / faster).alias("us"))
    events.select("event_id", "event_type", F.timestamp_micros("us").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    want = plain([tuple(r) for r in events.collect()])
    assert replayed(spark, str(tmp_path)) == want and len(want) == 1667
    assert sum(reason == "already_reserved" for _, _, reason in want.values()) > 10
    if faster > 1:
        assert any(status == "dead" for status, _, _ in want.values())
