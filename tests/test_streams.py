"""Streams over several batches, out of order, against the rules applied to the whole log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attest.plans import extra
from attest.streaming import ops, stateful

START = datetime(2024, 1, 1)


def streamed(spark, tmp_path, batches, schema):
    """One file a batch, oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("ordered", [True, False])
def test_inbox(spark, tmp_path, ordered):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 4), START + timedelta(seconds=i), rng.choice([None, 1, 2, 3]), rng.choice(["news"] * 5 + ["item", "all"])) for i in range(300)]
    come = rows if ordered else rng.sample(rows, len(rows))
    stream = streamed(spark, tmp_path, [come[i : i + 60] for i in range(0, 300, 60)], "event_id long, user_id long, ts timestamp, item int, what string")
    feed = ops.run_available(stateful.inbox(stream), "append")
    got = {(r["event_id"], r["user_id"]) for r in extra._last(feed, "unread").collect()}
    want = set()
    for i, user, ts, item, what in rows:
        covered = any(u == user and t >= ts and (w == "all" or (w == "item" and x == item and item is not None)) for _, u, t, x, w in rows if w != "news")
        if what == "news" and not covered:
            want.add((i, user))
    assert got == want and want
    assert feed.filter("action = 'read'").count() > 0


def test_inbox_is_one_row_of_state_a_user(spark, tmp_path):
    """Whatever it holds; each part that a user's rows must ask a store for is a round trip."""
    rows = [(100 * u + i, u, START + timedelta(seconds=i), i % 7, "news" if i % 2 else "all" if i == 20 else "item") for u in range(50) for i in range(40)]
    rows += [(9000, 3, None, 1, "news"), (9001, 60, None, 1, "all"), (9002, 60, START, None, "news"), (9003, 61, None, 1, "news")]
    stream = streamed(spark, tmp_path, [rows[::2], rows[1::2]], "event_id long, user_id long, ts timestamp, item int, what string")
    spark.conf.set(ops.STORE[0], ops.ROCKS)
    try:
        folder = str(tmp_path / "out")
        q = stateful.inbox(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(folder)
    finally:
        spark.conf.set(*ops.STORE)
    q.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]][-1] == 52
    got = {r["event_id"] for r in extra._last(spark.read.parquet(folder), "unread").collect()}
    last = {u: {x: t for _, v, t, x, w in sorted((r for r in rows if r[2] and r[4] == "item"), key=lambda r: r[2]) if v == u} for u in range(50)}
    assert got == {i for i, u, t, x, w in rows[:2000] if w == "news" and t > START + timedelta(seconds=20) and not (x in last[u] and t <= last[u][x])} | {9002, 9003}


def test_retention_over_batches(spark, tmp_path):
    """Each batch pushes the oldest guests' rows out; rows of others stay, and leave no state."""
    rows = [(i, i % 3, START + timedelta(hours=i), i % 3 > 0) for i in range(100)]
    stream = streamed(spark, tmp_path, [rows[i : i + 20] for i in range(0, 100, 20)], "event_id long, user_id long, ts timestamp, guest boolean")
    feed = ops.run_available(stateful.retention(stream, 24), "append", timers=True)
    assert {r["event_id"] for r in extra._last(feed, "kept").collect()} == {i for i, u, ts, guest in rows if not guest or ts >= rows[-1][2] - timedelta(hours=24)}
    assert feed.filter("action = 'kept'").count() == 100


def test_late_rows_are_counted_one_by_one(spark, tmp_path):
    batches = [[(i, START + timedelta(hours=10, minutes=i)) for i in range(50)], [], [(100 + i, START + timedelta(minutes=i)) for i in range(30)] + [(200, START + timedelta(hours=10, minutes=40))]]
    stream = streamed(spark, tmp_path, batches, "event_id long, ts timestamp")
    out, late = ops.run_counted(ops.closed_windows(stream, "15 minutes", "20 minutes"), "append", timers=True)
    assert late == 30 and {r["n"] for r in out.collect()} == {15}


def test_settings_stay(spark):
    before = spark.conf.get(*ops.STORE)
    ops.run_available(ops.progress(ops.read_events(spark, "/root/testdata/sf0.001")), "complete")
    assert spark.conf.get(*ops.STORE) == before
