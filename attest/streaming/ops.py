"""Structured Streaming forms. Each takes a streaming (or batch) DataFrame of events and returns one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.sources.shared import shared_dir


#: State on disk, which lists and maps need and many keys want; and Spark's default.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def read_events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream; its time cast to one that watermarks accept."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else d + "/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return not (len(files) == 1 and files[0].rstrip("/").endswith("/events.parquet"))


def run_available(df: DataFrame, mode: str, timers: bool = False) -> DataFrame:
    """The table of ``run_counted``."""
    return run_counted(df, mode, timers)[0]


def run_counted(df: DataFrame, mode: str, timers: bool = False) -> tuple[DataFrame, int]:
    """The table, and how many rows came too late for the first stateful operator. Work off what is there; the result is a table in the shared folder. Each batch has a folder of its own, so one
    that is done again replaces itself; in complete mode the last one counts. ``timers``: start again once all has been
    read, so that the batch without data that fires the timers runs."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/attest-stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/table/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={0 if mode == 'complete' else number}")

    late, before = 0, spark.conf.get(*STORE)
    for _ in range(2 if timers else 1):
        spark.conf.set(STORE[0], ROCKS)
        try:
            q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set(STORE[0], before)  # a query keeps the settings that it started with
        q.awaitTermination()
        # Operators are listed from the last to the first.
        late += sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/table").drop("batch"), late


def rate_windows(events: DataFrame, width: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` events in a window."""
    w = events.withWatermark("ts", width).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions per key with a sliding gap."""
    w = events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    """Activity in sliding windows."""
    w = events.withWatermark("ts", width).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def closed_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Activity in windows, each given out once when it is over; rows more than ``late`` behind the newest are
    dropped, one by one, where repeated events are (before rows are summed), so the progress counts them."""
    w = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def enrich(rows: DataFrame, news: DataFrame, minutes: int) -> DataFrame:
    """(event_id, news_id): rows with the news of the same user that comes at most ``minutes`` later, or null once it can't come
    any more. A join of two streams, both (event_id, user_id, ts); what waits is held no longer than the bound."""
    r = rows.withWatermark("ts", "0 seconds").select("event_id", "user_id", "ts")
    n = news.withWatermark("ts", "0 seconds").select(F.col("event_id").alias("news_id"), F.col("user_id").alias("about"), F.col("ts").alias("came"))
    soon = (F.col("user_id") == F.col("about")) & (F.col("came") >= F.col("ts")) & (F.col("came") <= F.col("ts") + F.expr(f"interval {minutes} minutes"))
    return r.join(n, soon, "leftOuter").select("event_id", "news_id")


def progress(events: DataFrame) -> DataFrame:
    """Furthest stage per user, which never moves back, and events so far."""
    order = {"signup": 0, "view": 1, "click": 2, "error": 3, "purchase": 4}
    stage = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in order.items()])
    return events.groupBy("user_id").agg(F.max(stage).alias("stage"), F.count("*").alias("n"))


def dedup(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first event of each key; repeats within ``ttl`` are dropped."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def fanout(events: DataFrame, members: DataFrame) -> DataFrame:
    """One row for every mentor of the user's session (stream with a static table)."""
    return events.filter("event_type = 'signup'").join(members, "user_id").select("event_id", "mentor_id")
