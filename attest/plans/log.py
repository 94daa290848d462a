"""More queries over the review log: discussions, revisions, validity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attest.operators import history as ops
from attest.plans import fixtures as fx
from attest.plans.registry import query

L, A = fx.LOG, fx.ATTEMPTS


@query(f"WITH {L} SELECT event_id, user_id, c_name AS author, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS position FROM log JOIN customer ON c_custkey = user_id WHERE kind = 'mentor_feedback'")
def join_comments(spark, d):
    """Comments of each user's items with their authors, in time order."""
    people = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author"))
    rows = fx.log(spark, d).filter("kind = 'mentor_feedback'").join(people, "user_id")
    return rows.select("event_id", "user_id", "author", F.row_number().over(Window.partitionBy("user_id", "item").orderBy("ts", "event_id")).alias("position"))


@query(f"WITH {L} SELECT event_id, item FROM log WHERE item IN (SELECT item FROM log WHERE kind = 'new_attempt') AND kind = 'mentor_feedback'")
def join_thread(spark, d):
    """Discussion rows whose key is among the keys of documents."""
    log = fx.log(spark, d)
    keys = log.filter("kind = 'new_attempt'").select("item").distinct()
    return log.filter("kind = 'mentor_feedback'").join(keys, "item", "left_semi").select("event_id", "item")


@query(f"""WITH {A}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, attempt_type ORDER BY created_at DESC, analysis_id DESC) AS k FROM attempts)
SELECT user_id, max(analysis_id) FILTER (attempt_type = 'F') AS "F", max(analysis_id) FILTER (attempt_type = 'O') AS "O", max(analysis_id) FILTER (attempt_type = 'P') AS "P" FROM x WHERE k = 1 GROUP BY user_id""")
def win_latest_by_type(spark, d):
    """Latest attempt of each type, side by side."""
    last = ops.latest(fx.attempts(spark, d), ["user_id", "attempt_type"], F.struct("created_at", "analysis_id"), "analysis_id")
    return last.groupBy("user_id").pivot("attempt_type", ["F", "O", "P"]).agg(F.first("analysis_id"))


@query(f"WITH {L} SELECT user_id, list(item ORDER BY ts, event_id) AS revisions FROM log WHERE kind IN ('accepted', 'dismissed') GROUP BY user_id")
def win_revisions(spark, d):
    """Revisions of each user, oldest first."""
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "item")))
    return fx.log(spark, d).filter("kind in ('accepted', 'dismissed')").groupBy("user_id").agg(F.transform(parts, lambda p: p["item"]).alias("revisions"))


@query("SELECT event_id, CASE WHEN value BETWEEN 1 AND 5 AND value = floor(value) THEN CAST(value AS INTEGER) END AS confidence, user_id % 3 <> 0 AS consented, CASE WHEN user_id % 3 = 0 THEN 'no consent' WHEN value > 100 THEN 'confidence' ELSE 'ok' END AS verdict FROM events")
def pred_feedback_quality(spark, d):
    """Feedback with consent and a confidence from 1 to 5; the reason where it is set aside."""
    whole = F.col("value").between(1, 5) & (F.col("value") == F.floor("value"))
    consent = F.col("user_id") % 3 != 0
    return fx.table(spark, d, "events").select("event_id", F.when(whole, F.col("value").cast("int")).alias("confidence"), consent.alias("consented"), F.when(~consent, "no consent").when(F.col("value") > 100, "confidence").otherwise("ok").alias("verdict"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'redo' ELSE 'reuse' END AS action FROM events")
def pred_parse_valid(spark, d):
    """A stored parse is reused if it is JSON with the key it must have; else it is done again."""
    stored = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    ok = F.try_variant_get(F.try_parse_json(stored), "$.k", "int").isNotNull()
    return fx.table(spark, d, "events").select("event_id", F.when(ok, "reuse").otherwise("redo").alias("action"))
