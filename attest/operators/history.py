"""Operators over attempts, memberships and the review log: windows, joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_attempts(attempts: DataFrame, *by: str) -> DataFrame:
    """Attempts numbered per key in time order; ties by id."""
    return attempts.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("created_at", "analysis_id")))


def last_n(attempts: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """The n most recent attempts of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("analysis_id"))
    return attempts.withColumn("recent", F.row_number().over(order)).filter(F.col("recent") <= n)


def latest(rows: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """One row per key: the columns of the row with the largest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("last")).select(*keys, "last.*")


def deltas(attempts: DataFrame) -> DataFrame:
    """Change of the score from each attempt to the next of the same user."""
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("created_at", "analysis_id"))
    return attempts.select("analysis_id", "user_id", (F.col("score") - F.coalesce(before, F.lit(0))).alias("delta"))


def standing(attempts: DataFrame, bits: int = 7) -> DataFrame:
    """Share of the user's earlier attempts that each attempt beats; whether it is the best or lowest so far. Scores
    are below 2 to the power of ``bits``.

    Earlier and lower: for each bit that is 1 in the score, count the earlier scores with the same higher bits and a
    0 there. Those are running counts, and each user's rows are spread over the prefixes; no list is kept."""
    order = ["created_at", "analysis_id"]
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    past = attempts.select("analysis_id", "user_id", *order[:1], "score", F.count("score").over(w).alias("n"), F.min("score").over(w).alias("low"))
    levels = past.select("analysis_id", "user_id", "created_at", "score", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    levels = levels.withColumn("power", F.pow(F.lit(2), F.col("bit")).cast("int")).withColumn("one", F.floor(F.col("score") / F.col("power")) % 2 == 1)
    prefix = Window.partitionBy("user_id", "bit", F.floor(F.col("score") / (F.col("power") * 2))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lower = levels.withColumn("lower", F.when(F.col("one"), F.count(F.when(~F.col("one"), 1)).over(prefix)).otherwise(0))
    beaten = lower.groupBy("analysis_id").agg(F.sum("lower").alias("beaten"))
    n = F.col("n")
    label = F.when(n == 0, "first").when(F.col("beaten") == n, "best").when(F.col("score") < F.col("low"), "lowest").otherwise("between")
    return past.join(beaten, "analysis_id").select("analysis_id", "user_id", F.round(F.when(n > 0, F.col("beaten") / F.greatest(n, F.lit(1))), 6).alias("beats"), label.alias("label"))


def candidate_stats(attempts: DataFrame, unscored: str, n: int = 20) -> DataFrame:
    """Over the n most recent scored attempts: latest, best and the scores in order; the total counts all."""
    total = attempts.groupBy("user_id").agg(F.count("*").alias("total"))
    recent = last_n(attempts.filter(F.col("attempt_type") != unscored), n)
    order = F.struct("created_at", "analysis_id")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "analysis_id", "score"))), lambda s: s["score"])
    return recent.groupBy("user_id").agg(F.max_by("score", order).alias("latest"), F.max("score").alias("best"), scores.alias("scores")).join(total, "user_id")


def bucket(score: Column) -> tuple[Column, Column]:
    """(label band, heat-map band) of a score."""
    label = F.when(score >= 70, "strong").when(score >= 50, "fair").otherwise("weak")
    heat = F.when(score.isNull(), "not graded").when(score >= 85, "high").when(score >= 65, "good").when(score >= 40, "mid").otherwise("low")
    return label, heat


def visible(attempts: DataFrame, members: DataFrame, mentor: int) -> DataFrame:
    """Attempts that a mentor may see: those of the members of the mentor's sessions."""
    return attempts.join(members.filter(F.col("mentor_id") == mentor).select("user_id"), "user_id", "left_semi")


def same_company_pairs(attempts: DataFrame) -> DataFrame:
    """Comparable attempts: a user's neighbours in time with the same company, spelled alike but for case."""
    key = F.lower(F.trim("company"))
    before = F.lag("analysis_id").over(Window.partitionBy("user_id", key).orderBy("created_at", "analysis_id"))
    return attempts.withColumn("before", before).filter("before is not null").select("user_id", "before", F.col("analysis_id").alias("after"))


def erase(tables: dict[str, tuple[DataFrame, str, str | None]], user: DataFrame, key: str) -> dict[str, DataFrame]:
    """Delete what users own, from parents to children. tables: name -> (rows, own key, parent's key column);
    in order, each table's rows go if the row above them goes."""
    gone, out = user.select(F.col(key).alias("gone")).distinct(), {}
    for name, (rows, owner, child_key) in tables.items():
        out[name] = rows.join(gone, rows[owner] == gone["gone"], "left_anti")
        if child_key:
            gone = rows.join(gone, rows[owner] == gone["gone"], "left_semi").select(F.col(child_key).alias("gone")).distinct()
    return out


def asof(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Each left row (id, key, ts) with the last right row of the same key at or before it, if not older than
    ``within``: one union and one running window, whatever the number of matches."""
    both = left.select(key, "ts", F.col("event_id").alias("left_id"), F.lit(None).cast("struct<ts:timestamp_ntz,event_id:bigint>").alias("right"), F.lit(1).alias("side"))
    seen = right.select(key, "ts", F.lit(None).cast("long").alias("left_id"), F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id").alias("right"), F.lit(0).alias("side"))
    last = F.last("right", ignorenulls=True).over(Window.partitionBy(key).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0))
    matched = both.unionByName(seen).withColumn("last", last).filter("side = 1")
    fresh = F.col("last.ts") >= F.col("ts").cast("timestamp_ntz") - F.expr(f"interval {within}")
    return matched.select(F.col("left_id").alias("event_id"), key, F.when(fresh, F.col("last.event_id")).alias("match_id"))


def rollup(log: DataFrame) -> DataFrame:
    """Counts in total, by kind, by user, and by user and kind, in one pass."""
    sets = log.groupingSets([[], ["kind"], ["user_id"], ["user_id", "kind"]], "user_id", "kind")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n")).select("level", "user_id", "kind", "n")


def autosaves(log: DataFrame, gap: str) -> DataFrame:
    """Consecutive saves of one user and kind, no further apart than ``gap``, are one revision with the last
    content; any other kind in between starts a new one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = (F.lag("kind").over(order) != F.col("kind")) | (F.lag("ts").over(order) < F.col("ts") - F.expr(f"interval {gap}"))
    rows = log.withColumn("revision", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    return rows.groupBy("user_id", "revision").agg(F.first("kind").alias("kind"), F.count("*").alias("saves"), F.max_by("item", F.struct("ts", "event_id")).alias("item"))


def snapshots(log: DataFrame, minutes: int) -> DataFrame:
    """A decision within ``minutes`` of a snapshot's creation updates it, a later one starts a new snapshot;
    the anchor does not slide, so it is a fold over times. A longer pause starts a snapshot whatever came before, so each
    stretch between pauses is folded by itself."""
    order = Window.partitionBy("user_id").orderBy("at")
    moments = log.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    pause = F.coalesce(F.col("at") - F.lag("at").over(order) > minutes * 60_000_000, F.lit(True)).cast("int")
    stretches = moments.withColumn("pause", pause).withColumn("stretch", F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    times = stretches.groupBy("user_id", "stretch").agg(F.array_sort(F.collect_list("at")).alias("times"))
    start = F.struct(F.lit(-(1 << 60)).cast("long").alias("anchor"), F.lit(0).alias("made"))

    def step(acc: Column, t: Column) -> Column:
        new = t - acc["anchor"] > minutes * 60_000_000
        return F.struct(F.when(new, t).otherwise(acc["anchor"]).alias("anchor"), (acc["made"] + new.cast("int")).alias("made"))

    each = times.select("user_id", F.aggregate("times", start, step)["made"].cast("long").alias("made"), F.size("times").cast("long").alias("n"))
    return each.groupBy("user_id").agg(F.sum("made").alias("snapshots"), F.sum("n").alias("decisions"))


def decision_state(log: DataFrame) -> DataFrame:
    """Latest decision per user and item; what came before the user's last replace-all doesn't count, and a
    decision that was taken back is none."""
    wipe = log.filter("kind = 'new_attempt'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("floor"))
    rows = log.filter("kind in ('accepted', 'dismissed', 'mark_read')").join(wipe, "user_id", "left").filter("floor is null or struct(ts, event_id) > floor")
    return latest(rows, ["user_id", "item"], F.struct("ts", "event_id"), "kind").filter("kind <> 'mark_read'").withColumnRenamed("kind", "decision")


def effective(log: DataFrame) -> DataFrame:
    """Per user: the newest edit whose feedback wasn't dismissed afterwards."""
    edits = log.filter("kind = 'mentor_feedback'")
    gone = log.filter("kind = 'dismissed'").groupBy("user_id", "item").agg(F.max("ts").alias("gone"))
    live = edits.join(gone, ["user_id", "item"], "left").filter("gone is null or gone < ts")
    return latest(live, ["user_id"], F.struct("ts", "event_id"), "event_id", "item")


def unchanged(log: DataFrame) -> DataFrame:
    """Saves without those equal to the content before them."""
    before = F.lag("item").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return log.withColumn("before", before).filter(~F.col("item").eqNullSafe(F.col("before"))).drop("before")


def job_status(log: DataFrame) -> DataFrame:
    """Latest state of each job (user, item)."""
    state = F.when(F.col("kind") == "new_attempt", "queued").when(F.col("kind") == "accepted", "completed").when(F.col("kind") == "dismissed", "failed").otherwise("running")
    return latest(log.withColumn("status", state), ["user_id", "item"], F.struct("ts", "event_id"), "status", "ts").withColumnRenamed("ts", "since")


def sync(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Change table of a registry (id, content): insert, changed, stale or same."""
    a, b = wanted.select("id", F.col("content").alias("want")), stored.select("id", F.col("content").alias("have"))
    change = F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "stale").when(F.col("want") == F.col("have"), "same").otherwise("changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def unread(log: DataFrame) -> DataFrame:
    """Events after the user's last mark-read."""
    read = log.filter("kind = 'mark_read'").groupBy("user_id").agg(F.max("ts").alias("read_ts"))
    return log.filter("kind <> 'mark_read'").join(read, "user_id", "left").filter("read_ts is null or ts > read_ts").select("event_id", "user_id", "kind")
