"""Queries over attempts, members and the review log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attest.operators import history as ops
from attest.plans import fixtures as fx
from attest.plans.registry import query
from attest.streaming import ops as streams

A, M, L = fx.ATTEMPTS, fx.MEMBERS, fx.LOG


@query(f"WITH {A} SELECT analysis_id, user_id, attempt_type, row_number() OVER (PARTITION BY user_id, attempt_type ORDER BY created_at, analysis_id) AS number FROM attempts")
def win_attempts(spark, d):
    return ops.number_attempts(fx.attempts(spark, d), "user_id", "attempt_type").select("analysis_id", "user_id", "attempt_type", "number")


@query(f"WITH {A}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) AS recent FROM attempts) SELECT analysis_id, user_id, score, recent FROM r WHERE recent <= 5")
def win_last_n(spark, d):
    return ops.last_n(fx.attempts(spark, d), 5).select("analysis_id", "user_id", "score", "recent")


@query(f"WITH {A} SELECT analysis_id, user_id, score - coalesce(lag(score) OVER (PARTITION BY user_id ORDER BY created_at, analysis_id), 0) AS delta FROM attempts")
def hist_delta(spark, d):
    return ops.deltas(fx.attempts(spark, d))


@query(f"""WITH {A}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, analysis_id) AS k FROM attempts),
p AS (SELECT a.analysis_id, a.user_id, count(b.k) AS n, count(b.k) FILTER (b.score < a.score) AS beaten, min(b.score) AS low, a.score FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.k < a.k GROUP BY ALL)
SELECT analysis_id, user_id, round(CASE WHEN n > 0 THEN beaten / n END, 6) AS beats, CASE WHEN n = 0 THEN 'first' WHEN beaten = n THEN 'best' WHEN score < low THEN 'lowest' ELSE 'between' END AS label FROM p""")
def agg_standing(spark, d):
    return ops.standing(fx.attempts(spark, d))


@query(f"""WITH {A}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) AS k FROM attempts WHERE attempt_type <> 'P'), t AS (SELECT user_id, count(*) AS total FROM attempts GROUP BY user_id)
SELECT r.user_id, arg_min(score, k) AS latest, max(score) AS best, list(score ORDER BY created_at, analysis_id) AS scores, any_value(total) AS total FROM r JOIN t ON t.user_id = r.user_id WHERE k <= 20 GROUP BY r.user_id""")
def agg_candidate_stats(spark, d):
    return ops.candidate_stats(fx.attempts(spark, d), "P")


@query(f"""WITH {A} SELECT analysis_id, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'fair' ELSE 'weak' END AS label, CASE WHEN attempt_type = 'P' THEN 'not graded' WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'good' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS heat FROM attempts""")
def bucket_scores(spark, d):
    a = fx.attempts(spark, d)
    label, _ = ops.bucket(F.col("score"))
    _, heat = ops.bucket(F.when(F.col("attempt_type") != "P", F.col("score")))
    return a.select("analysis_id", label.alias("label"), heat.alias("heat"))


@query(f"WITH {A}, {M} SELECT analysis_id, user_id FROM attempts WHERE user_id IN (SELECT user_id FROM members WHERE mentor_id = 3)")
def acc_visible(spark, d):
    return ops.visible(fx.attempts(spark, d), fx.members(spark, d), 3).select("analysis_id", "user_id")


@query(f"WITH {A}, p AS (SELECT user_id, lag(analysis_id) OVER (PARTITION BY user_id, lower(trim(company)) ORDER BY created_at, analysis_id) AS before, analysis_id AS after FROM attempts) SELECT * FROM p WHERE before IS NOT NULL")
def pred_same_company(spark, d):
    return ops.same_company_pairs(fx.attempts(spark, d))


@query(f"WITH {M} SELECT session_id, n_name AS session, count(*) AS pairs, count(DISTINCT user_id) AS candidates FROM members JOIN nation ON session_id = n_nationkey GROUP BY session_id, n_name")
def join_members(spark, d):
    named = fx.members(spark, d).join(F.broadcast(fx.table(spark, d, "nation")), F.col("session_id") == F.col("n_nationkey"))  # a nation per session: 25 rows
    return named.groupBy("session_id", F.col("n_name").alias("session")).agg(F.count("*").alias("pairs"), F.count_distinct("user_id").alias("candidates"))


@query(f"WITH {L} SELECT event_id, user_id, item, c_name AS author FROM log LEFT JOIN customer ON c_custkey = user_id AND c_nationkey < 20 WHERE kind = 'mentor_feedback'")
def join_feedback(spark, d):
    people = fx.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author"))
    return fx.log(spark, d).filter("kind = 'mentor_feedback'").join(people, "user_id", "left").select("event_id", "user_id", "item", "author")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def join_semi(spark, d):
    mentors = fx.table(spark, d, "supplier").filter("s_acctbal > 0")
    users = fx.table(spark, d, "customer")
    return users.join(mentors, users["c_nationkey"] == mentors["s_nationkey"], "left_semi").select(F.col("c_custkey").alias("user_id"))


@query("""SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 <> 3
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)""")
def join_erase(spark, d):
    """Every tenth customer is erased with orders and lines."""
    t = {n: fx.table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    gone = t["customer"].filter("c_custkey % 10 = 3")
    left = ops.erase({"customer": (t["customer"], "c_custkey", "c_custkey"), "orders": (t["orders"], "o_custkey", "o_orderkey"), "lineitem": (t["lineitem"], "l_orderkey", None)}, gone, "c_custkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH p AS (SELECT user_id, ts AS pts, event_id AS pid FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id, c.user_id, CASE WHEN p.pts >= c.ts - INTERVAL 60 MINUTE THEN p.pid END AS match_id FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.pts""")
def join_asof(spark, d):
    e = fx.table(spark, d, "events")
    return ops.asof(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "60 minutes")


@query(f"WITH {L} SELECT CAST(grouping(user_id) * 2 + grouping(kind) AS BIGINT) AS level, user_id, kind, count(*) AS n FROM log GROUP BY GROUPING SETS ((), (kind), (user_id), (user_id, kind))")
def agg_rollup(spark, d):
    return ops.rollup(fx.log(spark, d))


@query(f"WITH {L} SELECT user_id, item, max(event_id) AS event_id, arg_max(kind, event_id) AS kind FROM log GROUP BY user_id, item")
def agg_dedupe(spark, d):
    return ops.latest(fx.log(spark, d), ["user_id", "item"], F.col("event_id"), "event_id", "kind")


@query(f"WITH {L} SELECT user_id, count(*) FILTER (kind = 'accepted') AS accepted, count(*) FILTER (kind = 'dismissed') AS dismissed FROM log GROUP BY user_id")
def agg_decisions(spark, d):
    return fx.log(spark, d).groupBy("user_id").agg(F.count_if(F.col("kind") == "accepted").alias("accepted"), F.count_if(F.col("kind") == "dismissed").alias("dismissed"))


@query("""WITH c AS (SELECT o_custkey AS user_id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F') AS f,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey) SELECT user_id, round(f, 3) AS with_critic, round(o, 3) AS without, round(f - o, 3) AS overhead FROM c""")
def agg_paired(spark, d):
    """Mean cost in cents with and without, side by side."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    runs = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum(cents) / F.count(cents))
    return runs.select("user_id", F.round("F", 3).alias("with_critic"), F.round("O", 3).alias("without"), F.round(F.col("F") - F.col("O"), 3).alias("overhead"))


@query("SELECT l_orderkey AS analysis_id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS models FROM lineitem GROUP BY l_orderkey")
def agg_models(spark, d):
    name = F.concat("l_returnflag", "l_linestatus")
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("models"))


@query(f"""WITH {L}, g AS (SELECT user_id, item, max(ts) AS gone FROM log WHERE kind = 'dismissed' GROUP BY user_id, item), e AS (SELECT l.*, row_number() OVER (PARTITION BY l.user_id ORDER BY ts DESC, event_id DESC) AS k
  FROM log l LEFT JOIN g ON g.user_id = l.user_id AND g.item = l.item WHERE kind = 'mentor_feedback' AND (gone IS NULL OR gone < ts)) SELECT user_id, event_id, item FROM e WHERE k = 1""")
def win_effective(spark, d):
    return ops.effective(fx.log(spark, d))


@query(f"""WITH RECURSIVE {L}, o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM log WHERE kind IN ('accepted', 'dismissed')),
r AS (SELECT user_id, k, ts AS anchor, 1 AS made FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.ts - r.anchor > INTERVAL 300 MINUTE THEN o.ts ELSE r.anchor END, r.made + CASE WHEN o.ts - r.anchor > INTERVAL 300 MINUTE THEN 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, CAST(max(made) AS BIGINT) AS snapshots, count(*) AS decisions FROM r GROUP BY user_id""")
def win_snapshots(spark, d):
    return ops.snapshots(fx.log(spark, d).filter("kind in ('accepted', 'dismissed')"), 300)


@query(f"""WITH {L}, f AS (SELECT *, coalesce(lag(kind) OVER w <> kind OR lag(ts) OVER w < ts - INTERVAL 600 MINUTE, true) AS fresh FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM f) SELECT user_id, revision, any_value(kind) AS kind, count(*) AS saves, arg_max(item, (ts, event_id)) AS item FROM n GROUP BY user_id, revision""")
def win_autosave(spark, d):
    return ops.autosaves(fx.log(spark, d), "600 minutes")


@query(f"""WITH {L}, w AS (SELECT user_id, max((ts, event_id)) AS floor FROM log WHERE kind = 'new_attempt' GROUP BY user_id),
x AS (SELECT l.*, row_number() OVER (PARTITION BY l.user_id, item ORDER BY ts DESC, event_id DESC) AS k FROM log l LEFT JOIN w ON w.user_id = l.user_id WHERE kind IN ('accepted', 'dismissed', 'mark_read') AND (floor IS NULL OR (ts, event_id) > floor))
SELECT user_id, item, kind AS decision FROM x WHERE k = 1 AND kind <> 'mark_read'""")
def win_decisions(spark, d):
    return ops.decision_state(fx.log(spark, d))


@query(f"WITH {L}, b AS (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM log) SELECT event_id, user_id, item FROM b WHERE item IS DISTINCT FROM before")
def win_unchanged(spark, d):
    return ops.unchanged(fx.log(spark, d)).select("event_id", "user_id", "item")


@query(f"WITH {L}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS k FROM log WHERE kind = 'mentor_feedback') SELECT user_id, item, event_id FROM x WHERE k = 1")
def win_latest_edit(spark, d):
    return ops.latest(fx.log(spark, d).filter("kind = 'mentor_feedback'"), ["user_id", "item"], F.struct("ts", "event_id"), "event_id")


@query(f"""WITH {L}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS k FROM log)
SELECT user_id, item, CASE kind WHEN 'new_attempt' THEN 'queued' WHEN 'accepted' THEN 'completed' WHEN 'dismissed' THEN 'failed' ELSE 'running' END AS status FROM x WHERE k = 1""")
def win_job_status(spark, d):
    return ops.job_status(fx.log(spark, d)).drop("since")


@query(f"WITH {A} SELECT analysis_id, user_id, score FROM attempts ORDER BY created_at DESC, analysis_id DESC LIMIT 50")
def top_history(spark, d):
    """The newest fifty summaries (a top-k report)."""
    return fx.attempts(spark, d).orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(50).select("analysis_id", "user_id", "score")


@query(f"WITH {A} SELECT user_id, analysis_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id DESC) AS position FROM attempts")
def top_lists(spark, d):
    """All rows of every user, newest first."""
    place = F.row_number().over(fx.Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("analysis_id")))
    return fx.attempts(spark, d).select("user_id", "analysis_id", place.alias("position"))


@query(f"""WITH {L}, {A}, u AS (SELECT user_id, created_at AS moment, 'attempt' AS kind, analysis_id AS id FROM attempts UNION ALL SELECT user_id, ts, kind, event_id FROM log)
SELECT user_id, kind, id, row_number() OVER (PARTITION BY user_id ORDER BY moment, kind, id) AS position FROM u""")
def set_timeline(spark, d):
    a = fx.attempts(spark, d).select("user_id", F.col("created_at").cast("timestamp_ntz").alias("moment"), F.lit("attempt").alias("kind"), F.col("analysis_id").alias("id"))
    both = a.unionByName(fx.log(spark, d).select("user_id", F.col("ts").cast("timestamp_ntz").alias("moment"), "kind", F.col("event_id").alias("id")))
    return both.select("user_id", "kind", "id", F.row_number().over(Window.partitionBy("user_id").orderBy("moment", "kind", "id")).alias("position"))


_NORMAL = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(f"SELECT {_NORMAL} AS digest FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {_NORMAL} FROM documents WHERE doc_id % 2 = 1")
def set_leakage(spark, d):
    """Texts that two halves of the corpus share."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).alias("digest"))
    return docs.filter("doc_id % 2 = 0").select("digest").intersect(docs.filter("doc_id % 2 = 1").select("digest"))


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS content FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_name || ' old' ELSE p_name END AS content FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'stale' WHEN a.content = b.content THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id""")
def set_sync(spark, d):
    part = fx.table(spark, d, "part")
    wanted = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    old = part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" old"))).otherwise(F.col("p_name")).alias("content"))
    return ops.sync(wanted, old)


@query(f"WITH {L}, x AS (SELECT *, max(ts) FILTER (kind = 'new_attempt') OVER (PARTITION BY user_id) AS opened, bool_or(kind = 'accepted') OVER (PARTITION BY user_id, item) AS accepted FROM log) SELECT event_id, user_id, CASE WHEN opened IS NULL OR ts >= opened THEN 'current' ELSE 'previous' END AS box, accepted AS superseded FROM x WHERE kind = 'mentor_feedback'")
def set_inbox(spark, d):
    log = fx.log(spark, d)
    opened = log.filter("kind = 'new_attempt'").groupBy("user_id").agg(F.max("ts").alias("opened"))
    accepted = log.filter("kind = 'accepted'").select("user_id", "item", F.lit(True).alias("accepted")).distinct()
    rows = log.filter("kind = 'mentor_feedback'").join(opened, "user_id", "left").join(accepted, ["user_id", "item"], "left")
    return rows.select("event_id", "user_id", F.when(F.col("opened").isNull() | (F.col("ts") >= F.col("opened")), "current").otherwise("previous").alias("box"), F.coalesce("accepted", F.lit(False)).alias("superseded"))


@query(f"""WITH {A} SELECT user_id, 'Candidate ' || user_id || ': ' || count(*) || ' attempts, latest ' || arg_max(score, (created_at, analysis_id)) || ', best ' || max(score) || chr(10) || string_agg('- ' || score, chr(10) ORDER BY created_at, analysis_id) AS report FROM attempts GROUP BY user_id""")
def sink_report(spark, d):
    order = F.struct("created_at", "analysis_id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "analysis_id", "score"))), lambda s: F.concat(F.lit("- "), s["score"].cast("string"))), "\n")
    a = fx.attempts(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("score", order).alias("latest"), F.max("score").alias("best"), lines.alias("lines"))
    return a.select("user_id", F.concat(F.format_string("Candidate %d: %d attempts, latest %d, best %d\n", "user_id", "n", "latest", "best"), "lines").alias("report"))


@query(f"WITH {M}, x AS (SELECT user_id, mentor_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY s_acctbal DESC, mentor_id DESC) AS k FROM members JOIN supplier ON s_suppkey = mentor_id) SELECT user_id, mentor_id, session_id FROM x WHERE k = 1")
def join_current_session(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("mentor_id"), F.col("s_acctbal").alias("opened"))
    return ops.latest(fx.members(spark, d).join(s, "mentor_id"), ["user_id"], F.struct("opened", "mentor_id"), "mentor_id", "session_id")


@query(f"WITH {A}, x AS (SELECT *, nullif(company, '4-NOT SPECIFIED') AS own FROM attempts) SELECT analysis_id, left(coalesce(own, (SELECT arg_max(y.own, (y.created_at, y.analysis_id)) FROM x y WHERE y.user_id = x.user_id AND y.own IS NOT NULL)), 200) AS company FROM x")
def join_company(spark, d):
    a = fx.attempts(spark, d).withColumn("own", F.nullif("company", F.lit("4-NOT SPECIFIED")))
    known = a.filter("own is not null").groupBy("user_id").agg(F.max_by("own", F.struct("created_at", "analysis_id")).alias("last"))
    return a.join(known, "user_id", "left").select("analysis_id", F.substring(F.coalesce("own", "last"), 1, 200).alias("company"))


@query(f"WITH {M}, w AS (SELECT DISTINCT c_nationkey AS session_id, c_custkey AS user_id FROM customer WHERE c_nationkey < 20) SELECT * FROM w WHERE (session_id, user_id) NOT IN (SELECT session_id, user_id FROM members WHERE mentor_id < 10)")
def join_once(spark, d):
    """Joining a session adds a member only where there is none yet and the session is open."""
    wanted = fx.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("user_id")).dropDuplicates()
    return wanted.join(fx.members(spark, d).filter("mentor_id < 10"), ["session_id", "user_id"], "left_anti")


@query("WITH m AS (SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last_ts < (SELECT max(ts) FROM events) - INTERVAL 720 MINUTE THEN 'failed' ELSE 'rerun' END AS action FROM m WHERE state <> 'purchase'")
def st_stalled(spark, d):
    e = fx.table(spark, d, "events")
    last = ops.latest(e, ["user_id"], F.struct("ts", "event_id"), "ts", "event_type").filter("event_type <> 'purchase'")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.join(F.broadcast(now)).select("user_id", F.when(F.col("ts") < F.col("now") - F.expr("interval 720 minutes"), "failed").otherwise("rerun").alias("action"))


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def st_rate(spark, d):
    return _naive(streams.run_available(streams.rate_windows(streams.read_events(spark, d), "15 minutes", 1), "complete"))


@query("""WITH f AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 10 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, s""")
def st_sessions(spark, d):
    return _naive(streams.run_available(streams.sessions(streams.read_events(spark, d), "10 minutes"), "complete"))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, range(4) AS r(k) GROUP BY 1, 2""")
def st_sliding(spark, d):
    return _naive(streams.run_available(streams.sliding(streams.read_events(spark, d), "1 hour", "15 minutes"), "complete"))


@query("SELECT user_id, max(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 END) AS stage, count(*) AS n FROM events GROUP BY user_id")
def st_progress(spark, d):
    return streams.run_available(streams.progress(streams.read_events(spark, d)), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(spark, d):
    return streams.run_available(streams.dedup(streams.read_events(spark, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append")


@query(f"WITH {M} SELECT event_id, mentor_id FROM events JOIN members USING (user_id) WHERE event_type = 'signup'")
def st_fanout(spark, d):
    return streams.run_available(streams.fanout(streams.read_events(spark, d), fx.members(spark, d)), "append")


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))
