"""Queries over units and pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions import claims, score
from attest.functions import lexicon as lx
from attest.functions.text import has_bullet, strip_bullet
from attest.operators import lines as line_ops
from attest.operators import pairs as pair_ops
from attest.operators import units as unit_ops
from attest.plans import fixtures as fx
from attest.plans import sql, text
from attest.plans.registry import query

SCORED = f"WITH {fx.UNITS}, {sql.signals('units')}"
STRONG = "quantified AND action_verb = 1 AND structure = 1"


_IN, _UN = sql.items(lx.SCORED_SECTIONS), sql.items(lx.UNGRADED_SECTIONS)
_PART = "CAST(round_even(round(coalesce(CASE WHEN count(*) FILTER (section IN ({i})) > 0 THEN avg({v}) FILTER (section IN ({i})) ELSE avg({v}) FILTER (section NOT IN ({u})) END, 0) * {w}, 9), 0) AS INTEGER)"
_PARTS = {k: _PART.format(i=_IN, u=_UN, v=v, w=w) for k, v, w in (("quantification", "CAST(quantified AS DOUBLE)", 40), ("action_verbs", "action_verb", 30), ("structure", "form", 30))}
_DOC_SCORES = f"SELECT doc_id, count(*) FILTER (section IN ({_IN})) AS n_scored, count(*) AS n_units, {', '.join(f'{v} AS {k}' for k, v in _PARTS.items())} FROM scored GROUP BY doc_id"


@query(f"""WITH {text.GATHERED}, chosen AS (SELECT doc_id, section, unit_no, text FROM f WHERE {text.ELIGIBLE}), {sql.signals('chosen', sql.figure('text'))}, totals AS ({_DOC_SCORES})
SELECT *, quantification + action_verbs + structure AS total FROM totals ORDER BY total DESC, doc_id LIMIT 50""")
def doc_review(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents to lines to units to scores, the best fifty (a top-k report)."""
    found = line_ops.units(line_ops.sections(fx.headed_lines(spark, d)))
    scores = unit_ops.document_scores(found.filter("eligible").select("doc_id", "unit_no", "section", "text"))
    return scores.orderBy(F.desc("total"), "doc_id").limit(50)


@query(rf"WITH {fx.HEADED_LINES} SELECT doc_id, line_no, trim(regexp_replace({sql.squeeze('line')}, '{lx.BULLET}', '')) AS text, regexp_matches({sql.squeeze('line')}, '{lx.BULLET}') AS bullet FROM headed_lines")
def text_strip_bullet(spark, d):
    return fx.headed_lines(spark, d).select("doc_id", "line_no", strip_bullet(F.col("line")).alias("text"), has_bullet(F.col("line")).alias("bullet"))


@query(f"WITH {fx.PAIRS} SELECT doc_id, unit_no, {sql.PAIR_TOKENS.format(c='rewritten')} AS tokens FROM pairs")
def claim_tokens(spark, d):
    return fx.pairs(spark, d).select("doc_id", "unit_no", claims.claim_tokens(F.col("rewritten")).alias("tokens"))


_KEYS = "list_sort(list_distinct(list_transform({t}, lambda t: {k})))".replace("{k}", sql.key("t"))


@query(f"WITH {fx.PAIRS} SELECT doc_id, unit_no, {_KEYS.format(t=sql.PAIR_TOKENS.format(c='rewritten'))} AS keys FROM pairs")
def claim_keys(spark, d):
    return fx.pairs(spark, d).select("doc_id", "unit_no", claims.claim_keys(claims.claim_tokens(F.col("rewritten"))).alias("keys"))


@query(f"WITH {fx.PAIRS} SELECT doc_id, unit_no, {_KEYS.format(t=sql.PAIR_TOKENS.format(c='original'))} AS keys FROM pairs")
def claim_supported(spark, d):
    return fx.pairs(spark, d).select("doc_id", "unit_no", claims.supported_keys(F.col("original")).alias("keys"))


_FOUND = f"""{fx.PAIRS},
keyed AS (SELECT *, {_KEYS.format(t=sql.PAIR_TOKENS.format(c='original'))} AS supported, {sql.PAIR_TOKENS.format(c='rewritten')} AS tokens, {sql.opener('original')} AS o, {sql.opener('rewritten')} AS r FROM pairs),
forms AS (SELECT *, list_filter(tokens, lambda t: NOT list_contains(supported, {sql.key('t')})) AS new_claims, {sql.lead_form('o')} AS of, {sql.lead_form('r')} AS rf FROM keyed),
tiers AS (SELECT *, {sql.lead_tier('of')} AS ot, {sql.lead_tier('rf')} AS rt, {sql.max_tier('o')} AS om FROM forms),
found AS (SELECT *, coalesce(rt > ot AND om < rt, false) AS escalated FROM tiers)"""


@query(f"WITH {_FOUND} SELECT doc_id, unit_no, new_claims, len(new_claims) > 0 AS has_new FROM found")
def claim_new(spark, d):
    return fx.pairs(spark, d).select("doc_id", "unit_no", claims.new_claims(F.col("original"), F.col("rewritten")).alias("new_claims")).withColumn("has_new", F.size("new_claims") > 0)


@query(f"{SCORED} SELECT doc_id, unit_no, lead AS form, tier FROM scored")
def claim_verbs(spark, d):
    return fx.units(spark, d).select("doc_id", "unit_no", claims.leading_verb(F.col("text")).alias("v")).select("doc_id", "unit_no", "v.form", "v.tier")


@query(f"WITH {fx.UNITS} SELECT doc_id, unit_no, {sql.max_tier(sql.opener('text'))} AS highest FROM units")
def claim_max_tier(spark, d):
    return fx.units(spark, d).select("doc_id", "unit_no", claims.max_tier(F.col("text")).alias("highest"))


_NAME = "(['participation', 'execution', 'ownership'])[{t} + 1]"


@query(f"WITH {_FOUND} SELECT doc_id, unit_no, of AS from_verb, rf AS to_verb, {_NAME.format(t='ot')} AS from_tier, {_NAME.format(t='rt')} AS to_tier FROM found WHERE escalated")
def claim_escalation(spark, d):
    return fx.pairs(spark, d).select("doc_id", "unit_no", claims.escalation(F.col("original"), F.col("rewritten")).alias("e")).filter("e is not null").select("doc_id", "unit_no", "e.*")


@query(f"WITH {_FOUND} SELECT doc_id, unit_no, new_claims, escalated, len(new_claims) = 0 AND NOT escalated AS clean FROM found")
def claim_findings(spark, d):
    return pair_ops.findings(fx.pairs(spark, d)).select("doc_id", "unit_no", "new_claims", F.col("escalation").isNotNull().alias("escalated"), "clean")


def _verdicts(spark, d):
    """A verdict for two pairs in three, a repair for those of even documents: the text without its figure."""
    p = fx.pairs(spark, d)
    verdicts = p.filter("(doc_id + unit_no) % 3 <> 0").select("doc_id", "unit_no", F.when((F.col("doc_id") + F.col("unit_no")) % 3 == 1, "FAIL").otherwise("PASS").alias("verdict"))
    repairs = p.filter("doc_id % 2 = 0").select("doc_id", "unit_no", F.regexp_replace("rewritten", r"\s(for|by|saving)\s\S*[0-9].*$", "").alias("repair"))
    return p, verdicts, repairs


_CRITIC = f"""{_FOUND},
judged AS (SELECT *, CASE WHEN len(new_claims) = 0 THEN 'skipped' WHEN (doc_id + unit_no) % 3 = 0 THEN 'unavailable' WHEN (doc_id + unit_no) % 3 = 2 THEN 'passed'
  WHEN doc_id % 2 = 0 THEN 'repaired' ELSE 'failed' END AS status FROM found),
final AS (SELECT *, CASE status WHEN 'repaired' THEN regexp_replace(rewritten, '\\s(for|by|saving)\\s\\S*[0-9].*$', '') WHEN 'failed' THEN original ELSE rewritten END AS final FROM judged)"""


@query(f"""WITH {_FOUND} SELECT doc_id, unit_no, CASE (doc_id + unit_no) % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'yellow' END AS severity, new_claims, escalated AS escalation FROM found""")
def rw_finalise(spark, d):
    """Rewrites whose severities are in any case, unknown or missing, and that carry findings of an earlier round."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("RED", "Green", " yellow", "blue", None)]), ((F.col("doc_id") + F.col("unit_no")) % 5 + 1).cast("int"))
    stale = fx.pairs(spark, d).withColumns({"severity": said, "new_claims": F.array(F.lit("stale")), "escalation": F.lit("stale")})
    return pair_ops.finalise(stale).select("doc_id", "unit_no", "severity", "new_claims", F.col("escalation").isNotNull().alias("escalation"))


@query(f"WITH {_CRITIC} SELECT doc_id, unit_no, status, final FROM final")
def claim_critic(spark, d):
    return pair_ops.critic(*_verdicts(spark, d)).select("doc_id", "unit_no", "status", "final")


@query(f"""WITH {_CRITIC} SELECT status, count(*) AS n, count(*) FILTER (escalated) AS escalations, count(*) FILTER (len(new_claims) > 0 AND status <> 'passed') AS open_claims,
  count(*) FILTER (status = 'failed' AND final = original) AS withheld FROM final GROUP BY status""")
def claim_guard(spark, d):
    return pair_ops.guard(pair_ops.critic(*_verdicts(spark, d)))


@query(f"""WITH {_CRITIC}, f AS (SELECT doc_id, unit_no, rewritten <> original AS actionable, (len(new_claims) > 0 AND status <> 'passed') OR escalated AS flagged FROM final)
SELECT *, actionable AND NOT flagged AND doc_id % 7 <> 0 AS accept_all FROM f""")
def pred_flags(spark, d):
    judged = pair_ops.critic(*_verdicts(spark, d))
    return pair_ops.flags(judged, judged.filter("doc_id % 7 = 0").select("doc_id", "unit_no"))


@query(f"""WITH {fx.PAIRS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) - 1 AS pos FROM pairs WHERE trim(rewritten) <> '' AND rewritten <> original)
SELECT doc_id, unit_no, CASE pos % 4 WHEN 0 THEN 'role' WHEN 2 THEN 'scope' END AS kind, 'reason ' || pos AS reason FROM c WHERE doc_id % 5 <> 0 AND pos % 2 = 0""")
def claim_audit(spark, d):
    p = fx.pairs(spark, d)
    changed = p.filter("trim(rewritten) <> '' and rewritten <> original")
    from pyspark.sql import Window

    said = changed.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no")) - 1)
    said = said.filter("not (doc_id % 5 = 0 and pos = 0)")  # one verdict short: those documents get none
    verdicts = said.select("doc_id", "pos", F.when(F.col("pos") % 2 == 0, "overstated").otherwise("ok").alias("verdict"), F.when(F.col("pos") % 4 == 0, "Role").otherwise("SCOPE").alias("kind"), F.concat(F.lit("reason "), F.col("pos").cast("string")).alias("reason"))
    return pair_ops.audit(p, verdicts)


@query(f"WITH {_FOUND} SELECT doc_id, unit_no, CASE WHEN escalated THEN 'overstated' ELSE 'ok' END AS verdict FROM found")
def claim_rule_audit(spark, d):
    e = claims.escalation(F.col("original"), F.col("rewritten"))
    return fx.pairs(spark, d).select("doc_id", "unit_no", F.when(e.isNotNull(), "overstated").otherwise("ok").alias("verdict"))


_P = sql.structure_parts("line")


@query(f"WITH {fx.PLAIN_LINES} SELECT doc_id, line_no, {_P[0]} AS length, {_P[1]} AS no_first_person, {_P[2]} AS no_filler FROM plain_lines")
def score_structure(spark, d):
    return fx.plain_lines(spark, d).select("doc_id", "line_no", score.structure_checks(F.col("line")).alias("c")).select("doc_id", "line_no", "c.*")


@query(f"{SCORED} SELECT doc_id, unit_no, quantified FROM scored")
def score_quantified(spark, d):
    return fx.units(spark, d).select("doc_id", "unit_no", score.is_quantified(F.col("text")).alias("quantified"))


@query(f"{SCORED} SELECT doc_id, unit_no, action_verb FROM scored")
def score_verbs(spark, d):
    return fx.units(spark, d).select("doc_id", "unit_no", score.verb_strength(F.col("text")).alias("action_verb"))


@query(f"{SCORED} SELECT doc_id, unit_no, quantified, action_verb, structure, score FROM scored")
def score_units(spark, d):
    return unit_ops.scored(fx.units(spark, d)).select("doc_id", "unit_no", "signals.*").drop("form")


@query(f"{SCORED} SELECT doc_id, unit_no, {STRONG} AS strong FROM scored")
def score_strong(spark, d):
    return unit_ops.scored(fx.units(spark, d)).select("doc_id", "unit_no", score.is_strong(F.col("signals")).alias("strong"))


@query(f"{SCORED}, d AS ({_DOC_SCORES}) SELECT *, quantification + action_verbs + structure AS total FROM d")
def agg_doc_score(spark, d):
    return unit_ops.document_scores(fx.units(spark, d))


_SECTIONS = f"""{SCORED}, sec AS (SELECT doc_id, section, CAST(round_even(round(avg(score) FILTER (section NOT IN ({_UN})), 9), 0) AS INTEGER) AS quality, count(*) AS n_units,
  count(*) FILTER (quantified) AS n_quantified, count(*) FILTER (action_verb = 1) AS n_action FROM scored GROUP BY doc_id, section)"""


@query(f"{_SECTIONS} SELECT * FROM sec")
def agg_section_scores(spark, d):
    return unit_ops.section_scores(fx.units(spark, d))


@query(f"{SCORED} SELECT doc_id, count(*) AS n_units, count(*) FILTER ({STRONG}) AS n_strong, count(*) FILTER (NOT ({STRONG})) AS n_rewrite FROM scored GROUP BY doc_id")
def agg_preview(spark, d):
    return unit_ops.preview(fx.units(spark, d))


@query(f"""{_SECTIONS}, o AS (SELECT *, CASE section WHEN 'EXPERIENCE' THEN 0 WHEN 'PROJECTS' THEN 1 ELSE 2 END AS k FROM sec WHERE quality IS NOT NULL)
SELECT doc_id, arg_max(section, quality * 10 - k) AS strongest, arg_min(section, quality * 10 + k) AS weakest FROM o GROUP BY doc_id""")
def agg_extremes(spark, d):
    return unit_ops.extremes(unit_ops.section_scores(fx.units(spark, d)))


@query(f"""{_SECTIONS} SELECT doc_id, max(quality) FILTER (section = 'EXPERIENCE') AS "EXPERIENCE", max(quality) FILTER (section = 'PROJECTS') AS "PROJECTS", max(quality) FILTER (section = 'SUMMARY') AS "SUMMARY" FROM sec GROUP BY doc_id""")
def top_heatmap(spark, d):
    return unit_ops.heatmap(unit_ops.section_scores(fx.units(spark, d)), ["EXPERIENCE", "PROJECTS", "SUMMARY"])


@query(f"""{_SECTIONS}, c AS (SELECT o_custkey AS user_id, section, quality - lag(quality) OVER w AS change, row_number() OVER (PARTITION BY o_custkey, section ORDER BY o_orderdate DESC, doc_id DESC) AS k
  FROM sec JOIN orders ON o_orderkey = doc_id WHERE quality IS NOT NULL WINDOW w AS (PARTITION BY o_custkey, section ORDER BY o_orderdate, doc_id))
SELECT user_id, arg_max(section, change * 1000 - ascii(section)) AS section, max(change) AS change FROM c WHERE k = 1 AND change > 0 GROUP BY user_id""")
def win_improved(spark, d):
    owners = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("user_id"), "o_orderdate")
    return unit_ops.improved(unit_ops.section_scores(fx.units(spark, d)).join(owners, "doc_id"), "o_orderdate")


_BATCHES = f"{SCORED}, weak AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) - 1 AS turn FROM scored WHERE NOT ({STRONG}))"


@query(f"{_BATCHES} SELECT doc_id, unit_no, turn // 6 AS batch, turn % 6 AS pos FROM weak")
def rw_batches(spark, d):
    return unit_ops.batches(fx.units(spark, d)).drop("text")


_RULE = r"CASE WHEN quantified THEN text ELSE regexp_replace(text, '[.\s]+$', '') || ', improving [metric] by [X%]' END"
_SEVERITY = "CASE WHEN score < 40 THEN 'red' WHEN score < 75 THEN 'yellow' ELSE 'green' END"


@query(f"{SCORED} SELECT doc_id, unit_no, section, text AS original, {_RULE} AS rewritten, {_SEVERITY} AS severity FROM scored")
def rw_rule(spark, d):
    return unit_ops.rule_rewrite(fx.units(spark, d))


@query(f"{SCORED} SELECT doc_id, section, string_agg(CASE WHEN {STRONG} THEN 'strong: ' || text ELSE {_SEVERITY} || ': ' || {_RULE} END, chr(10) ORDER BY unit_no) AS body FROM scored GROUP BY doc_id, section")
def rw_assemble(spark, d):
    rows = unit_ops.rule_rewrite(fx.units(spark, d), score.is_strong(F.col("signals")).alias("strong"))
    line = F.when(F.col("strong"), F.concat(F.lit("strong: "), "original")).otherwise(F.concat("severity", F.lit(": "), "rewritten"))
    parts = F.array_sort(F.collect_list(F.struct("unit_no", line.alias("line"))))
    return rows.groupBy("doc_id", "section").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"))


@query(f"{_BATCHES}, cached AS (SELECT text FROM scored WHERE doc_id % 10 = 0) SELECT doc_id, unit_no, upper(text) AS rewritten FROM weak WHERE text NOT IN (SELECT text FROM cached)")
def rw_stage(spark, d):
    units = fx.units(spark, d)

    def fn(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "unit_no": pdf["unit_no"], "rewritten": pdf["text"].str.upper()})

    return unit_ops.model_stage(unit_ops.batches(units), units.filter("doc_id % 10 = 0"), fn, "doc_id long, unit_no int, rewritten string")


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9+#.]*'), lambda w: length(w) >= 3 AND w NOT IN (" + sql.items(lx.ALIGN_STOPWORDS) + ")))"
_SHARE = "len(list_intersect({r}, {o})) / greatest(1, len({o}))"


@query(f"""WITH {fx.PAIRS}, q AS (SELECT doc_id AS batch_id, unit_no - 1 AS pos, original, rewritten, count(*) OVER (PARTITION BY doc_id) AS n FROM pairs),
m AS (SELECT *, CASE WHEN batch_id % 4 = 3 THEN 'length' WHEN batch_id % 4 = 0 THEN 'position' WHEN batch_id % 4 = 1 THEN 'index' WHEN n = 1 THEN 'position' ELSE 'partial' END AS mode FROM q),
w AS (SELECT batch_id, pos, {_WORDS.format(c='original')} AS o, {_WORDS.format(c='rewritten')} AS r FROM m WHERE mode IN ('position', 'index')),
strays AS (SELECT DISTINCT a.batch_id FROM w a JOIN w b ON b.batch_id = a.batch_id AND b.pos <> a.pos WHERE {_SHARE.format(r='a.r', o='b.o')} > greatest({_SHARE.format(r='a.r', o='a.o')}, 0.3))
SELECT m.batch_id, pos, original, CASE WHEN s.batch_id IS NOT NULL THEN 'misplaced' ELSE mode END AS mode, CASE WHEN mode IN ('position', 'index') AND s.batch_id IS NULL THEN rewritten END AS rewritten
FROM m LEFT JOIN strays s ON s.batch_id = m.batch_id""")
def rw_align(spark, d):
    """Answers come back by position, with an index from 1 in reverse order, with an index missing, or one short."""
    from pyspark.sql import Window

    p = fx.pairs(spark, d).select(F.col("doc_id").alias("batch_id"), (F.col("unit_no") - 1).alias("pos"), "original", "rewritten")
    n = F.count("*").over(Window.partitionBy("batch_id"))
    back = p.withColumn("n", n).filter("not (batch_id % 4 = 3 and pos = 0)")
    kind = F.col("batch_id") % 4
    idx = F.when(kind == 1, F.col("pos") + 1).when((kind == 2) & (F.col("pos") > 0), F.col("pos"))
    answers = back.select("batch_id", F.when(kind == 1, F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), idx.alias("idx"), "rewritten")
    return unit_ops.align(p.select("batch_id", "pos", "original"), answers)


@query(f"""WITH {fx.UNITS}, r AS (SELECT DISTINCT lower(text) AS k, 'Recorded ' || lower(text) AS answer FROM units WHERE doc_id % 4 = 0)
SELECT doc_id, unit_no, coalesce(answer, text) AS answer, answer IS NOT NULL AS recorded FROM units LEFT JOIN r ON k = lower(text)""")
def rw_replay(spark, d):
    u = fx.units(spark, d)
    return unit_ops.replay(u, u.filter("doc_id % 4 = 0").select("text", F.concat(F.lit("Recorded "), F.lower("text")).alias("answer")))


def _detectors():
    new = F.size(claims.new_claims(F.col("original"), F.col("rewritten"))) > 0
    up = claims.escalation(F.col("original"), F.col("rewritten")).isNotNull()
    truth = {"invented_metric": F.regexp_extract("rewritten", r"([0-9]+)", 1) != "", "role_escalation": F.col("doc_id") % 2 == 0}
    return {"invented_metric": new, "role_escalation": up}, truth


_CASES = f"""{_FOUND}, c AS (SELECT len(new_claims) > 0 AS p1, regexp_matches(rewritten, '[0-9]') AS a1, escalated AS p2, doc_id % 2 = 0 AS a2 FROM found),
x AS (SELECT 'invented_metric' AS detector, p1 AS p, a1 AS a FROM c UNION ALL SELECT 'role_escalation', p2, a2 FROM c UNION ALL SELECT 'any', p1 OR p2, a1 OR a2 FROM c),
k AS (SELECT detector, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM x GROUP BY detector),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS pp, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS rr FROM k),
scores AS (SELECT detector, tp, fp, fn, tn, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr = 0 THEN 0 ELSE 2 * pp * rr / (pp + rr) END, 6) AS f1 FROM pr)"""


@query(f"WITH {_CASES} SELECT * FROM scores")
def eval_confusion(spark, d):
    return pair_ops.confusion(fx.pairs(spark, d), *_detectors())


@query(f"WITH {_CASES} SELECT bool_and(precision >= 0.8 AND recall >= 0.55) AS passed, count(*) AS detectors FROM scores")
def eval_gate(spark, d):
    return pair_ops.gate(pair_ops.confusion(fx.pairs(spark, d), *_detectors()))


@query(f"WITH {_FOUND} SELECT doc_id, unit_no, escalated AS predicted, doc_id % 2 = 0 AS actual FROM found WHERE escalated <> (doc_id % 2 = 0)")
def eval_disagree(spark, d):
    p, a = _detectors()
    return fx.pairs(spark, d).select("doc_id", "unit_no", p["role_escalation"].alias("predicted"), a["role_escalation"].alias("actual")).filter("predicted <> actual")
