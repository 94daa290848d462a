"""Operators over pairs (doc_id, unit_no, original, rewritten): findings and critics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import claims
from attest.functions.text import let


def findings(pairs: DataFrame) -> DataFrame:
    """New figures, escalation and whether the pair is clean, in one pass."""
    found = pairs.withColumns({"new_claims": claims.new_claims(F.col("original"), F.col("rewritten")), "escalation": claims.escalation(F.col("original"), F.col("rewritten"))})
    return found.withColumn("clean", (F.size("new_claims") == 0) & F.col("escalation").isNull())


def finalise(rewrites: DataFrame) -> DataFrame:
    """Rewrites with their severity settled (lower-cased; yellow where it is missing or none of red, yellow and green) and
    findings of their own: what a model or an earlier round said of new figures and escalation is dropped. A blank rewrite
    counts as the original. rewrites(doc_id, unit_no, original, rewritten, severity, ...)."""
    severity = F.lower("severity")
    settled = rewrites.drop("new_claims", "escalation", "clean").withColumn("severity", F.when(severity.isin("red", "yellow", "green"), severity).otherwise("yellow"))
    text = F.coalesce(F.nullif("said", F.lit("")), "original")
    judged = findings(settled.withColumnRenamed("rewritten", "said").withColumn("rewritten", text))
    return judged.drop("rewritten").withColumnRenamed("said", "rewritten")


def critic(pairs: DataFrame, verdicts: DataFrame, repairs: DataFrame) -> DataFrame:
    """Status and final text of each pair: skipped without new figures; unavailable without a verdict; passed;
    repaired by a clean repair; else failed, and the text goes back to the original."""
    joined = findings(pairs).join(verdicts, ["doc_id", "unit_no"], "left").join(repairs, ["doc_id", "unit_no"], "left")
    repaired = F.coalesce("repair", "rewritten")
    clean = F.size(claims.new_claims(F.col("original"), repaired)) == 0
    status = F.when(F.size("new_claims") == 0, "skipped").when(F.col("verdict").isNull(), "unavailable").when(F.col("verdict") != "FAIL", "passed").when(clean, "repaired").otherwise("failed")
    text = F.when(status == "repaired", repaired).when(status == "failed", F.col("original")).otherwise(F.col("rewritten"))
    return joined.select("doc_id", "unit_no", "original", "rewritten", "new_claims", "escalation", status.alias("status"), text.alias("final"))


def audit(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of a document's changed pairs, applied only if there are exactly as many as changed pairs."""
    changed = pairs.filter("trim(rewritten) <> '' and rewritten <> original")
    numbered = changed.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no")) - 1)
    wanted = numbered.groupBy("doc_id").agg(F.count("*").alias("wanted"))
    got = verdicts.groupBy("doc_id").agg(F.count("*").alias("got"))
    complete = wanted.join(got, "doc_id").filter("wanted = got").select("doc_id")
    kind = F.when(F.lower("kind").isin("role", "scope", "impact"), F.lower("kind")).otherwise("role")
    said = verdicts.join(complete, "doc_id", "left_semi").filter("verdict = 'overstated'").select("doc_id", "pos", kind.alias("kind"), F.substring("reason", 1, 300).alias("reason"))
    return numbered.join(said, ["doc_id", "pos"]).select("doc_id", "unit_no", "kind", "reason")


def guard(judged: DataFrame) -> DataFrame:
    """Counts of what the guards held back, per critic status."""
    return judged.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(F.col("escalation").isNotNull()).alias("escalations"),
        F.count_if((F.size("new_claims") > 0) & (F.col("status") != "passed")).alias("open_claims"), F.count_if((F.col("status") == "failed") & (F.col("final") == F.col("original"))).alias("withheld"))


def flags(judged: DataFrame, decided: DataFrame) -> DataFrame:
    """actionable: text changed; flagged: an open figure or an escalation; accept_all: actionable, not flagged
    and not decided yet."""
    actionable = F.col("rewritten") != F.col("original")
    flagged = ((F.size("new_claims") > 0) & (F.col("status") != "passed")) | F.col("escalation").isNotNull()
    known = decided.select("doc_id", "unit_no", F.lit(True).alias("decided")).distinct()
    return judged.join(known, ["doc_id", "unit_no"], "left").select("doc_id", "unit_no", actionable.alias("actionable"), flagged.alias("flagged"), (actionable & ~flagged & F.col("decided").isNull()).alias("accept_all"))


def confusion(cases: DataFrame, predictions: dict, actuals: dict) -> DataFrame:
    """Counts, precision (1 without predictions), recall and F1 of each detector and of any of them. Each detector is asked
    once a case, and cases are counted where they lie."""
    names, said, true = list(predictions), F.array(*predictions.values()), F.array(*[actuals[n] for n in predictions])
    p, a = F.col("p"), F.col("a")
    judged = cases.select(let(F.struct(said.alias("p"), true.alias("a")), lambda x: F.struct(F.concat(x["p"], F.array(F.array_contains(x["p"], True))).alias("p"), F.concat(x["a"], F.array(F.array_contains(x["a"], True))).alias("a"))).alias("x")).select("x.p", "x.a")
    per = judged.groupBy("p", "a").agg(F.count("*").alias("n"))  # as many rows as there are outcomes of the detectors
    rows = per.select("n", F.posexplode(F.arrays_zip("p", "a")).alias("i", "x")).select("n", F.array(*map(F.lit, [*names, "any"]))[F.col("i")].alias("detector"), "x.p", "x.a")
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = rows.groupBy("detector").agg(held(p & a).alias("tp"), held(p & ~a).alias("fp"), held(~p & a).alias("fn"), held(~p & ~a).alias("tn"))
    ratio = lambda n, m: F.when(m == 0, 1.0).otherwise(n / m)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"))


def gate(scores: DataFrame, precision: float = 0.8, recall: float = 0.55) -> DataFrame:
    """Whether every detector reaches the floors."""
    return scores.agg(F.bool_and((F.col("precision") >= precision) & (F.col("recall") >= recall)).alias("passed"), F.count("*").alias("detectors"))
