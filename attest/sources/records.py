"""Operators over stored records: profile exports, labelled cases, result documents, scores, feedback."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.text import strip
from attest.sources.shared import stored


def _parts(*columns: str) -> Column:
    """What isn't blank, trimmed, joined by `` | ``."""
    return F.concat_ws(" | ", *[F.nullif(strip(F.col(c)), F.lit("")) for c in columns])


def profile_import(profile: DataFrame, positions: DataFrame, education: DataFrame, skills: DataFrame) -> DataFrame:
    """(owner_id, name, section, line_no, line) of a profile's four tables, as spark.read.csv gives them:
    profile(owner_id, first, last); positions(owner_id, ord, title, company, started, finished, description): a head,
    then the lines of the description; education(owner_id, ord, degree, school, notes); skills(owner_id, ord, name):
    one line. Owners without a line are left out."""
    times = positions.withColumn("times", F.concat_ws(" - ", *[F.nullif(strip(F.col(c)), F.lit("")) for c in ("started", "finished")]))
    heads = times.select("owner_id", "ord", F.lit(0).alias("i"), _parts("title", "company", "times").alias("line"))
    text = positions.select("owner_id", "ord", F.posexplode(F.split(F.coalesce("description", F.lit("")), r"\R")).alias("i", "line"))
    jobs = heads.unionByName(text.withColumn("i", F.col("i") + 1)).withColumn("section", F.lit("EXPERIENCE"))
    schools = education.select("owner_id", "ord", F.lit(0).alias("i"), _parts("degree", "school", "notes").alias("line"), F.lit("EDUCATION").alias("section"))
    named = skills.withColumn("name", strip(F.col("name"))).filter("name <> ''").groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("s"))
    can = named.select("owner_id", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("i"), F.array_join(F.transform("s", lambda x: x["name"]), ", ").alias("line"), F.lit("SKILLS").alias("section"))
    rows = jobs.unionByName(schools).unionByName(can).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    listed = rows.groupBy("owner_id", "section").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "line"))).alias("lines"))
    out = listed.select("owner_id", "section", F.posexplode(F.transform("lines", lambda x: x["line"])).alias("line_no", "line"))
    name = F.concat_ws(" ", F.nullif(strip(F.col("first")), F.lit("")), F.nullif(strip(F.col("last")), F.lit("")))
    return out.join(profile.select("owner_id", name.alias("name")), "owner_id", "left").select("owner_id", "name", "section", "line_no", "line")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, original, rewritten, labels, note) of labelled cases: a JSON list, or an object with ``cases``. No case is
    an error."""
    fields = "id string, original string, rewritten string, labels struct<invented_metric:boolean,role_escalation:boolean>, note string"
    raw = spark.read.option("multiLine", True).schema(f"{fields}, cases array<struct<{fields}>>").json(path)
    alone = F.when(F.col("id").isNotNull(), F.array(F.struct(*[c for c in raw.columns if c != "cases"])))
    cases = raw.select(F.inline(F.coalesce("cases", alone)))  # one pass for both forms
    if not cases.take(1):
        raise ValueError(f"no cases in {path}")
    return cases


def summary(results: Column) -> dict[str, Column]:
    """What a list needs of a result document (JSON): company, keyword coverage in percent, else the stored match,
    score and timing as JSON."""
    doc = F.try_parse_json(results)
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    keywords, missing = get("$.jd_keywords", "array<string>"), get("$.missing_keywords", "array<string>")
    n, m = F.coalesce(F.size(keywords), F.lit(0)), F.coalesce(F.size(missing), F.lit(0))
    coverage = F.when(n > 0, F.floor((n - m) / F.greatest(n, F.lit(1)) * 100 + 0.5))
    object_ = lambda name: F.coalesce(F.get_json_object(results, f"$.{name}"), F.lit("{}"))
    return {
        "company": F.substring(F.coalesce(get("$.company", "string"), F.lit("")), 1, 200),
        "match_pct": F.coalesce(coverage, get("$.match_pct", "double")).cast("int"),
        "score_json": object_("score"), "timing_json": object_("timing"),
    }


def backfill(rows: DataFrame, results: str = "results") -> DataFrame:
    """Rows whose summary columns are missing get them from their result document; the others stay as they are."""
    out = rows
    for name, value in summary(F.col(results)).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return out


SUMMARY = ("company", "match_pct", "score_json", "timing_json")


def save_analyses(rows: DataFrame, path: str) -> None:
    """Save rows(analysis_id, attempt_type, results, ...) with their summary columns in a table partitioned by attempt_type. A row
    takes the place of the saved one of its id and type; partitions that it isn't in are left alone, so saving again changes
    nothing."""
    new = backfill(rows)
    types = new.select("attempt_type").distinct()
    if _saved(rows.sparkSession, path):
        old = rows.sparkSession.read.parquet(path).join(types, "attempt_type", "left_semi").join(new.select("analysis_id", "attempt_type"), ["analysis_id", "attempt_type"], "left_anti")
        new = new.unionByName(old, allowMissingColumns=True)
    _overwrite(new, path)


def backfill_saved(spark: SparkSession, path: str) -> int:
    """Fill summary columns that saved rows lack, from their result documents; only partitions with such rows are written. The
    number of rows filled: 0 the second time."""
    saved = spark.read.parquet(path)
    lacking = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in SUMMARY if c != "match_pct"])
    poor = saved.filter(lacking).groupBy("attempt_type").agg(F.count("*").alias("n"))
    n = poor.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n:
        _overwrite(backfill(saved.join(poor.select("attempt_type"), "attempt_type", "left_semi")), path)
    return n


def _saved(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Each partition of the rows anew, no other. The rows may be read from the same table, so they are stored first."""
    stored(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt_type").parquet(path)


def score_components(scores: DataFrame) -> DataFrame:
    """(analysis_id, component, points, most) of score documents (analysis_id, score JSON), in the layout of today and
    in the one before; a missing part counts 0."""
    parts = ["quantification", "action_verbs", "structure", "base", "sections", "keywords", "bullet_quality", "warnings"]
    kind = "struct<" + ",".join(f"{p}:int" for p in (*parts, "total")) + ",weights:struct<quantification:int,action_verbs:int,structure:int>>"
    row = scores.select("analysis_id", F.from_json("score", kind).alias("s")).filter("s is not null")
    most = {"quantification": 40, "action_verbs": 30, "structure": 30}
    part = lambda name, cap=None: F.struct(F.lit(name).alias("component"), F.coalesce(F.col(f"s.{name}"), F.lit(0)).alias("points"), (F.lit(None) if cap is None else cap).cast("int").alias("most"))
    now = F.array(*[part(k, F.coalesce(F.col(f"s.weights.{k}"), F.lit(v))) for k, v in most.items()], part("total", F.lit(100)))
    old = F.array(*[part(k) for k in ("base", "sections", "keywords", "bullet_quality", "action_verbs", "warnings")], part("total", F.lit(100)))
    return row.select("analysis_id", F.inline(F.when(F.col("s.quantification").isNotNull(), now).otherwise(old)))


def feedback_valid(feedback: DataFrame, owned: DataFrame) -> DataFrame:
    """feedback(id, candidate_id, analysis_id, feedback_type, section, suggested_text, comment) with its type settled
    and the first reason against it (null: valid). owned(analysis_id, candidate_id): whose analysis it is."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    typed = feedback.withColumn("feedback_type", F.when(F.col("feedback_type").isin("edit", "section_edit"), F.col("feedback_type")).otherwise("comment"))
    known = typed.join(owned.select("analysis_id", "candidate_id", F.lit(True).alias("own")).distinct(), ["analysis_id", "candidate_id"], "left")
    edit = F.col("feedback_type") != "comment"
    reason = (
        F.when(edit & blank("suggested_text"), "no text").when((F.col("feedback_type") == "section_edit") & blank("section"), "no section")
        .when(~edit & blank("comment"), "no comment").when(edit & F.col("analysis_id").isNull(), "no analysis")
        .when(F.col("analysis_id").isNotNull() & F.col("own").isNull(), "not found")
    )
    return known.select(*feedback.columns, reason.alias("reason"))
