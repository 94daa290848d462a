"""Operators that settle a document from suggestions, decisions and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.text import strip


def resolve_lines(lines: DataFrame, suggestions: DataFrame, decisions: DataFrame, overrides: DataFrame, replacements: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, idx, line, via) after review. lines(doc_id, section, idx, line); suggestions(doc_id, section,
    id, first, last, original, rewritten, framework) cover lines first to last; decisions(doc_id, id, accepted);
    overrides(doc_id, id, text): a mentor's accepted text. Override, then accepted, then dismissed (the original);
    the lines that a settled suggestion covers go. Other lines are as they are, or as ``replacements``(doc_id, line,
    text) say. A suggestion that begins inside a settled one is passed over, hence a fold over the settled ones. A whole
    section that a mentor has rewritten, sections(doc_id, section, text), takes the place of all that: its lines that
    aren't blank, numbered from 0."""
    if sections is not None:
        whole = sections.filter("text is not null").select("doc_id", "section", F.col("text").alias("body"))
        written = F.filter(F.split("body", r"\r\n|[\n\r]"), lambda x: strip(x) != "")
        new = whole.join(lines.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_semi").select("doc_id", "section", F.posexplode(written).alias("idx", "line"), F.lit("section").alias("via"))
        rest = resolve_lines(lines.join(whole, ["doc_id", "section"], "left_anti"), suggestions, decisions, overrides, replacements)
        return rest.unionByName(new.withColumn("idx", F.col("idx").cast(lines.schema["idx"].dataType)))
    usable = suggestions.filter("framework not in ('none', 'error')").join(decisions, ["doc_id", "id"], "left").join(overrides.withColumnRenamed("text", "override"), ["doc_id", "id"], "left")
    via = F.when(F.coalesce("override", F.lit("")) != "", "override").when(F.col("accepted"), "accepted").when(~F.col("accepted"), "dismissed")
    text = F.when(via == "override", F.col("override")).when(via == "accepted", F.coalesce("rewritten", "original")).otherwise(F.col("original"))
    per_first = usable.groupBy("doc_id", "section", "first").agg(F.max_by(F.struct("last", via.alias("via"), text.alias("text")), "id").alias("x")).filter("x.via is not null")
    row = "struct<first:int,last:int,via:string,text:string>"
    events = F.array_sort(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("x.last").cast("int").alias("last"), F.col("x.via").alias("via"), F.col("x.text").alias("text"))))
    start = F.struct(F.lit(-1).alias("until"), F.array().cast(f"array<{row}>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        free = e["first"] > acc["until"]
        return F.struct(F.when(free, e["last"]).otherwise(acc["until"]).alias("until"), F.when(free, F.array_append(acc["kept"], e)).otherwise(acc["kept"]).alias("kept"))

    settled = per_first.groupBy("doc_id", "section").agg(events.alias("events")).select("doc_id", "section", F.inline(F.aggregate("events", start, step)["kept"]))
    covered = settled.select("doc_id", "section", "first", "via", "text", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("idx"))
    out = lines.join(covered, ["doc_id", "section", "idx"], "left").filter("first is null or first = idx")
    line = F.coalesce("text", "line")
    if replacements is not None:
        out = out.join(replacements.withColumnRenamed("text", "replacement"), ["doc_id", "line"], "left")
        line = F.coalesce("text", "replacement", "line")
    return out.select("doc_id", "section", "idx", line.alias("line"), F.coalesce("via", F.lit("as is")).alias("via"))


def patch_section(markdown: Column, section: Column, body: Column) -> Column:
    """The text with what stands between ``## section`` and the next heading replaced; null without that heading."""
    head = F.concat(F.lit("## "), section)
    at = F.instr(markdown, head)
    rest = F.substr(markdown, at + F.length(head))
    following = F.instr(rest, "\n## ")
    tail = F.when(following > 0, F.substr(rest, following)).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(F.substr(markdown, F.lit(1), at + F.length(head) - 1), F.lit("\n"), body, F.lit("\n"), tail))


def apply_feedback(documents: DataFrame, log: DataFrame) -> DataFrame:
    """(analysis_id, revision, feedback_id, content): the revisions that are in force once all feedback has been
    decided on, the last one the effective document. documents(analysis_id, content); log(analysis_id, ts, feedback_id,
    status, feedback_type, section, text). An accepted edit is a revision with its text, an accepted section edit one
    with that section of the then effective document replaced; dismissing takes the feedback's revisions back. What is
    effective depends on all before it: a fold over an analysis's decisions."""
    row = "struct<feedback_id:bigint,content:string>"
    event = F.struct("ts", F.col("feedback_id").cast("long").alias("feedback_id"), "status", "feedback_type", "section", "text")
    events = log.filter("status in ('accepted', 'dismissed')").groupBy("analysis_id").agg(F.array_sort(F.collect_list(event)).alias("events"))

    def step(acc: Column, e: Column) -> Column:
        now = F.coalesce(F.try_element_at(acc, F.lit(-1))["content"], F.col("content"))
        new = F.when(e["feedback_type"] == "edit", F.nullif(e["text"], F.lit(""))).when(e["feedback_type"] == "section_edit", patch_section(now, e["section"], e["text"]))
        added = F.when(new.isNotNull(), F.array_append(acc, F.struct(e["feedback_id"].alias("feedback_id"), new.alias("content")))).otherwise(acc)
        return F.when(e["status"] == "accepted", added).otherwise(F.filter(acc, lambda r: r["feedback_id"] != e["feedback_id"]))

    folded = documents.join(events, "analysis_id").select("analysis_id", F.aggregate("events", F.array().cast(f"array<{row}>"), step).alias("kept"))
    return folded.select("analysis_id", F.posexplode("kept").alias("revision", "r")).select("analysis_id", "revision", "r.feedback_id", "r.content")


def refresh_profile(attempts: DataFrame, reads: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Attempts with a new reading of their job text: its fields where it has them, the old ones where it hasn't, and
    the given blank values where the new job text is blank. reads(analysis_id, job_text, *fields)."""
    new = reads.select("analysis_id", F.col("job_text"), F.lit(True).alias("read"), *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = attempts.join(new, "analysis_id", "left")
    wiped = F.col("read").isNotNull() & (strip(F.coalesce("job_text", F.lit(""))) == "")
    values = {f: F.when(wiped, blank).otherwise(F.coalesce(F.col(f"new_{f}"), F.col(f))) for f, blank in fields.items()}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in attempts.columns])


def label_guides(hits: DataFrame) -> DataFrame:
    """(batch_id, guide_id, label): the guides of a batch, each once, numbered F1, F2, ... by first appearance.
    hits(batch_id, pos, rank, guide_id)."""
    first = hits.groupBy("batch_id", "guide_id").agg(F.min(F.struct("pos", "rank")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("batch_id").orderBy("at", "guide_id"))
    return first.select("batch_id", "guide_id", F.concat(F.lit("F"), nth.cast("string")).alias("label"))


def all_sections(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, section, pos): the section names of two versions, each once, those of the first before those that only
    the second has, in the order in which they first appear. Inputs (pair, section, line_no)."""
    both = left.select("pair", "section", F.lit(0).alias("side"), "line_no").unionByName(right.select("pair", "section", F.lit(1).alias("side"), "line_no"))
    first = both.groupBy("pair", "section").agg(F.min(F.struct("side", "line_no")).alias("at"))
    return first.select("pair", "section", F.row_number().over(Window.partitionBy("pair").orderBy("at")).alias("pos"))
