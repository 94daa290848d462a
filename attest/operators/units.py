"""Operators over text units (doc_id, unit_no, section, text): scoring and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.functions import score
from attest.functions.text import let


def scored(units: DataFrame) -> DataFrame:
    """Units with their signals."""
    return units.withColumn("signals", score.signals(F.col("text")))


def _mean(value: Column, where: Column) -> Column:
    return F.avg(F.when(where, value))


def document_scores(units: DataFrame) -> DataFrame:
    """Per document: the mean of each signal over units of scored sections, or over all graded units where
    there are none; each part rounded half to even, the total their sum."""
    s = scored(units)
    counted, graded = F.col("section").isin(lx.SCORED_SECTIONS), ~F.col("section").isin(lx.UNGRADED_SECTIONS)
    parts = {"quantification": F.col("signals.quantified").cast("double"), "action_verbs": F.col("signals.action_verb"), "structure": F.col("signals.form")}
    weights = {"quantification": 40, "action_verbs": 30, "structure": 30}
    n = F.count_if(counted)
    sums = s.groupBy("doc_id").agg(n.alias("n_scored"), F.count("*").alias("n_units"), *[F.coalesce(F.when(n > 0, _mean(v, counted)).otherwise(_mean(v, graded)), F.lit(0.0)).alias(k) for k, v in parts.items()])
    out = sums.select("doc_id", "n_scored", "n_units", *[F.bround(F.round(F.col(k) * w, 9), 0).cast("int").alias(k) for k, w in weights.items()])
    return out.withColumn("total", F.col("quantification") + F.col("action_verbs") + F.col("structure"))


def section_scores(units: DataFrame) -> DataFrame:
    """Per document and section: mean unit score (null where the section isn't graded) and counts."""
    graded = ~F.col("section").isin(lx.UNGRADED_SECTIONS)
    return scored(units).filter("section <> 'HEADER'").groupBy("doc_id", "section").agg(
        F.bround(F.round(F.avg(F.when(graded, F.col("signals.score"))), 9), 0).cast("int").alias("quality"),
        F.count("*").alias("n_units"), F.count_if(F.col("signals.quantified")).alias("n_quantified"), F.count_if(F.col("signals.action_verb") == 1.0).alias("n_action"),
    )


def preview(units: DataFrame) -> DataFrame:
    """Per document: units, strong ones, ones to rewrite."""
    strong = score.is_strong(F.col("signals"))
    return scored(units).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count_if(strong).alias("n_strong"), F.count_if(~strong).alias("n_rewrite"))


def extremes(sections: DataFrame) -> DataFrame:
    """Strongest and weakest graded section per document; the first in section order wins a tie."""
    order = F.when(F.col("section") == "EXPERIENCE", 0).when(F.col("section") == "PROJECTS", 1).otherwise(2)
    return sections.filter("quality is not null").groupBy("doc_id").agg(
        F.max_by("section", F.struct("quality", -order)).alias("strongest"), F.min_by("section", F.struct("quality", order)).alias("weakest"))


def heatmap(sections: DataFrame, columns: list[str]) -> DataFrame:
    """Documents by sections."""
    return sections.groupBy("doc_id").pivot("section", columns).agg(F.first("quality"))


def improved(sections: DataFrame, order: str) -> DataFrame:
    """Per user: the section whose quality rose most between the last two documents that grade it."""
    before = Window.partitionBy("user_id", "section").orderBy(order, "doc_id")
    last = Window.partitionBy("user_id", "section").orderBy(F.desc(order), F.desc("doc_id"))
    change = sections.filter("quality is not null").withColumn("change", F.col("quality") - F.lag("quality").over(before)).withColumn("k", F.row_number().over(last)).filter("k = 1 and change > 0")
    return change.groupBy("user_id").agg(F.max_by(F.struct("section", "change"), F.struct("change", F.expr("-ascii(section)"))).alias("best")).select("user_id", "best.section", "best.change")


def batches(units: DataFrame, size: int = 6) -> DataFrame:
    """Units that aren't strong, in order, so many to a batch."""
    weak = units.filter(~score.strong(F.col("text")))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no")) - 1
    return weak.select("doc_id", "unit_no", F.floor(turn / size).alias("batch"), (turn % size).alias("pos"), "text")


def rule_rewrite(units: DataFrame, *more: Column) -> DataFrame:
    """A rewrite without a model: units without a figure get a placeholder; severity from the score. ``more`` are columns
    of the same pass, of ``signals`` too."""
    s = scored(units)
    text = F.when(F.col("signals.quantified"), F.col("text")).otherwise(F.concat(F.regexp_replace("text", r"[.\s]+$", ""), F.lit(", improving [metric] by [X%]")))
    severity = F.when(F.col("signals.score") < 40, "red").when(F.col("signals.score") < 75, "yellow").otherwise("green")
    return s.select("doc_id", "unit_no", "section", F.col("text").alias("original"), text.alias("rewritten"), severity.alias("severity"), *more)


def model_stage(batched: DataFrame, cached: DataFrame, fn, schema: str, calls: int = 8) -> DataFrame:
    """Texts without a cached answer go through ``fn`` (batches of pandas rows to rows), ``calls`` at a time."""
    waiting = batched.join(cached.select("text").distinct(), "text", "left_anti")
    return waiting.repartition(calls, "doc_id", "batch").mapInPandas(fn, schema)


def content_words(text: Column) -> Column:
    """The distinct words of three letters or more that tell a text from others."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9+#.]*"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*lx.ALIGN_STOPWORDS)))


def _shared(words: Column, of: Column) -> Column:
    return F.size(F.array_intersect(words, of)) / F.greatest(F.lit(1), F.size(of))


def align(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Pair each request with the response of its batch: lengths must match; no index at all means by position;
    a partial index is refused; one that starts at 1 is shifted; it must be a permutation. A batch in which an answer shares
    more of another request's words than of its own, and more than 0.3, is refused as misplaced, however it was
    indexed. Both sides meet once, by batch; a batch is what one call answers, so its words travel as one array."""
    asked = requests.select("batch_id", F.lit(True).alias("asked"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("idx"), F.col("original").alias("text"))
    came = responses.select("batch_id", F.lit(False).alias("asked"), F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"), F.col("rewritten").alias("text"))
    batch = Window.partitionBy("batch_id")
    rows = asked.unionByName(came).filter("batch_id is not null").withColumn("before", F.lag("idx").over(batch.orderBy("idx")))
    facts = {"wanted": F.count_if("asked"), "got": F.count_if(~F.col("asked")), "indexed": F.count("idx"), "low": F.min("idx"), "high": F.max("idx"), "twice": F.count_if(F.col("idx") == F.col("before"))}
    rows = rows.withColumns({k: v.over(batch) for k, v in facts.items()})
    whole = (F.col("indexed") == F.col("got")) & (F.col("twice") == 0) & (F.col("high") - F.col("low") == F.col("got") - 1) & F.col("low").isin(0, 1)
    mode = F.when(F.col("got") != F.col("wanted"), "length").when(F.col("indexed") == 0, "position").when(F.col("indexed") < F.col("got"), "partial").when(whole, "index").otherwise("not a permutation")
    at = F.when(F.col("asked") | (F.col("mode") == "position"), F.col("pos")).when(F.col("mode") == "index", F.col("idx") - F.col("low"))
    placed = rows.withColumn("mode", mode).select("batch_id", "asked", "mode", at.alias("at"), "text").filter("asked or at is not null")
    answers = F.collect_list(F.when(~F.col("asked"), F.struct("text"))).over(Window.partitionBy("batch_id", "at"))
    paired = placed.withColumn("answers", answers).filter("asked").withColumn("words", F.when(F.col("mode").isin("position", "index"), content_words(F.col("text"))))
    paired = paired.withColumn("others", F.collect_list(F.when(F.col("words").isNotNull(), F.struct("at", "words"))).over(batch))
    stray = lambda said: let(F.greatest(_shared(said, F.col("words")), F.lit(0.3)), lambda own: F.exists("others", lambda o: ~o["at"].eqNullSafe(F.col("at")) & (_shared(said, o["words"]) > own)))
    strays = F.exists(F.transform("answers", lambda a: content_words(a["text"])), stray)
    paired = paired.withColumn("misplaced", F.coalesce(F.max(strays).over(batch), F.lit(False)))
    refused = F.when(F.col("misplaced"), "misplaced").otherwise(F.col("mode")).alias("mode")
    answer = F.explode_outer(F.when(~F.col("misplaced"), F.col("answers"))).alias("answer")
    found = paired.select("batch_id", F.col("at").cast(requests.schema["pos"].dataType).alias("pos"), F.col("text").alias("original"), refused, answer)
    return found.select("batch_id", "pos", "original", "mode", F.col("answer.text").alias("rewritten"))


def replay(units: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded answers by normalised text, else the text itself."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    answers = recorded.select(key(F.col("text")).alias("key"), "answer").dropDuplicates(["key"])
    return units.withColumn("key", key(F.col("text"))).join(answers, "key", "left").select("doc_id", "unit_no", F.coalesce("answer", "text").alias("answer"), F.col("answer").isNotNull().alias("recorded"))
