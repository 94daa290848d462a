"""Operators over text boxes of pages (page, box, x0, y0, x1, y1, text): reading order and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.text import strip
from attest.sources.pages import merge_intervals

#: A block that is only a date or a range of dates, and a line that is only a list mark.
DATE_BLOCK = (
    r"(?i)^[\s(]*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?(?:19|20)\d{2}"
    r"(?:\s*(?:[-–—]|to)\s*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?"
    r"(?:(?:19|20)\d{2}|present|current|now))?[\s)]*$"
)
EMPTY_BULLET = r"^\s*[•‣▪▫◦●○\-*]\s*[\x{200B}\x{FEFF}]*\s*$"


def paired(boxes: DataFrame, step: float = 20.0) -> DataFrame:
    """Boxes that share a row with another box they don't overlap sideways. Boxes meet in strips of ``step``, each a list, so
    that boxes which lie by page stay where they are."""
    strip = F.explode(F.sequence(F.floor(F.col("y0") / step), F.floor(F.col("y1") / step))).alias("strip")
    strips = boxes.select("page", F.struct("box", "x0", "y0", "x1", "y1").alias("b"), strip).groupBy("page", "strip").agg(F.collect_list("b").alias("bs"), F.max("b.x0").alias("last"), F.min("b.x1").alias("first"))
    row = lambda a, b: (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    apart = lambda a, b: (a["x1"] <= b["x0"]) | (b["x1"] <= a["x0"])
    # Boxes that all overlap sideways need no look at one another.
    beside = F.filter("bs", lambda a: ((a["x1"] <= F.col("last")) | (F.col("first") <= a["x0"])) & F.exists("bs", lambda b: (a["box"] != b["box"]) & row(a, b) & apart(a, b)))
    return strips.filter("first <= last").select("page", F.inline(beside)).distinct()


def gutters(boxes: DataFrame, width: float) -> DataFrame:
    """(page, gutter) of the pages with two columns of text: the middle of the widest gap between boxes that stand
    side by side, if it lies in the middle of the page and neither side is too little or mostly dates."""
    many = paired(boxes).withColumn("n", F.count("*").over(Window.partitionBy("page"))).filter("n >= 4")
    gap = merge_intervals(many.drop("n")).withColumn("middle", F.col("x1") + F.col("gap") / 2)
    wide = gap.filter((F.col("gap") >= 6) & F.col("middle").between(width * 0.2, width * 0.8))
    widest = wide.groupBy("page").agg(F.max_by("middle", F.struct("gap", -F.col("x1"))).alias("gutter"))
    text = strip(F.col("text"))
    left, right = F.col("x1") <= F.col("gutter"), F.col("x0") >= F.col("gutter")
    aggs = []
    for name, side in (("l", left), ("r", right)):
        aggs += [F.count_if(side).alias(f"{name}_n"), F.count_if(side & text.rlike(DATE_BLOCK)).alias(f"{name}_dates"), F.sum(F.when(side, F.length(text)).otherwise(0)).alias(f"{name}_chars")]
    sides = boxes.join(widest, "page").groupBy("page", "gutter").agg(*aggs)
    ok = "l_n >= 2 and r_n >= 2 and l_dates * 2 < l_n and r_dates * 2 < r_n and least(l_chars, r_chars) >= 0.15 * (l_chars + r_chars)"
    return sides.filter(ok).select("page", "gutter")


def reading_order(boxes: DataFrame, width: float = 612.0) -> DataFrame:
    """The boxes with ``line_no``, their place on the page. One column: row by row. Two columns: each from top to
    bottom; a box across the gutter keeps its place and starts a new band."""
    filled = boxes.filter(strip(F.col("text")) != "")
    shown = filled.join(gutters(filled, width), "page", "left")
    crosses = (F.col("x0") < F.col("gutter")) & (F.col("gutter") < F.col("x1"))
    page = Window.partitionBy("page")
    above = F.count(F.when(F.col("span"), 1)).over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.row_number().over(Window.partitionBy("page", "span").orderBy("y0", "x0", "box")) - 1
    rows = shown.withColumn("span", F.coalesce(crosses, F.lit(False)))
    rows = rows.withColumn("band", F.when(F.col("gutter").isNull(), F.bround(F.col("y0") / 10).cast("long")).when(F.col("span"), nth).otherwise(above))
    side = F.when(F.col("gutter").isNull(), 0).when(F.col("span"), 2).otherwise((F.col("x0") >= F.col("gutter")).cast("int"))
    rows = rows.withColumn("side", side).withColumn("down", F.when(F.col("gutter").isNull(), F.lit(0.0)).otherwise(F.col("y0")))
    order = page.orderBy("band", "side", "down", "x0", "box")
    return rows.withColumn("line_no", F.row_number().over(order) - 1).select(*boxes.columns, "gutter", "line_no")


def layout_lines(boxes: DataFrame, width: float = 612.0) -> DataFrame:
    """(page, line_no, line): the lines of the boxes in reading order, without blank ones and lone list marks."""
    ordered = reading_order(boxes, width).select("page", F.col("line_no").alias("at"), F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    lines = ordered.withColumn("line", strip(F.col("raw"))).filter((F.col("line") != "") & ~F.col("line").rlike(EMPTY_BULLET))
    return lines.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("at", "i")) - 1).alias("line_no"), "line")
