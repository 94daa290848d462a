"""Review-shaped inputs bound to the driver's tables, as DataFrames and as the same thing in DuckDB SQL.

The tables hold no reviews, so lines, units, pairs, attempts and logs are derived from them row by row; every
fixture grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.functions.text import lines

OPENERS = ["Built", "Helped with", "Managed", "Contributed to", "Was responsible for", "Presented", "Reviewing"]
SECTIONS = {"A": "EXPERIENCE", "N": "PROJECTS", "R": "SUMMARY"}
HEADING_LINES = ["Work Experience", "EDUCATION", "Technical Skills:", "Projects", "Profile"]
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
EVENT_KIND = {"signup": "new_attempt", "click": "mentor_feedback", "view": "mark_read", "purchase": "accepted", "error": "dismissed"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: list[str], i: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({i} as int) + 1)"


def _pick_sql(values: list[str], i: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[cast({i} as int) + 1]"


def _case(values: dict[str, str], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_UNIT_TAIL = """CASE cast(l_quantity AS int) % 3 WHEN 0 THEN ' for ' || cast(l_quantity AS int) || ' users'
  WHEN 1 THEN ' cutting cost by ' || cast(round(l_discount * 100) AS int) || '%' ELSE ' and various reports for our own team this month' END"""
_ORIGINAL_TAIL = """CASE cast(l_quantity AS int) % 4 WHEN 0 THEN ' for ' || cast(l_quantity AS int) || ' users'
  WHEN 1 THEN ' by ' || cast(l_quantity AS int) || '%' WHEN 2 THEN ' since 2019' ELSE '' END"""
_REWRITTEN_TAIL = """CASE cast(round(l_tax * 100) AS int) % 5 WHEN 0 THEN ' for ' || cast(l_quantity AS int) || ' users'
  WHEN 1 THEN ' by ' || cast(l_quantity AS int) || '%' WHEN 2 THEN ' by [X%]' WHEN 3 THEN ' saving $' || cast(l_quantity AS int) || 'k' ELSE ' for ' || cast(l_quantity AS int) || ' people' END"""


def _numbered(rows: DataFrame, key: str, into: str) -> DataFrame:
    """Order lines numbered within their order, now called ``key``. What is made of a line is made after that: the lines
    are moved as they are, once for all that a query makes of them, and stay where rules by ``key`` look for them."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*ITEM_ORDER))
    return rows.withColumnRenamed("l_orderkey", key).withColumn(into, number)


def units(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, unit_no, section, text): one unit per order line."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return _numbered(rows, "doc_id", "unit_no").select(
        "doc_id", "unit_no", F.expr(_case(SECTIONS, "l_returnflag")).alias("section"),
        F.expr(f"{_pick(OPENERS, 'l_linenumber % 7')} || ' the ' || p_name || {_UNIT_TAIL}").alias("text"),
    )


UNITS = f"""units AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS unit_no,
  {_case(SECTIONS, 'l_returnflag')} AS section, {_pick_sql(OPENERS, 'l_linenumber % 7')} || ' the ' || p_name || {_UNIT_TAIL} AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, unit_no, original, rewritten)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return _numbered(rows, "doc_id", "unit_no").select(
        "doc_id", "unit_no",
        F.expr(f"{_pick(OPENERS, 'l_linenumber % 7')} || ' the ' || p_name || {_ORIGINAL_TAIL}").alias("original"),
        F.expr(f"{_pick(OPENERS, '(l_linenumber + l_suppkey) % 7')} || ' the ' || p_name || {_REWRITTEN_TAIL}").alias("rewritten"),
    )


PAIRS = f"""pairs AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS unit_no,
  {_pick_sql(OPENERS, 'l_linenumber % 7')} || ' the ' || p_name || {_ORIGINAL_TAIL} AS original,
  {_pick_sql(OPENERS, '(l_linenumber + l_suppkey) % 7')} || ' the ' || p_name || {_REWRITTEN_TAIL} AS rewritten
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def plain_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, line) of the documents; line numbers count the lines that aren't blank, from 0."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


PLAIN_LINES = r"""plain_lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, list_filter(list_transform(
  regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i))"""


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    """As ``plain_lines``, every fifth line a heading."""
    heading = F.expr(_pick(HEADING_LINES, "(doc_id + (line_no - line_no % 5) / 5) % 5"))
    return plain_lines(spark, d).withColumn("line", F.when(F.col("line_no") % 5 == 0, heading).otherwise(F.col("line")))


HEADED_LINES = f"""{PLAIN_LINES}, headed_lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN {_pick_sql(HEADING_LINES, '(doc_id + (line_no - line_no % 5) / 5) % 5')} ELSE line END AS line FROM plain_lines)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """(analysis_id, user_id, created_at, score, attempt_type, company)."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice").cast("long") % 101).cast("int").alias("score"), F.col("o_orderstatus").alias("attempt_type"), F.col("o_orderpriority").alias("company"),
    )


ATTEMPTS = """attempts AS (SELECT o_orderkey AS analysis_id, o_custkey AS user_id, o_orderdate AS created_at,
  CAST(CAST(trunc(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS score, o_orderstatus AS attempt_type, o_orderpriority AS company FROM orders)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, mentor_id, user_id): a nation's first three suppliers mentor its customers."""
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    mentors = table(spark, d, "supplier").withColumn("k", first).filter("k <= 3").select(F.col("s_nationkey").alias("session_id"), F.col("s_suppkey").alias("mentor_id"))
    users = table(spark, d, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("user_id"))
    return users.join(F.broadcast(mentors), "session_id").select("session_id", "mentor_id", "user_id")  # three mentors in each of 25 sessions


MEMBERS = """mentors AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
members AS (SELECT s_nationkey AS session_id, s_suppkey AS mentor_id, c_custkey AS user_id FROM mentors JOIN customer ON s_nationkey = c_nationkey WHERE k <= 3)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ts, user_id, kind, item, value): the event table as a review log; ``item`` from its JSON."""
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", F.expr(_case(EVENT_KIND, "event_type")).alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("item"), "value",
    )


LOG = f"log AS (SELECT event_id, ts, user_id, {_case(EVENT_KIND, 'event_type')} AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, value FROM events)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page, box, x0, y0, x1, y1, text): order lines as text boxes on a page."""
    rows = _numbered(table(spark, d, "lineitem"), "page", "box")
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_linenumber") * 12).cast("double")
    return rows.select("page", "box", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"), (y0 + 10).alias("y1"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_discount").alias("discount"))


BOXES = f"""boxes AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS box,
  CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_linenumber * 12 AS DOUBLE) AS y0, CAST(l_partkey % 500 AS DOUBLE) + l_quantity * 4 AS x1, CAST(l_linenumber * 12 AS DOUBLE) + 10 AS y1,
  'part ' || l_partkey AS text, l_discount AS discount FROM lineitem)"""


def job_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, ord, keyword): one job per market segment; its keywords are words of the benchmark items."""
    words = F.explode(F.split(F.lower("text"), r"[^a-z0-9+#]+")).alias("keyword")
    found = table(spark, d, "benchmark").select((F.col("item_id") % 5).cast("int").alias("job_id"), words).filter(F.length("keyword").between(5, 7)).distinct()
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("job_id").orderBy("keyword"))).select("job_id", "ord", "keyword")


JOB_KEYWORDS = """job_keywords AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY keyword) AS ord, keyword FROM (
  SELECT DISTINCT CAST(item_id % 5 AS INTEGER) AS job_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+#]+')) AS keyword FROM benchmark) WHERE length(keyword) BETWEEN 5 AND 7)"""
