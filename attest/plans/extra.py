"""Queries over page structure, layout, imports, result documents, review state, vectors and stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attest.operators import retrieve, review
from attest.plans import fixtures as fx
from attest.plans.registry import query
from attest.sources import layout, pages, records
from attest.sources.shared import shared_dir
from attest.streaming import ops as streams
from attest.streaming import stateful

A, L = fx.ATTEMPTS, fx.LOG

_HEADER = rf"""len(string_split(x, ' ')) <= 8 AND NOT regexp_matches(x, '[.!?]$') AND ((ends_with(x, ':') AND len(string_split(x, ' ')) <= 4) OR (regexp_matches(x, '{pages.PAGE_HEADER}') AND len(string_split(x, ' ')) <= 5)
  OR (regexp_replace(x, ':+$', '') = upper(regexp_replace(x, ':+$', '')) AND x <> lower(x)))"""
_LOUD = "CASE WHEN length(x) < 60 THEN upper(replace({0}, 'ß', 'SS')) ELSE x END"
_NAMES = {k: ", ".join(f"'{n}'" for n in getattr(pages, k)) for k in ("SKIPPED", "HEADINGS", "LINES", "STRUCTURED", "VOID")}
#: What is put into every page: text beside and inside structured elements, unclosed ones, ends without a beginning.
NESTED = "<div>beside <b>bold</b><ul><li>an <i>item</i> of it<li>open item</ul>tail</div></section><div><span>Who you are</span><br>one <em>line</em></div><p>Perks:</p><section>LOUD WORDS<table><tr><td>in a cell</td></tr></table></section><div><p>and</p>un<b>closed</div>"


def _pages_nested(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<article>"), F.lit(f"{NESTED}<article>")).alias("html"))


@query(rf"""WITH RECURSIVE h AS (SELECT page_id, regexp_replace(replace(html, '<article>', '{NESTED}<article>'), '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', ' ', 'g') AS t FROM pages),
k AS (SELECT page_id, i, ts[i] AS t FROM (SELECT page_id, regexp_extract_all(t, '(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z][^>]*>|[^<]+|<') AS ts FROM h), unnest(range(1, len(ts) + 1)) AS r(i)),
n AS (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) AS name, CASE WHEN regexp_matches(t, '^<[!?]') THEN 'none' WHEN regexp_matches(t, '^</[A-Za-z]') THEN 'end' WHEN regexp_matches(t, '^<[A-Za-z]') THEN 'begin' ELSE 'text' END AS kind FROM k),
f AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS path FROM h
  UNION ALL SELECT f.page_id, n.i, CASE WHEN kind = 'begin' AND name NOT IN ({_NAMES["VOID"]}) THEN list_append(ids, n.i) WHEN kind = 'end' AND list_contains(names, name) THEN ids[1:len(ids) - list_position(list_reverse(names), name)] ELSE ids END,
    CASE WHEN kind = 'begin' AND name NOT IN ({_NAMES["VOID"]}) THEN list_append(names, name) WHEN kind = 'end' AND list_contains(names, name) THEN names[1:len(names) - list_position(list_reverse(names), name)] ELSE names END, ids
  FROM f JOIN n ON n.page_id = f.page_id AND n.i = f.i + 1),
p AS (SELECT n.*, path FROM f JOIN n USING (page_id, i)), s AS (SELECT DISTINCT page_id, path[-1] AS i FROM p WHERE kind = 'begin' AND name IN ({_NAMES["STRUCTURED"]}) AND len(path) > 0),
w AS (SELECT page_id, i, name FROM p WHERE kind = 'begin' AND (name IN ('li', {_NAMES["SKIPPED"]}, {_NAMES["HEADINGS"]}) OR (name IN ({_NAMES["LINES"]}) AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = p.page_id AND s.i = p.i)))),
a AS (SELECT page_id, i, t, unnest(path) AS e FROM p WHERE kind = 'text'), c AS (SELECT a.page_id, a.i, min(a.e) AS e FROM a JOIN w ON w.page_id = a.page_id AND w.i = a.e GROUP BY a.page_id, a.i),
g AS (SELECT p.page_id, coalesce(c.e, p.i) AS spot, coalesce(max(w.name), '') AS kind, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(string_agg(p.t, ' ' ORDER BY p.i), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS x
  FROM p LEFT JOIN c ON c.page_id = p.page_id AND c.i = p.i LEFT JOIN w ON w.page_id = c.page_id AND w.i = c.e WHERE p.kind = 'text' GROUP BY p.page_id, coalesce(c.e, p.i)),
o AS (SELECT page_id, flatten(list(CASE WHEN kind IN ({_NAMES["HEADINGS"]}) THEN ['', {_LOUD.format('x')}, ''] WHEN kind = 'li' THEN ['- ' || x] WHEN kind <> '' AND {_HEADER} THEN ['', {_LOUD.format("regexp_replace(x, ':+$', '')")}, ''] ELSE [x] END ORDER BY spot)) AS f
  FROM g WHERE x <> '' AND kind NOT IN ({_NAMES["SKIPPED"]}) GROUP BY page_id)
SELECT page_id, regexp_replace(array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda i: i = 1 OR f[i - 1] <> f[i]), lambda i: f[i]), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM o""")
def src_html(spark, d):
    """Pages with nested, unclosed and stray elements put in before the article."""
    return pages.html_text(_pages_nested(spark, d), ["page_id"])


@query("""WITH p AS (SELECT o_custkey AS owner_id, o_orderkey AS ord, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'Org ' || o_orderstatus END AS company, strftime(o_orderdate, '%Y') AS started, o_orderkey % 4 AS k FROM orders),
j AS (SELECT owner_id, 'EXPERIENCE' AS section, ord, 0 AS i, concat_ws(' | ', title, nullif(trim(company), ''), CASE WHEN k = 0 THEN started ELSE started || ' - 2020' END) AS line FROM p
  UNION ALL SELECT owner_id, 'EXPERIENCE', ord, 1, 'did ' || ord FROM p WHERE k = 1 UNION ALL SELECT owner_id, 'EXPERIENCE', ord, 3, 'and more' FROM p WHERE k = 1
  UNION ALL SELECT s_suppkey, 'EDUCATION', 0, 0, s_name || ' | school' FROM supplier
  UNION ALL SELECT c_custkey, 'SKILLS', 0, 0, array_to_string(list_filter([trim(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN 'second' END], lambda x: x IS NOT NULL), ', ') FROM customer)
SELECT owner_id, concat_ws(' ', c_name, CASE WHEN owner_id % 2 = 0 THEN c_mktsegment END) AS name, section, CAST(row_number() OVER (PARTITION BY owner_id, section ORDER BY ord, i) - 1 AS INTEGER) AS line_no, line FROM j JOIN customer ON c_custkey = owner_id""")
def src_profile(spark, d):
    """Customers as profiles: their orders as positions, suppliers of the same number as schools."""
    c, o = fx.table(spark, d, "customer"), fx.table(spark, d, "orders")
    profile = c.select(F.col("c_custkey").alias("owner_id"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("last")).withColumnRenamed("c_name", "first")
    year = F.date_format("o_orderdate", "yyyy")
    positions = o.select(
        F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("Org "), "o_orderstatus")).alias("company"),
        year.alias("started"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("2020").alias("finished"),
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" did "), F.col("o_orderkey").cast("string"), F.lit("\n \n and more"))).alias("description"),
    )
    education = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("owner_id"), F.lit(0).cast("long").alias("ord"), F.col("s_name").alias("degree"), F.lit("school").alias("school"), F.lit(" ").alias("notes"))
    skills = c.select(F.col("c_custkey").alias("owner_id"), F.lit(0).cast("long").alias("ord"), F.col("c_mktsegment").alias("name")).unionByName(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("owner_id"), F.lit(1).cast("long").alias("ord"), F.lit("second").alias("name")))
    out = records.profile_import(profile, positions, education, skills)
    return out.join(c.select(F.col("c_custkey").alias("owner_id")), "owner_id", "left_semi")


def _pages_of_boxes(spark, d):
    """Two order lines in three moved to a right-hand column, so that some pages have a gutter; every seventh box is
    a date, every tenth a lone list mark, every other fifth nothing but a line end; lines end in tabs and line ends."""
    b = fx.boxes(spark, d)
    right = F.col("box") % 3 != 0
    text = F.when(F.col("box") % 7 == 0, "\tJan 2019 - present\n").when(F.col("box") % 10 == 0, "-\n").when(F.col("box") % 5 == 0, "\n").otherwise(F.concat(F.lit("\t"), "text", F.lit("\t\n  and more \n")))
    return b.select("page", "box", F.when(right, F.col("x0") % 100 + 350).otherwise(F.col("x0") % 100).alias("x0"), "y0", F.when(right, F.col("x0") % 100 + 450).otherwise(F.col("x0") % 100 + 150).alias("x1"), "y1", text.alias("text"))


_DATE = layout.DATE_BLOCK
_BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_LAYOUT = rf"""{fx.BOXES}, bx AS (SELECT page, box, CASE WHEN box % 3 <> 0 THEN x0 % 100 + 350 ELSE x0 % 100 END AS x0, y0, CASE WHEN box % 3 <> 0 THEN x0 % 100 + 450 ELSE x0 % 100 + 150 END AS x1, y1,
  CASE WHEN box % 7 = 0 THEN chr(9) || 'Jan 2019 - present' || chr(10) WHEN box % 10 = 0 THEN '-' || chr(10) ELSE chr(9) || text || chr(9) || chr(10) || '  and more ' || chr(10) END AS text FROM boxes WHERE box % 7 = 0 OR box % 10 = 0 OR box % 5 <> 0),
pr AS (SELECT * FROM bx a WHERE EXISTS (SELECT 1 FROM bx b WHERE a.page = b.page AND a.box <> b.box AND a.y0 < b.y1 AND b.y0 < a.y1 AND (a.x1 <= b.x0 OR b.x1 <= a.x0))),
pm AS (SELECT * FROM pr WHERE page IN (SELECT page FROM pr GROUP BY page HAVING count(*) >= 4)),
fr AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page ORDER BY x0, x1, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM pm),
kk AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY x0, x1, box ROWS UNBOUNDED PRECEDING) AS k FROM fr), mg AS (SELECT page, k, min(x0) AS x0, max(x1) AS x1 FROM kk GROUP BY page, k),
gp AS (SELECT page, x1, lead(x0) OVER (PARTITION BY page ORDER BY x0) - x1 AS gap FROM mg),
gw AS (SELECT page, arg_max(x1 + gap / 2, (gap, -x1)) AS gutter FROM gp WHERE gap >= 6 AND x1 + gap / 2 BETWEEN 612 * 0.2 AND 612 * 0.8 GROUP BY page),
sd AS (SELECT page, gutter, x1 <= gutter AS l, x0 >= gutter AS r, regexp_matches({_BARE}, '{_DATE}') AS dt, length({_BARE}) AS n FROM bx JOIN gw USING (page)),
gt AS (SELECT page, gutter FROM sd GROUP BY page, gutter HAVING count(*) FILTER (l) >= 2 AND count(*) FILTER (r) >= 2 AND 2 * count(*) FILTER (l AND dt) < count(*) FILTER (l) AND 2 * count(*) FILTER (r AND dt) < count(*) FILTER (r)
  AND least(coalesce(sum(n) FILTER (l), 0), coalesce(sum(n) FILTER (r), 0)) >= 0.15 * (coalesce(sum(n) FILTER (l), 0) + coalesce(sum(n) FILTER (r), 0))),
ro AS (SELECT bx.*, gutter, coalesce(bx.x0 < gutter AND gutter < bx.x1, false) AS span FROM bx LEFT JOIN gt USING (page)),
bd AS (SELECT *, count(*) FILTER (span) OVER (PARTITION BY page ORDER BY y0) AS above, row_number() OVER (PARTITION BY page, span ORDER BY y0, x0, box) - 1 AS nth FROM ro),
so AS (SELECT *, CASE WHEN gutter IS NULL THEN CAST(round_even(y0 / 10, 0) AS BIGINT) WHEN span THEN nth ELSE above END AS band, CASE WHEN gutter IS NULL THEN 0 WHEN span THEN 2 WHEN x0 >= gutter THEN 1 ELSE 0 END AS side, CASE WHEN gutter IS NULL THEN 0.0 ELSE y0 END AS down FROM bd),
ordered AS (SELECT page, box, gutter, text, row_number() OVER (PARTITION BY page ORDER BY band, side, down, x0, box) - 1 AS line_no FROM so)"""


@query(f"WITH {_LAYOUT} SELECT page, box, gutter, line_no FROM ordered")
def layout_order(spark, d):
    return layout.reading_order(_pages_of_boxes(spark, d)).select("page", "box", "gutter", "line_no")


@query(rf"""WITH {_LAYOUT}, ln AS (SELECT page, line_no AS spot, i, regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g') AS line FROM ordered, range(1, 4) AS r(i) WHERE i <= len(string_split(text, chr(10))))
SELECT page, row_number() OVER (PARTITION BY page ORDER BY spot, i) - 1 AS line_no, line FROM ln WHERE line NOT IN ('', '-')""")
def src_layout_lines(spark, d):
    return layout.layout_lines(_pages_of_boxes(spark, d))


def _results(spark, d):
    """Orders as stored result documents."""
    o = fx.table(spark, d, "orders")
    words = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 7 + 1).cast("int")), lambda i: F.concat(F.lit("k"), i.cast("string")))
    has = F.col("o_orderkey") % 4 != 0
    doc = F.to_json(F.struct(
        F.concat(F.lit("Org "), "o_orderpriority").alias("company"), F.when(has, words).alias("jd_keywords"), F.when(has, F.slice(words, 1, 2)).alias("missing_keywords"),
        F.when(F.col("o_orderkey") % 8 == 0, F.lit(55)).alias("match_pct"), F.struct((F.col("o_totalprice").cast("long") % 101).alias("total")).alias("score")))
    return o.select(F.col("o_orderkey").alias("analysis_id"), doc.alias("results"), F.when(F.col("o_orderkey") % 5 == 0, "kept").alias("company"))


@query("""WITH x AS (SELECT o_orderkey AS analysis_id, o_orderkey % 7 + 1 AS n, o_orderkey AS k, o_orderpriority AS p, CAST(trunc(o_totalprice) AS BIGINT) % 101 AS t FROM orders)
SELECT analysis_id, CASE WHEN k % 5 = 0 THEN 'kept' ELSE 'Org ' || p END AS company, CAST(CASE WHEN k % 4 <> 0 THEN floor((n - least(n, 2)) / n * 100 + 0.5) WHEN k % 8 = 0 THEN 55 END AS INTEGER) AS match_pct, '{"total":' || t || '}' AS score_json, '{}' AS timing_json FROM x""")
def sink_summary(spark, d):
    return records.backfill(_results(spark, d)).drop("results")


@query("""WITH x AS (SELECT o_orderkey AS analysis_id, o_orderstatus AS attempt_type, o_orderkey % 7 + 1 AS n, o_orderkey AS k, o_orderpriority AS p, CAST(trunc(o_totalprice) AS BIGINT) % 101 AS t FROM orders)
SELECT analysis_id, attempt_type, CASE WHEN k % 5 = 0 THEN 'kept' WHEN k % 6 = 1 AND attempt_type = 'F' THEN 'later' ELSE 'Org ' || p END AS company, CAST(CASE WHEN k % 4 <> 0 THEN floor((n - least(n, 2)) / n * 100 + 0.5) WHEN k % 8 = 0 THEN 55 END AS INTEGER) AS match_pct, '{"total":' || t || '}' AS score_json FROM x""")
def sink_saved(spark, d):
    """Result documents saved by type: all without summaries, those of one type that come again twice, then a backfill, twice."""
    rows = _results(spark, d).join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("attempt_type")), "analysis_id")
    path = f"{shared_dir(spark)}/attest-saved-{uuid.uuid4().hex}"
    poor = rows.withColumns({"match_pct": F.lit(None).cast("int"), "score_json": F.lit(None).cast("string"), "timing_json": F.lit(None).cast("string")})
    poor.write.partitionBy("attempt_type").parquet(path)  # as a version without summaries left them
    again = rows.filter("analysis_id % 6 = 1 and attempt_type = 'F'").withColumn("company", F.coalesce("company", F.lit("later")))
    for _ in range(2):
        records.save_analyses(again, path)
    for _ in range(2):
        records.backfill_saved(spark, path)
    return spark.read.parquet(path).select("analysis_id", "attempt_type", "company", "match_pct", "score_json")


@query(f"""WITH {A}, x AS (SELECT analysis_id, score AS s, analysis_id % 3 AS k FROM attempts),
c AS (SELECT analysis_id, unnest(CASE WHEN k = 0 THEN ['base', 'sections', 'keywords', 'bullet_quality', 'action_verbs', 'warnings', 'total'] ELSE ['quantification', 'action_verbs', 'structure', 'total'] END) AS component,
  unnest(CASE WHEN k = 0 THEN [s // 2, 5, 0, 0, 0, -1, s] ELSE [s // 3, s // 4, 0, s] END) AS points, unnest(CASE WHEN k = 0 THEN [NULL, NULL, NULL, NULL, NULL, NULL, 100] WHEN k = 1 THEN [40, 30, 30, 100] ELSE [50, 30, 20, 100] END) AS most FROM x)
SELECT analysis_id, component, CAST(points AS INTEGER) AS points, CAST(most AS INTEGER) AS most FROM c""")
def pred_components(spark, d):
    s, k = F.col("score"), F.col("analysis_id") % 3
    half = lambda n: F.floor(s / n).cast("int")
    old = F.to_json(F.struct(half(2).alias("base"), F.lit(5).alias("sections"), F.lit(-1).alias("warnings"), s.alias("total")))
    now = F.to_json(F.struct(half(3).alias("quantification"), half(4).alias("action_verbs"), s.alias("total")))
    own = F.to_json(F.struct(half(3).alias("quantification"), half(4).alias("action_verbs"), s.alias("total"), F.struct(F.lit(50).alias("quantification"), F.lit(20).alias("structure")).alias("weights")))
    return records.score_components(fx.attempts(spark, d).select("analysis_id", F.when(k == 0, old).when(k == 1, now).otherwise(own).alias("score")))


@query(f"""WITH {L}, f AS (SELECT event_id AS id, user_id, item, CASE kind WHEN 'mentor_feedback' THEN 'edit' WHEN 'accepted' THEN 'section_edit' ELSE 'comment' END AS t, CASE WHEN event_id % 4 <> 0 THEN item END AS a FROM log),
o AS (SELECT DISTINCT item, user_id FROM log WHERE kind = 'new_attempt')
SELECT f.id, f.t AS feedback_type, CASE WHEN t <> 'comment' AND id % 5 = 0 THEN 'no text' WHEN t = 'section_edit' AND id % 3 = 0 THEN 'no section' WHEN t = 'comment' AND id % 6 = 0 THEN 'no comment' WHEN t <> 'comment' AND a IS NULL THEN 'no analysis'
  WHEN a IS NOT NULL AND o.item IS NULL THEN 'not found' END AS reason FROM f LEFT JOIN o ON o.item = f.a AND o.user_id = f.user_id""")
def pred_feedback_valid(spark, d):
    log = fx.log(spark, d)
    kind = F.when(F.col("kind") == "mentor_feedback", "edit").when(F.col("kind") == "accepted", "section_edit").otherwise(F.col("kind"))
    i = F.col("event_id")
    rows = log.select(i.alias("id"), F.col("user_id").alias("candidate_id"), F.when(i % 4 != 0, F.col("item")).alias("analysis_id"), kind.alias("feedback_type"), F.when(i % 3 == 0, " ").otherwise("SKILLS").alias("section"), F.when(i % 5 != 0, "text").alias("suggested_text"), F.when(i % 6 != 0, "so").alias("comment"))
    owned = log.filter("kind = 'new_attempt'").select(F.col("item").alias("analysis_id"), F.col("user_id").alias("candidate_id"))
    return records.feedback_valid(rows, owned).select("id", "feedback_type", "reason")


@query(f"""WITH {fx.PLAIN_LINES}, n AS (SELECT doc_id, 'S' || (line_no % 2) AS section, line_no // 2 AS idx, line FROM plain_lines), h AS (SELECT doc_id, section, idx, line, (doc_id + idx // 3) % 5 AS k FROM n WHERE idx % 3 = 0),
x AS (SELECT n.*, h.k, h.line AS original, h.idx AS first FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.section = n.section AND n.idx BETWEEN h.idx AND h.idx + 1 AND h.k < 3)
SELECT doc_id, section, idx, CASE WHEN k IS NULL THEN line WHEN k = 0 THEN 'now ' || original WHEN k = 1 THEN original ELSE 'override ' || idx END AS line, CASE WHEN k IS NULL THEN 'as is' WHEN k = 0 THEN 'accepted' WHEN k = 1 THEN 'dismissed' ELSE 'override' END AS via
FROM x WHERE (first IS NULL OR first = idx) AND NOT (doc_id % 4 = 0 AND section = 'S1')
UNION ALL SELECT DISTINCT doc_id, section, unnest([0, 1]), unnest(['all', 'new ' || doc_id]), 'section' FROM n WHERE doc_id % 4 = 0 AND section = 'S1'""")
def join_resolve(spark, d):
    """Every third line of a section, with the one after it, has a suggestion: accepted, dismissed, overridden,
    undecided, or none at all. In every fourth document a mentor has rewritten one section."""
    n = fx.plain_lines(spark, d).select("doc_id", F.concat(F.lit("S"), (F.col("line_no") % 2).cast("string")).alias("section"), F.floor(F.col("line_no") / 2).cast("int").alias("idx"), "line")
    ident = F.concat_ws(":", "section", F.col("idx").cast("string"))
    h = n.filter("idx % 3 = 0").withColumn("k", (F.col("doc_id") + F.floor(F.col("idx") / 3)) % 5).withColumn("id", ident)
    framework = F.when(F.col("k") == 4, "none").otherwise("star")
    suggestions = h.select("doc_id", "section", "id", F.col("idx").alias("first"), (F.col("idx") + 1).alias("last"), F.col("line").alias("original"), F.concat(F.lit("now "), "line").alias("rewritten"), framework.alias("framework"))
    decisions = h.filter("k in (0, 1, 4)").select("doc_id", "id", (F.col("k") != 1).alias("accepted"))
    overrides = h.filter("k = 2").select("doc_id", "id", F.concat(F.lit("override "), F.col("idx").cast("string")).alias("text"))
    sections = n.filter("doc_id % 4 = 0").select("doc_id").distinct().select("doc_id", F.lit("S1").alias("section"), F.concat(F.lit("all\r\n \nnew "), F.col("doc_id").cast("string")).alias("text"))
    return review.resolve_lines(n, suggestions, decisions, overrides, sections=sections)


_DOCUMENT = "# CV\n## A\nalpha\n## B\nbeta"


@query(f"""WITH RECURSIVE {L}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item, kind, event_id) AS i, item AS id, kind, item % 3 = 0 AS whole, CASE WHEN item % 2 = 0 THEN '## A' ELSE '## B' END AS head, CASE WHEN item % 3 = 0 THEN '## A' || chr(10) || 'whole ' || item ELSE 'part ' || item END AS text FROM log WHERE kind IN ('accepted', 'dismissed')),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, content VARCHAR)[]) AS kept FROM e GROUP BY user_id
  UNION ALL SELECT user_id, i, CASE WHEN kind = 'dismissed' THEN list_filter(kept, lambda x: x.id <> CAST(id AS BIGINT)) WHEN whole THEN list_append(kept, {{'id': CAST(id AS BIGINT), 'content': text}})
    WHEN spot > 0 THEN list_append(kept, {{'id': CAST(id AS BIGINT), 'content': left(now, spot + 3) || chr(10) || text || chr(10) || CASE WHEN strpos(substr(now, spot + 4), chr(10) || '## ') > 0 THEN substr(substr(now, spot + 4), strpos(substr(now, spot + 4), chr(10) || '## ')) ELSE '' END}}) ELSE kept END
  FROM (SELECT *, strpos(now, head) AS spot FROM (SELECT e.*, kept, coalesce(kept[-1].content, replace('# CV|## A|alpha|## B|beta', '|', chr(10))) AS now FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))),
l AS (SELECT user_id, arg_max(kept, i) AS kept FROM f GROUP BY user_id)
SELECT user_id AS analysis_id, CAST(r - 1 AS INTEGER) AS revision, kept[r].id AS feedback_id, kept[r].content AS content FROM l, unnest(range(1, len(kept) + 1)) AS t(r)""")
def join_apply_feedback(spark, d):
    """Every user's log as decisions on edits of one document; the tests hold it against a loop too."""
    log = fx.log(spark, d).filter("kind in ('accepted', 'dismissed')")
    documents = log.select(F.col("user_id").alias("analysis_id")).distinct().withColumn("content", F.lit(_DOCUMENT))
    item = F.col("item").cast("string")
    rows = log.select(F.col("user_id").alias("analysis_id"), "ts", F.col("item").alias("feedback_id"), F.col("kind").alias("status"), F.when(F.col("item") % 3 == 0, "edit").otherwise("section_edit").alias("feedback_type"),
                      F.when(F.col("item") % 2 == 0, "A").otherwise("B").alias("section"), F.when(F.col("item") % 3 == 0, F.concat(F.lit("## A\nwhole "), item)).otherwise(F.concat(F.lit("part "), item)).alias("text"))
    return review.apply_feedback(documents, rows)


@query(f"""WITH {A} SELECT analysis_id, user_id, CAST(CASE WHEN analysis_id % 4 = 0 THEN score WHEN analysis_id % 4 = 1 THEN NULL WHEN analysis_id % 4 = 2 THEN 7 ELSE score END AS INTEGER) AS score,
CASE WHEN analysis_id % 4 = 1 THEN '' WHEN analysis_id % 4 = 2 THEN 'new' ELSE company END AS company FROM attempts""")
def join_refresh(spark, d):
    """Of four attempts one isn't read again, one has its job text cleared, one gets new fields, one a reading
    without any."""
    a = fx.attempts(spark, d).select("analysis_id", "user_id", "score", "company")
    k = F.col("analysis_id") % 4
    reads = a.filter(k > 0).select("analysis_id", F.when(k == 1, " ").otherwise("a job").alias("job_text"), F.when(k == 2, 7).alias("score"), F.when(k == 2, "new").alias("company"))
    return review.refresh_profile(a, reads, {"score": F.lit(None).cast("int"), "company": F.lit("")})


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
s AS (SELECT q.vec_id, g.vec_id AS guide_id, round(list_dot_product(q.v, g.v), 3) AS score FROM u q, u g WHERE q.vec_id >= 8 AND g.vec_id < 8), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guide_id) AS rank FROM s),
f AS (SELECT vec_id // 6 AS batch_id, guide_id, min((vec_id, rank)) AS spot FROM r WHERE rank <= 3 GROUP BY 1, 2) SELECT batch_id, guide_id, 'F' || row_number() OVER (PARTITION BY batch_id ORDER BY spot, guide_id) AS label FROM f""")
def rw_guides(spark, d):
    v = fx.table(spark, d, "embeddings")
    hits = retrieve.topk(v.filter("vec_id >= 8"), v.filter("vec_id < 8"))
    return review.label_guides(hits.select(F.floor(F.col("vec_id") / 6).alias("batch_id"), F.col("vec_id").alias("pos"), "rank", "guide_id"))


_NEAR = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS other_id, list_dot_product(a.v, b.v) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id)"""


@query(f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other_id) AS k FROM s WHERE score >= 0.4) SELECT vec_id, other_id, round(score, 6) AS score FROM r WHERE k = 1")
def vec_near_dup(spark, d):
    return retrieve.near_duplicates(fx.table(spark, d, "embeddings"), 0.4).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_NEAR}, near AS (SELECT vec_id, list(other_id) AS o FROM s WHERE score >= 0.3 AND other_id < vec_id AND vec_id % 3 <> 2 AND other_id % 3 <> 2 GROUP BY vec_id),
k AS (SELECT e.vec_id, coalesce(o, []) AS o, row_number() OVER (ORDER BY e.vec_id) AS i FROM embeddings e LEFT JOIN near ON near.vec_id = e.vec_id WHERE e.vec_id % 3 <> 2),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held UNION ALL SELECT k.i, CASE WHEN list_has_any(k.o, held) THEN held ELSE list_append(held, k.vec_id) END FROM g JOIN k ON k.i = g.i + 1),
l AS (SELECT held FROM g ORDER BY i DESC LIMIT 1), q AS (SELECT vec_id - CASE WHEN vec_id % 3 = 2 THEN 1 ELSE 0 END AS first, vec_id % 3 = 2 AS again FROM embeddings)
SELECT count(*) FILTER (again AND list_contains(held, first)) AS exact_hits, count(*) FILTER (NOT list_contains(held, first)) AS semantic_hits, max(len(held)) AS misses, max(len(held)) AS entries FROM q, l""")
def agg_cache_profile(spark, d):
    """Every third query repeats the one before it."""
    e = fx.table(spark, d, "embeddings")
    key = F.col("vec_id") - F.when(F.col("vec_id") % 3 == 2, 1).otherwise(0)
    return retrieve.cache_profile(e.select("vec_id", key.alias("key"), "embedding"), 0.3)


@query(f"""WITH {fx.HEADED_LINES}, x AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, line_no, line AS section FROM headed_lines WHERE line_no % 5 = 0), f AS (SELECT pair, section, min((side, line_no)) AS spot FROM x GROUP BY pair, section)
SELECT pair, section, row_number() OVER (PARTITION BY pair ORDER BY spot) AS pos FROM f""")
def set_sections(spark, d):
    heads = fx.headed_lines(spark, d).filter("line_no % 5 = 0").select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), "line_no", F.col("line").alias("section"))
    return review.all_sections(heads.filter("side = 0"), heads.filter("side = 1"))


@query("WITH m AS (SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id) SELECT user_id, CASE WHEN last_ts < (SELECT max(ts) FROM events) - INTERVAL 720 MINUTE THEN 'failed' ELSE 'rerun' END AS action FROM m WHERE state <> 'purchase'")
def st_stalled_stream(spark, d):
    """Jobs without news for twelve hours, by timers of the stream."""
    news = streams.run_available(stateful.stalled(streams.read_events(spark, d), 720, "purchase"), "append", timers=True)
    last = news.groupBy("user_id").agg(F.max_by("action", F.struct("ts", (F.col("action") == "failed").alias("late"))).alias("action"))
    return last.filter("action <> 'closed'")


@query("SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame, props AS data FROM events")
def st_frames(spark, d):
    """Every user's stream of frames, cut into chunks of seven characters."""
    e = streams.read_events(spark, d).select(F.col("user_id").alias("stream_id"), "event_id", F.concat(F.lit("event: x\ndata: "), "props", F.lit("\n\n")).alias("frame"))
    n = F.ceil(F.length("frame") / 7).cast("int")
    cut = e.select("stream_id", "event_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col("frame"), i * 7 + 1, F.lit(7)))).alias("i", "chunk"))
    chunks = cut.select("stream_id", (F.col("event_id") * 1000 + F.col("i")).alias("chunk_no"), "chunk")
    return streams.run_available(stateful.frames(chunks), "append").filter(pages.is_json(F.col("data")))


@query("""WITH RECURSIVE t AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, ts AS anchor, 1 AS made FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, CASE WHEN t.ts - f.anchor > INTERVAL 5 MINUTE THEN t.ts ELSE f.anchor END, f.made + CAST(t.ts - f.anchor > INTERVAL 5 MINUTE AS INTEGER) FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)
SELECT user_id, CAST(max(made) AS BIGINT) AS snapshots FROM f GROUP BY user_id""")
def st_snapshots(spark, d):
    return streams.run_available(stateful.snapshots(streams.read_events(spark, d), 5), "append").groupBy("user_id").agg(F.count("*").alias("snapshots"))


def _last(feed, action):
    """(event_id, user_id) of the rows of which the feed says nothing after ``action``."""
    gone = feed.filter(F.col("action") != action).select("event_id")
    return feed.filter(F.col("action") == action).join(gone, "event_id", "left_anti").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)")
def st_retention(spark, d):
    """Guests' rows drop out of the stream's state a day after they came."""
    rows = streams.read_events(spark, d).select("event_id", "user_id", "ts", (F.col("user_id") % 10 == 0).alias("guest"))
    return _last(streams.run_available(stateful.retention(rows, 24), "append", timers=True), "kept")


@query(f"""WITH {L}, r AS (SELECT user_id, item, ts FROM log WHERE kind = 'mark_read'), e AS (SELECT user_id, max(ts) AS ts FROM r WHERE item % 5 = 0 GROUP BY user_id), i AS (SELECT user_id, item, max(ts) AS ts FROM r WHERE item % 5 <> 0 GROUP BY user_id, item)
SELECT event_id, log.user_id FROM log LEFT JOIN e ON e.user_id = log.user_id LEFT JOIN i ON i.user_id = log.user_id AND i.item = log.item WHERE kind <> 'mark_read' AND (e.ts IS NULL OR log.ts > e.ts) AND (i.ts IS NULL OR log.ts > i.ts)""")
def st_unread(spark, d):
    """What is unread at the end of the log, from a stream of news and readings; every fifth item's reading is one of all."""
    e = streams.read_events(spark, d)
    item = F.get_json_object("props", "$.k").cast("int")
    what = F.when(F.col("event_type") != "view", "news").when(item % 5 == 0, "all").otherwise("item")
    rows = e.select("event_id", "user_id", "ts", item.alias("item"), what.alias("what"))
    return _last(streams.run_available(stateful.inbox(rows), "append"), "unread")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'), m AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) AS mark)
SELECT c.event_id, p.event_id AS news_id FROM c CROSS JOIN m LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 120 MINUTE WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 120 MINUTE < mark""")
def st_enrich(spark, d):
    """Clicks with the purchases of the two hours after them; without any once these are over."""
    e = streams.read_events(spark, d)
    return streams.run_available(streams.enrich(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), 120), "append", timers=True)


@query("""WITH m AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS half, max(ts) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, ts FROM events, m WHERE ts > half)
SELECT start, count(*) AS n, (SELECT count(*) FROM events, m WHERE ts <= half) AS late FROM w, m WHERE start + INTERVAL 15 MINUTE <= mark GROUP BY start""")
def st_late(spark, d):
    """The newer half of the events comes first; by then the older half is too late, is dropped and counted."""
    events = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.timestamp_micros(F.lit(events.agg(F.expr("(unix_micros(min(ts)) + unix_micros(max(ts))) div 2")).first()[0]))  # one moment
    folder = f"{shared_dir(spark)}/attest-late-{uuid.uuid4().hex}"
    for part in (events.filter(F.col("ts") > half), events.limit(0), events.filter(F.col("ts") <= half)):  # a batch in between, as late rows are told by the mark of the batch before
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, late = streams.run_counted(streams.closed_windows(stream, "15 minutes", "1 hour"), "append", timers=True)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.lit(late).cast("long").alias("late"))
