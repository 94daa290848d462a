"""Queries over lines: sources, headings, sections, units, contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.functions.text import strip_markdown
from attest.operators import lines as ops
from attest.plans import fixtures as fx
from attest.plans import sql
from attest.plans.registry import query

_SECTION_CASE = "CASE line WHEN 'Work Experience' THEN 'EXPERIENCE' WHEN 'EDUCATION' THEN 'EDUCATION' WHEN 'Technical Skills:' THEN 'SKILLS' WHEN 'Projects' THEN 'PROJECTS' WHEN 'Profile' THEN 'SUMMARY' END"
HEADS = f"{fx.HEADED_LINES}, heads AS (SELECT *, CASE WHEN line_no % 5 = 0 THEN {_SECTION_CASE} END AS heading FROM headed_lines)"
CONTENT = f"""{HEADS}, filled AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section,
  lag(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous FROM heads),
content AS (SELECT doc_id, line_no, coalesce(section, 'HEADER') AS section, line FROM filled WHERE heading IS NULL)"""


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({sql.squeeze(c)}, '{lx.BULLET}', ''))"


def header_sql(line: str, section: str) -> str:
    clean = _squeezed(line)
    ws = f"list_filter(regexp_split_to_array({clean}, ' '), lambda w: w <> '')"
    n, end = f"len({ws})", rf"NOT regexp_matches(trim({clean}), '[.!?]\s*$')"
    titled = rf"(len(list_filter({ws}, lambda w: regexp_matches(w, '^\p{{Lu}}') OR (regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}')))) / greatest({n}, 1))"
    action = rf"lower(regexp_extract({clean}, '^[^\pL\pN_]*([A-Za-z]+)', 1)) IN ({sql.items(lx.OPENERS)})"
    return f"""CASE WHEN regexp_matches({sql.squeeze(line)}, '{lx.BULLET}') THEN false WHEN {n} = 0 THEN true WHEN {n} <= 3 AND {clean} LIKE '%:' THEN true
  WHEN {section} NOT IN ({sql.items(lx.RELAXED_HEADER)}) AND {n} <= 4 AND {end} THEN true
  WHEN regexp_matches({clean}, '{lx.DATE_RANGE}') AND {n} <= 20 AND {end} THEN true WHEN regexp_matches({clean}, '{lx.DATE}') AND {n} <= 14 AND {end} THEN true
  WHEN regexp_matches({clean}, '{lx.JOB_TITLE}') AND {end} THEN true WHEN {section} = 'SKILLS' THEN false
  WHEN {section} = 'PROJECTS' THEN (regexp_matches({clean}, '[|–—]') AND {n} <= 12 AND NOT {action}) OR ({n} <= 5 AND NOT {action} AND {end} AND {titled} >= 0.6)
  ELSE {titled} >= 0.75 AND {n} <= 14 AND NOT {action} AND {end} END"""


def candidate_sql(line: str, section: str, header: str) -> str:
    clean = _squeezed(line)
    n = f"len(list_filter(regexp_split_to_array({clean}, ' '), lambda w: w <> ''))"
    relaxed = f"{section} IN ({sql.items(lx.RELAXED_UNIT)})"
    action = rf"lower(regexp_extract({clean}, '^[^\pL\pN_]*([A-Za-z]+)', 1)) IN ({sql.items(lx.OPENERS)})"
    return f"""(NOT {header} AND length({clean}) >= CASE WHEN {relaxed} THEN 20 ELSE 35 END AND {n} >= CASE WHEN {relaxed} THEN 3 ELSE 6 END AND NOT regexp_matches({clean}, '{lx.LINK}')
  AND (({section} = 'PROJECTS' AND {action}) OR regexp_matches({sql.squeeze(line)}, '{lx.BULLET}') OR {n} >= CASE WHEN {relaxed} THEN 3 ELSE 7 END))"""


FLAGGED = f"{CONTENT}, h AS (SELECT *, {header_sql('line', 'section')} AS header FROM content), flagged AS (SELECT *, {candidate_sql('line', 'section', 'header')} AS cand FROM h)"


@query(f"WITH {fx.PLAIN_LINES} SELECT doc_id, line_no, line FROM plain_lines")
def src_lines(spark, d):
    return fx.plain_lines(spark, d)


@query(f"WITH {fx.PLAIN_LINES} SELECT doc_id, line_no, line AS plain FROM plain_lines WHERE NOT regexp_matches(line, '[*_`#>]')")
def src_markdown(spark, d):
    """Marks are put around lines that hold none, and taken off again."""
    bare = fx.plain_lines(spark, d).filter(~F.col("line").rlike("[*_`#>]"))
    k = F.col("line_no") % 4
    marked = F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat(F.lit("**"), "line", F.lit("**"))).when(k == 2, F.concat(F.lit("> `"), "line", F.lit("`"))).otherwise(F.concat(F.lit("*"), "line", F.lit("*")))
    return bare.select("doc_id", "line_no", strip_markdown(F.when(k == 2, F.concat(F.lit("`"), "line", F.lit("`"))).otherwise(marked)).alias("plain"))


@query(f"WITH {HEADS} SELECT doc_id, line_no, heading FROM heads WHERE heading IS NOT NULL")
def seg_headings(spark, d):
    return fx.headed_lines(spark, d).select("doc_id", "line_no", ops.match_section(F.col("line")).alias("heading")).filter("heading is not null")


@query(f"WITH {fx.PLAIN_LINES} SELECT doc_id, line_no, CASE WHEN line_no % 6 = 0 THEN 'EXPERIENCE' END AS heading, line_no % 6 = 1 AS skipped FROM plain_lines WHERE line_no % 6 <= 1 AND doc_id * 100000 + line_no - line_no % 6 + 1 IN (SELECT doc_id * 100000 + line_no FROM plain_lines)")
def seg_wrapped(spark, d):
    """Headings that wrap over two lines: WORK / EXPERIENCE."""
    k = F.col("line_no") % 6
    wrapped = fx.plain_lines(spark, d).withColumn("line", F.when(k == 0, "WORK").when(k == 1, "HISTORY").otherwise(F.col("line")))
    found = ops.headings(wrapped).filter("line_no % 6 <= 1")
    pairs = found.filter("line_no % 6 = 1").select("doc_id", (F.col("line_no") - 1).alias("first"))
    found = found.withColumn("first", F.col("line_no") - F.col("line_no") % 6).join(pairs, ["doc_id", "first"], "left_semi")
    return found.select("doc_id", "line_no", "heading", "skipped")


@query(f"WITH {CONTENT} SELECT * FROM content")
def seg_sections(spark, d):
    return ops.sections(fx.headed_lines(spark, d))


_UNIT_TEXT = f"trim(regexp_replace(string_agg({_squeezed('line')}, ' ' ORDER BY line_no), '\\s+', ' ', 'g'))"
UNIT_ROWS = f"""{FLAGGED}, idx AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) - 1 AS idx FROM flagged),
kept AS (SELECT * FROM idx WHERE {_squeezed('line')} <> ''),
starts AS (SELECT *, header OR coalesce(lag(header) OVER w, true) OR regexp_matches({sql.squeeze('line')}, '{lx.BULLET}') OR coalesce(lag(regexp_matches(trim(line), '[.!?]\\s*$')) OVER w AND cand, false) AS s FROM kept WINDOW w AS (PARTITION BY doc_id, section ORDER BY line_no)),
numbered AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY doc_id, section ORDER BY line_no) AS unit_no FROM starts),
built AS (SELECT doc_id, section, unit_no, {_UNIT_TEXT} AS text, list(idx ORDER BY idx) AS line_indices FROM numbered GROUP BY doc_id, section, unit_no)"""


@query(f"WITH {UNIT_ROWS} SELECT doc_id, section, unit_no, section || ':' || line_indices[1] || ':' || left(sha1(text), 10) AS unit_id, text, line_indices FROM built")
def seg_units(spark, d):
    return ops.units(ops.sections(fx.headed_lines(spark, d))).drop("eligible")


@query(f"WITH {CONTENT} SELECT doc_id, s AS section FROM documents, (VALUES ('EXPERIENCE'), ('EDUCATION'), ('SKILLS')) AS r(s) WHERE (doc_id, s) NOT IN (SELECT doc_id, section FROM content)")
def pred_missing_sections(spark, d):
    return ops.missing_sections(fx.table(spark, d, "documents"), ops.sections(fx.headed_lines(spark, d)))


@query(f"WITH {FLAGGED} SELECT doc_id, line_no, section, header FROM flagged")
def pred_is_header(spark, d):
    return ops.sections(fx.headed_lines(spark, d)).select("doc_id", "line_no", "section", ops.is_header(F.col("line"), F.col("section")).alias("header"))


@query(f"WITH {FLAGGED} SELECT doc_id, line_no, section, cand AS candidate FROM flagged")
def pred_candidate(spark, d):
    return ops.sections(fx.headed_lines(spark, d)).select("doc_id", "line_no", "section", ops.is_candidate(F.col("line"), F.col("section")).alias("candidate"))


def _parts(line: str) -> str:
    body = f"CASE WHEN contains(left({line}, 40), ':') THEN substr({line}, strpos({line}, ':') + 1) ELSE {line} END"
    return f"list_filter(list_transform(regexp_split_to_array({body}, '[,;|•·]'), lambda p: trim(p)), lambda p: p <> '')"


def _listed() -> str:
    """Over columns parts, lead and tier."""
    return f"""(len(parts) >= 3 AND coalesce(list_sum(list_transform(parts, lambda p: len(list_filter(regexp_split_to_array({sql.squeeze('p')}, ' '), lambda w: w <> '')))), 0) / greatest(len(parts), 1) <= 3
  AND {sql.strength('lead', 'tier')} = 0)"""


GATHERED = f"""{UNIT_ROWS}, e AS (SELECT doc_id, section, unit_no, {_UNIT_TEXT} AS text, bool_or(header) AS header, bool_or(cand) AS any_cand FROM numbered GROUP BY doc_id, section, unit_no),
th AS (SELECT *, {header_sql('text', 'section')} AS th, {_parts('text')} AS parts, {sql.opener('text')} AS clean FROM e), tl AS (SELECT *, {sql.lead_form('clean')} AS lead FROM th), tt AS (SELECT *, {sql.lead_tier('lead')} AS tier FROM tl),
f AS (SELECT *, NOT header AND any_cand AND {candidate_sql('text', 'section', 'th')} AS fits, {_listed()} AS listed, len(list_filter(regexp_split_to_array(text, ' '), lambda w: w <> '')) AS n FROM tt)"""


ELIGIBLE = f"""CASE WHEN section = 'HEADER' THEN false WHEN section IN ({sql.items(lx.PRIMARY_SECTIONS)}) THEN fits AND NOT th AND NOT listed
  ELSE section NOT IN ({sql.items(lx.LIST_SECTIONS)}) AND (fits OR n >= 4) AND NOT th AND NOT listed END"""


@query(f"WITH {GATHERED} SELECT doc_id, section, unit_no, {ELIGIBLE} AS eligible FROM f")
def pred_eligible(spark, d):
    return ops.units(ops.sections(fx.headed_lines(spark, d))).select("doc_id", "section", "unit_no", "eligible")


@query(f"""WITH {fx.PLAIN_LINES}, p AS (SELECT *, {_parts('line')} AS parts, {sql.opener('line')} AS clean FROM plain_lines), l AS (SELECT *, {sql.lead_form('clean')} AS lead FROM p), t AS (SELECT *, {sql.lead_tier('lead')} AS tier FROM l)
SELECT doc_id, line_no, {_listed()} AS listed FROM t""")
def pred_list(spark, d):
    return fx.plain_lines(spark, d).select("doc_id", "line_no", ops.looks_like_list(F.col("line")).alias("listed"))


_TAKE = {"email": lx.EMAIL, "phone": lx.PHONE, "linkedin": lx.LINKEDIN, "github": lx.GITHUB, "url": lx.URL}


def _first(name: str) -> str:
    value = f"nullif(regexp_extract(line, '{_TAKE[name]}'), '')"
    if name == "phone":
        value = rf"CASE WHEN NOT regexp_matches(trim({value}), '^\(?(19|20)\d{{2}}\)?\s*[-–—]\s*\(?(19|20)\d{{2}}\)?$') THEN trim({value}) END"
    if name == "url":
        value = f"CASE WHEN NOT regexp_matches({value}, '(?i)linkedin|github') THEN {value} END"
    return f"{value} AS {name}"


@query(f"""WITH {fx.PLAIN_LINES}, f AS (SELECT doc_id, line_no, line, {', '.join(_first(n) for n in _TAKE)} FROM plain_lines WHERE line_no < 15)
SELECT doc_id, {', '.join(f'arg_min({n}, line_no) FILTER ({n} IS NOT NULL) AS {n}' for n in _TAKE)}, max(line) FILTER (line_no = 0 AND email IS NULL AND phone IS NULL) AS name FROM f GROUP BY doc_id""")
def pred_contact(spark, d):
    return ops.contacts(fx.plain_lines(spark, d))


_LINKS = " OR ".join(f"regexp_matches(line, '{p}')" for p in (lx.EMAIL, lx.PHONE, lx.LINKEDIN, lx.GITHUB))


_LATER = f"{fx.PLAIN_LINES}, late AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 4 THEN 'Work Experience' ELSE line END AS line FROM plain_lines)"


@query(f"""WITH {_LATER}, f AS (SELECT doc_id, line_no, line, {', '.join(_first(n) for n in _TAKE)} FROM late WHERE line_no < 15),
c AS (SELECT doc_id, {', '.join(f'arg_min({n}, line_no) FILTER ({n} IS NOT NULL) AS {n}' for n in _TAKE)}, max(line) FILTER (line_no = 0 AND email IS NULL AND phone IS NULL) AS name FROM f GROUP BY doc_id)
SELECT doc_id, line_no, line FROM late JOIN c USING (doc_id) WHERE line_no < 4 AND NOT ({_LINKS}) AND NOT list_contains(list_filter([{', '.join(_TAKE)}, name], lambda v: v IS NOT NULL), line)""")
def pred_header_residue(spark, d):
    """What stands before the first heading, the fifth line here, without contacts."""
    late = fx.plain_lines(spark, d).withColumn("line", F.when(F.col("line_no") % 5 == 4, "Work Experience").otherwise(F.col("line")))
    return ops.header_residue(late).select("doc_id", "line_no", "line")


@query(f"WITH {fx.PLAIN_LINES}, n AS (SELECT d.doc_id, count(*) FILTER (length(trim(line)) > 3) AS n_lines FROM documents d LEFT JOIN plain_lines p ON p.doc_id = d.doc_id GROUP BY d.doc_id) SELECT * FROM n WHERE n_lines < 10")
def agg_needs_ocr(spark, d):
    return ops.needs_ocr(fx.table(spark, d, "documents"), fx.plain_lines(spark, d))


ASSEMBLED = f"""{CONTENT}, parts AS (SELECT doc_id, section, min(line_no) AS first, string_agg(line, chr(10) ORDER BY line_no) AS body FROM content GROUP BY doc_id, section),
assembled AS (SELECT doc_id, string_agg('## ' || section || chr(10) || body, chr(10) || chr(10) ORDER BY first) AS text FROM parts GROUP BY doc_id)"""


@query(f"WITH {ASSEMBLED} SELECT * FROM assembled")
def sink_assemble(spark, d):
    return ops.assemble(ops.sections(fx.headed_lines(spark, d)))


@query(f"""WITH {CONTENT}, p AS (SELECT doc_id, section, min(line_no) AS first, CASE section WHEN 'SKILLS' THEN 'spliced' ELSE string_agg(line, chr(10) ORDER BY line_no) END AS body FROM content GROUP BY doc_id, section)
SELECT doc_id, CASE WHEN bool_or(section = 'SKILLS') THEN string_agg('## ' || section || chr(10) || body, chr(10) || chr(10) ORDER BY first) END AS text FROM p GROUP BY doc_id""")
def text_splice(spark, d):
    return ops.assemble(ops.sections(fx.headed_lines(spark, d))).select("doc_id", ops.splice(F.col("text"), F.lit("SKILLS"), F.lit("spliced")).alias("text"))


@query(f"""WITH {CONTENT}, names AS (SELECT doc_id, section, min(line_no) AS f FROM content GROUP BY doc_id, section), g AS (SELECT doc_id, string_agg(section, ' ' ORDER BY f) FILTER (section <> 'SKILLS') AS out, bool_or(section = 'SKILLS') AS has FROM names GROUP BY doc_id)
SELECT doc_id, coalesce(out, '') || CASE WHEN has AND NOT contains(coalesce(out, ''), 'SKILLS') THEN ' SKILLS' ELSE '' END AS text FROM g""")
def rw_missing_sections(spark, d):
    """A generated text that dropped SKILLS gets it appended."""
    names = ops.sections(fx.headed_lines(spark, d)).groupBy("doc_id", "section").agg(F.min("line_no").alias("first"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("first", "section"))), lambda p: p["section"])
    docs = names.groupBy("doc_id").agg(every.alias("names")).withColumn("text", F.array_join(F.filter("names", lambda s: s != "SKILLS"), " "))
    gone = F.filter("names", lambda s: ~F.contains(F.upper(F.col("text")), s))
    return docs.select("doc_id", F.concat("text", F.array_join(F.transform(gone, lambda s: F.concat(F.lit(" "), s)), "")).alias("text"))


@query(f"WITH {fx.PLAIN_LINES}, b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM plain_lines) SELECT doc_id, line_no, line FROM b WHERE before IS NULL OR before <> line")
def win_collapse(spark, d):
    return ops.collapse_runs(fx.plain_lines(spark, d))


@query(f"""WITH {fx.PLAIN_LINES}, n AS (SELECT doc_id, doc_id // 2 AS pair, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM plain_lines),
a AS (SELECT * FROM n WHERE doc_id % 2 = 0), b AS (SELECT * FROM n WHERE doc_id % 2 = 1)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.line, b.line) AS line, coalesce(a.nth, b.nth) AS nth, CASE WHEN a.line IS NULL THEN 'added' WHEN b.line IS NULL THEN 'removed' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.pair = b.pair AND a.line = b.line AND a.nth = b.nth""")
def set_line_diff(spark, d):
    rows = fx.plain_lines(spark, d).withColumn("pair", F.expr("doc_id div 2"))
    return ops.line_diff(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))


@query(f"""WITH {CONTENT}, s AS (SELECT doc_id, doc_id // 2 AS pair, section, string_agg(line, chr(10) ORDER BY line_no) AS body FROM content GROUP BY doc_id, section),
a AS (SELECT * FROM s WHERE doc_id % 2 = 0), b AS (SELECT * FROM s WHERE doc_id % 2 = 1)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.section, b.section) AS section, a.body AS before, b.body AS after, a.body IS DISTINCT FROM b.body AS changed FROM a FULL JOIN b ON a.pair = b.pair AND a.section = b.section""")
def join_section_diff(spark, d):
    rows = ops.sections(fx.headed_lines(spark, d)).withColumn("pair", F.expr("doc_id div 2"))
    return ops.section_diff(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))
