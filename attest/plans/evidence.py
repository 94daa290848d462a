"""Queries over keyword evidence, offers and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.operators import evidence as ev
from attest.plans import fixtures as fx
from attest.plans import sql
from attest.plans.registry import query
from attest.sources.shared import stored

NOUN = "split_part(p_name, ' ', 2)"


#: What units say besides, by (document + unit) modulo 11: names of the same thing, as they count and (the last) as they
#: don't.
SAYINGS = [" using Postgres and JS", " for nine APIs", " in CI", " on k8s", " with js and ci"]
#: Keywords of every job, and for each the evidence that those sayings hold: order of preference, number of the term, spelling.
NAMED = [("PostgreSQL", 1, 0, "Postgres"), ("JavaScript", 1, 0, "JS"), ("API", 0, 0, "APIs"), ("CI/CD", 1, 0, "CI"), ("kubernetes experience", 1, 0, "k8s")]


def _units(spark, d):
    """Units of order lines, each document reviewed against one of three jobs."""
    more = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in SAYINGS]), ((F.col("doc_id") + F.col("unit_no")) % 11 + 1).cast("int")), F.lit(""))
    return fx.units(spark, d).withColumn("job_id", (F.col("doc_id") % 3).cast("int")).withColumn("text", F.concat("text", more))


def _keywords(spark, d):
    """A job's keywords: kinds of parts, the names of parts in the plural, and things with other names."""
    part = fx.table(spark, d, "part").withColumn("job_id", (F.col("p_partkey") % 3).cast("int"))
    known = part.select("job_id", F.explode(F.array(*[F.lit(k) for k, *_ in NAMED])).alias("keyword"))
    words = part.select("job_id", F.lower("p_type").alias("keyword")).union(part.select("job_id", F.concat("p_name", F.lit("s")))).union(known).distinct()
    return words.withColumn("ord", F.dense_rank().over(fx.Window.partitionBy("job_id").orderBy("keyword")))


def _implications(spark, d):
    """A kind of part is implied by the nouns of its smallest parts."""
    part = fx.table(spark, d, "part").filter("p_size <= 2").select(F.lower("p_type").alias("keyword"), F.expr(NOUN).alias("term")).distinct()
    return part.withColumn("term_no", F.row_number().over(fx.Window.partitionBy("keyword").orderBy("term")))


def _contexts(units):
    """The whole text of each document."""
    return ev.whole_texts(units)


_KEYED = f"""{fx.UNITS}, u AS (SELECT doc_id, unit_no, section, text || coalesce(([{sql.items(SAYINGS)}])[(doc_id + unit_no) % 11 + 1], '') AS text, CAST(doc_id % 3 AS INTEGER) AS job_id FROM units),
k AS (SELECT job_id, keyword, dense_rank() OVER (PARTITION BY job_id ORDER BY keyword) AS ord FROM (SELECT DISTINCT CAST(p_partkey % 3 AS INTEGER) AS job_id, unnest([lower(p_type), p_name || 's', {sql.items(k for k, *_ in NAMED)}]) AS keyword FROM part)),
al AS (SELECT * FROM (VALUES {", ".join(str(x) for x in NAMED)}) AS al(keyword, prio, term_no, term)),
called AS (SELECT doc_id, unit_no, section, k.job_id, ord, k.keyword, prio, term_no, term FROM u JOIN k ON k.job_id = u.job_id JOIN al ON al.keyword = k.keyword WHERE contains(' ' || text || ' ', ' ' || term || ' ')),
i AS (SELECT keyword, term, row_number() OVER (PARTITION BY keyword ORDER BY term) AS term_no FROM (SELECT DISTINCT lower(p_type) AS keyword, {NOUN} AS term FROM part WHERE p_size <= 2)),
named AS (SELECT doc_id, unit_no, section, k.job_id, ord, k.keyword, term_no, term FROM u JOIN k ON k.job_id = u.job_id JOIN i ON i.keyword = k.keyword WHERE contains(' ' || text || ' ', ' ' || term || ' ')),
worded AS (SELECT doc_id, unit_no, section, k.job_id, ord, keyword, left(keyword, length(keyword) - 1) AS evidence FROM u JOIN k ON k.job_id = u.job_id WHERE ends_with(keyword, 's') AND contains(keyword, ' ') AND contains(' ' || text || ' ', ' ' || left(keyword, length(keyword) - 1) || ' ')
  UNION ALL SELECT doc_id, unit_no, section, k.job_id, ord, keyword, keyword FROM u JOIN k ON k.job_id = u.job_id WHERE NOT contains(keyword, ' ') AND length(keyword) >= 5 AND contains(' ' || text || ' ', ' ' || keyword || ' ')),
around AS (SELECT s.doc_id, s.unit_no, n.job_id, n.ord, n.keyword, n.term_no, n.term FROM u s JOIN named n ON n.doc_id = s.doc_id WHERE s.section = 'SUMMARY'),
recalled AS (SELECT s.doc_id, s.unit_no, n.job_id, n.ord, n.keyword, n.term_no, n.term FROM u s JOIN called n ON n.doc_id = s.doc_id AND n.prio > 0 WHERE s.section = 'SUMMARY'),
every AS (SELECT doc_id, unit_no, job_id, ord, keyword, 'alias' AS via, prio, term_no, term AS evidence FROM called UNION ALL SELECT doc_id, unit_no, job_id, ord, keyword, 'resume', 5, term_no, term FROM recalled
  UNION ALL SELECT doc_id, unit_no, job_id, ord, keyword, 'implied' AS via, 2 AS prio, term_no, term AS evidence FROM named UNION ALL SELECT doc_id, unit_no, job_id, ord, keyword, 'reworded', 3, 0, evidence FROM worded
  UNION ALL SELECT doc_id, unit_no, job_id, ord, keyword, 'resume', 5, term_no, term FROM around
  UNION ALL SELECT s.doc_id, s.unit_no, k.job_id, k.ord, k.keyword, 'resume', 4, 0, k.keyword FROM u s JOIN u t ON t.doc_id = s.doc_id JOIN k ON k.job_id = s.job_id WHERE s.section = 'SUMMARY' AND contains(' ' || t.text || ' ', ' ' || k.keyword || ' ')),
best AS (SELECT doc_id, unit_no, job_id, ord, keyword, arg_min(via, (prio, term_no)) AS via, arg_min(evidence, (prio, term_no)) AS evidence FROM every GROUP BY ALL)"""


@query(f"WITH {_KEYED} SELECT doc_id, unit_no, job_id, ord, keyword, arg_min(term, term_no) AS evidence FROM (SELECT * FROM named UNION ALL SELECT * EXCLUDE (prio) FROM called) GROUP BY doc_id, unit_no, job_id, ord, keyword")
def kw_evidence(spark, d):
    """Keywords that a unit supports by another name or by what it implies."""
    return ev.named(_units(spark, d), _keywords(spark, d), _implications(spark, d)).drop("via")


@query(f"WITH {_KEYED} SELECT doc_id, unit_no, job_id, ord, keyword, evidence FROM worded")
def kw_reworded(spark, d):
    return ev.reworded(_units(spark, d), ["doc_id", "unit_no"], _keywords(spark, d), True)


@query(f"WITH {_KEYED} SELECT * FROM best")
def kw_support(spark, d):
    return ev.support(_units(spark, d), _keywords(spark, d), _implications(spark, d), within=True)


@query(f"""WITH RECURSIVE {_KEYED}, one AS (SELECT doc_id, min(unit_no) AS unit_no FROM u GROUP BY doc_id, text),
said AS (SELECT DISTINCT u.doc_id, k.ord FROM u JOIN k ON k.job_id = u.job_id WHERE contains(' ' || lower(text) || ' ', ' ' || lower(keyword) || ' ')),
rows AS (SELECT b.doc_id, b.unit_no, b.keyword, b.via, b.evidence, lower(b.keyword) AS name, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.unit_no, said.ord IS NOT NULL, b.ord) AS i
  FROM best b JOIN one USING (doc_id, unit_no) JOIN u USING (doc_id, unit_no) LEFT JOIN said ON said.doc_id = b.doc_id AND said.ord = b.ord WHERE NOT contains(' ' || lower(text) || ' ', ' ' || lower(b.keyword) || ' ')),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS unit_no, 0 AS n, CAST([] AS VARCHAR[]) AS given, false AS taken FROM rows GROUP BY doc_id
  UNION ALL SELECT doc_id, i, unit_no, had + CAST(take AS INTEGER), CASE WHEN take THEN list_append(given, name) ELSE given END, take FROM (
    SELECT r.doc_id, r.i, r.unit_no, r.name, f.given, CASE WHEN f.unit_no = r.unit_no THEN f.n ELSE 0 END AS had,
      (f.unit_no <> r.unit_no OR f.n < 2) AND len(list_filter(f.given, lambda g: g = r.name)) < 2 AS take FROM f JOIN rows r ON r.doc_id = f.doc_id AND r.i = f.i + 1))
SELECT doc_id, unit_no, keyword, via, evidence FROM f JOIN rows USING (doc_id, i, unit_no) WHERE taken""")
def kw_offers(spark, d):
    """What units may work in, under two caps; the tests hold it against a greedy loop too."""
    return ev.offers(_units(spark, d), _keywords(spark, d), _implications(spark, d))


@query(f"""WITH {fx.PAIRS}, k AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(rewritten), '[a-z]{{5,}}')) AS keyword FROM pairs)),
w AS (SELECT doc_id, unit_no, unnest(list_distinct(regexp_extract_all(lower(rewritten), '[a-z0-9]+'))) AS keyword, regexp_extract_all(lower(original), '[a-z0-9]+') AS had FROM pairs),
f AS (SELECT doc_id, unit_no, ord, keyword, keyword = 'people' AND list_contains(had, 'users') AS supported FROM w JOIN k USING (keyword) WHERE NOT list_contains(had, keyword))
SELECT doc_id, unit_no, 0 AS job_id, CAST(ord AS INTEGER) AS ord, keyword, supported, CASE WHEN supported THEN 'implied' END AS via, CASE WHEN supported THEN 'users' END AS evidence FROM f""")
def kw_check(spark, d):
    """Keywords that a rewrite adds, out of all longer words of the rewrites, and whether its original supports them."""
    pairs = stored(fx.pairs(spark, d).withColumn("job_id", F.lit(0)))
    words = pairs.select(F.explode(F.regexp_extract_all(F.lower("rewritten"), F.lit("[a-z]{5,}"), 0)).alias("keyword")).distinct()
    keywords = words.select(F.lit(0).alias("job_id"), F.row_number().over(fx.Window.partitionBy(F.lit(0)).orderBy("keyword")).alias("ord"), "keyword")
    return ev.check(pairs, keywords, spark.createDataFrame([("people", "users", 0)], "keyword string, term string, term_no int"))


def _vocabulary(spark, d):
    """Terms of the benchmark: its longer words, and the first two words of each item."""
    two = fx.table(spark, d, "benchmark").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("term"))
    terms = fx.job_keywords(spark, d).select(F.col("keyword").alias("term")).union(two).filter("term <> ''").distinct()
    return terms.withColumn("ord", F.row_number().over(fx.Window.partitionBy(F.lit(0)).orderBy("term")))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""WITH {fx.JOB_KEYWORDS}, v AS (SELECT term, {_LOW.format('term')} AS low, row_number() OVER (ORDER BY term) AS ord FROM (SELECT keyword AS term FROM job_keywords UNION SELECT regexp_extract(text, '^[^ 	

]+ [^ 	

]+') FROM benchmark) WHERE term <> ''),
t AS (SELECT doc_id, '|' || {_LOW.format('text')} || '|' AS low FROM documents),
h AS (SELECT doc_id, list(term ORDER BY ord) AS keywords FROM t JOIN v ON contains(t.low, v.low) WHERE regexp_matches(t.low, '[^a-z0-9]' || regexp_escape(v.low) || '[^a-z0-9+#]') GROUP BY doc_id)
SELECT doc_id, coalesce(keywords, []) AS keywords,
coalesce(regexp_extract(text, '(?:^|[^\pL\pN_])(?:at|join|About)[ 	

]+([A-Z][\pL\pN_&.''-]*(?:[ 	

]+[A-Z][\pL\pN_&.''-]*){{0,3}})', 1), '') AS company FROM documents LEFT JOIN h USING (doc_id) WHERE text IS NOT NULL""")
def kw_vocab(spark, d):
    """The terms of a vocabulary, and the company, of every document."""
    return ev.spot_vocabulary(fx.table(spark, d, "documents").filter("text is not null"), _vocabulary(spark, d))
