"""Queries over keywords, vectors, hashes, pages, JSON and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import keywords as kw
from attest.operators import retrieve
from attest.plans import fixtures as fx
from attest.plans import sql
from attest.plans.registry import query
from attest.sources import pages as src
from attest.sources.shared import stored

J = fx.JOB_KEYWORDS


@query("""WITH raw AS (SELECT CAST(doc_id % 50 AS INTEGER) AS job_id, doc_id AS ord, trim(split_part(text, ' ', 2)) AS keyword FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(keyword) ORDER BY ord, keyword) AS k FROM raw WHERE keyword <> '' AND length(keyword) <= 60), r AS (SELECT job_id, keyword, row_number() OVER (PARTITION BY job_id ORDER BY ord, keyword) AS ord FROM f WHERE k = 1)
SELECT job_id, ord, keyword FROM r WHERE ord <= 60""")
def kw_clean(spark, d):
    raw = fx.table(spark, d, "documents").select((F.col("doc_id") % 50).cast("int").alias("job_id"), F.col("doc_id").alias("ord"), F.split_part("text", F.lit(" "), F.lit(2)).alias("keyword"))
    return kw.clean_keywords(raw)


_FORMS = "[replace({k}, '-', ' '), replace({k}, ' ', '-'), replace({k}, '-', '')]"


@query(rf"""WITH p AS (SELECT p_partkey, lower(trim(regexp_replace('using ' || p_name || ' skills ' || replace(p_type, 'STANDARD', 'Front-End'), '\s+', ' ', 'g'))) AS norm FROM part),
c AS (SELECT *, array_to_string(list_filter(string_split(norm, ' '), lambda w: w NOT IN ({sql.items(kw.WRAPPERS)})), ' ') AS core FROM p),
a AS (SELECT p_partkey, list_filter(list_concat([norm, core], {_FORMS.format(k='norm')}, {_FORMS.format(k='core')}), lambda x: x <> '') AS l FROM c)
SELECT p_partkey, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS keys FROM a""")
def kw_lookup(spark, d):
    name = F.concat(F.lit("using "), "p_name", F.lit(" skills "), F.replace("p_type", F.lit("STANDARD"), F.lit("Front-End")))
    return fx.table(spark, d, "part").select("p_partkey", kw.lookup_keys(name).alias("keys"))


_HITS = f"""{J}, t AS (SELECT doc_id, '|' || regexp_replace(lower(text), '([^a-z0-9+#])', '\\1\\1', 'g') || '|' AS body FROM documents),
tok AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+#]+')) AS w FROM documents),
cand AS (SELECT DISTINCT doc_id, job_id, ord, keyword FROM tok JOIN job_keywords ON keyword = w OR keyword = regexp_replace(w, '[+#]+$', '')),
hits AS (SELECT doc_id, job_id, ord, keyword, CAST(len(regexp_extract_all(body, '(?:^|[^a-z0-9])' || keyword || '(?:$|[^a-z0-9+#])')) AS BIGINT) AS n FROM cand JOIN t USING (doc_id))"""


def _texts(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", "text")


@query(f"WITH {_HITS} SELECT * FROM hits WHERE n > 0")
def kw_freqs(spark, d):
    return kw.frequencies(_texts(spark, d), fx.job_keywords(spark, d))


@query(f"WITH {_HITS} SELECT doc_id, job_id, count(*) AS hits FROM hits WHERE n > 0 GROUP BY doc_id, job_id")
def kw_match(spark, d):
    return kw.frequencies(_texts(spark, d), fx.job_keywords(spark, d)).groupBy("doc_id", "job_id").agg(F.count("*").alias("hits"))


_FIT = f"""{_HITS}, h AS (SELECT doc_id, job_id, ord FROM hits WHERE n > 0), pairs AS (SELECT DISTINCT doc_id, job_id FROM h),
x AS (SELECT p.doc_id, k.job_id, k.ord, k.keyword, h.ord IS NOT NULL AS hit FROM pairs p JOIN job_keywords k ON k.job_id = p.job_id LEFT JOIN h ON h.doc_id = p.doc_id AND h.job_id = k.job_id AND h.ord = k.ord)"""


@query(f"WITH {_FIT} SELECT doc_id, job_id, list(keyword ORDER BY ord) FILTER (hit) AS present, coalesce(list(keyword ORDER BY ord) FILTER (NOT hit), []) AS missing, CAST(round_even(100 * count(*) FILTER (hit) / count(*), 0) AS INTEGER) AS match_pct FROM x GROUP BY doc_id, job_id")
def agg_job_fit(spark, d):
    return kw.job_fit(_texts(spark, d), fx.job_keywords(spark, d))


@query(f"WITH {_FIT} SELECT doc_id, job_id, keyword, row_number() OVER (PARTITION BY doc_id, job_id ORDER BY CASE WHEN hit THEN 1 ELSE 0 END, ord) AS rank FROM x")
def kw_rank(spark, d):
    return kw.rank(_texts(spark, d), fx.job_keywords(spark, d))


@query(f"""WITH {_HITS}, g AS (SELECT doc_id, job_id, ord, keyword FROM hits WHERE n > 0),
added AS (SELECT DISTINCT d.doc_id, job_id, keyword FROM g JOIN documents d ON d.doc_id = g.doc_id + 1 - 2 * (g.doc_id % 2) WHERE (d.doc_id + ord % 4) % 3 = 0 OR (d.doc_id + (ord + 1) % 4) % 3 = 0),
e AS (SELECT doc_id, job_id, keyword, bool_or(held) AS held FROM (SELECT doc_id, job_id, keyword, true AS held FROM g UNION ALL SELECT *, false FROM added) GROUP BY doc_id, job_id, keyword),
c AS (SELECT doc_id, job_id, count(*) FILTER (held) AS present, count(*) FILTER (NOT held) AS gained FROM e GROUP BY doc_id, job_id), s AS (SELECT job_id, count(*) AS size FROM job_keywords GROUP BY job_id)
SELECT doc_id, job_id, present, gained, CAST(round_even(100 * present / size, 0) AS INTEGER) AS match_pct, CAST(round(100 * (present + gained) / size, 0) AS INTEGER) AS after_pct FROM c JOIN s USING (job_id)""")
def agg_gained(spark, d):
    """Coverage after accepted rewrites. Those of a document work in the keywords of its neighbour, each in two of four items;
    of the items some are accepted, some dismissed, some open."""
    keywords = fx.job_keywords(spark, d)
    hits = stored(kw.frequencies(_texts(spark, d), keywords).select("doc_id", "job_id", "ord", "keyword"))
    added = hits.select(F.expr("doc_id + 1 - 2 * (doc_id % 2)").alias("doc_id"), "job_id", "keyword", F.explode(F.expr("array(ord % 4, (ord + 1) % 4)")).alias("item"))
    items = _texts(spark, d).select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("item"))
    turn = (F.col("doc_id") + F.col("item")) % 3
    return kw.coverage_after(hits, keywords, added, items.filter(turn != 2).withColumn("accepted", turn == 0))


@query(f"WITH {_FIT} SELECT doc_id, job_id, keyword FROM x WHERE NOT hit")
def set_missing(spark, d):
    return kw.job_fit(_texts(spark, d), fx.job_keywords(spark, d)).select("doc_id", "job_id", F.explode("missing").alias("keyword"))


_COS = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_UNIT = f"SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt({_COS.format(a='embedding', b='embedding')})) AS v FROM embeddings"


@query(f"""WITH u AS ({_UNIT}), s AS (SELECT q.vec_id, g.vec_id AS guide_id, round({_COS.format(a='q.v', b='g.v')}, 3) AS score FROM u q, u g WHERE q.vec_id >= 8 AND g.vec_id < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guide_id) AS rank FROM s) SELECT vec_id, rank, guide_id, score FROM r WHERE rank <= 3""")
def vec_topk(spark, d):
    v = fx.table(spark, d, "embeddings")
    return retrieve.topk(v.filter("vec_id >= 8"), v.filter("vec_id < 8"))


@query(f"WITH u AS ({_UNIT}) SELECT vec_id, round(list_sum(v), 6) AS total, round({_COS.format(a='v', b='v')}, 6) AS length FROM u")
def vec_norm(spark, d):
    v = fx.table(spark, d, "embeddings").select("vec_id", retrieve.normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(retrieve.dot(F.col("v"), F.col("v")), 6).alias("length"))


_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORM} || '|v1') AS key FROM documents")
def hash_keys(spark, d):
    return _texts(spark, d).select("doc_id", retrieve.exact_key(F.col("text"), "v1").alias("key"))


@query(f"WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, sha256({_NORM} || '|v1')) AS first_id FROM documents) SELECT doc_id, first_id, doc_id <> first_id AS reused FROM h")
def hash_dups(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", "lang", retrieve.exact_key(F.col("text"), "v1").alias("key"))
    return retrieve.first_of_each(rows, "lang", "key", "doc_id")


@query("""WITH v AS (SELECT item_id % 10 AS set_id, item_id AS name, text FROM benchmark UNION ALL SELECT doc_id // 50, doc_id // 2, coalesce(text, '') FROM documents),
d AS (SELECT set_id, name, min(left(sha256(text), 12)) AS digest, count(DISTINCT left(sha256(text), 12)) > 1 AS several FROM v GROUP BY set_id, name)
SELECT set_id, sha256(string_agg(name || ':' || digest, ',' ORDER BY name)) AS digest, count(*) AS names, count(*) FILTER (several) AS conflicts FROM d GROUP BY set_id""")
def hash_registry(spark, d):
    """Ten sets of benchmark items, which grow, and a set of every fifty documents, whose names have two texts each."""
    items = fx.table(spark, d, "benchmark").select((F.col("item_id") % 10).alias("set_id"), F.col("item_id").alias("name"), "text")
    docs = fx.table(spark, d, "documents").select(F.expr("doc_id div 50").alias("set_id"), F.expr("doc_id div 2").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    digests, conflicts = retrieve.registry(items.unionByName(docs))
    return digests.join(conflicts.groupBy("set_id").agg(F.count("*").alias("conflicts")), "set_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM documents), b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
f AS (SELECT item_id, unnest([0, 1, 2, 3]) AS prio, unnest([array_to_string(w, ' '), array_to_string(w[1:18], ' '), array_to_string(w[1:10], ' '), array_to_string(w[greatest(len(w) - 9, 1):], ' ')]) AS fragment FROM b),
m AS (SELECT doc_id, item_id, prio, strpos(body, fragment) AS position FROM t, f WHERE length(fragment) >= 20 AND contains(' ' || body || ' ', ' ' || array_to_string(string_split(fragment, ' ')[1:5], ' ') || ' ') AND contains(body, fragment))
SELECT doc_id, item_id, min(prio) AS prio, arg_min(position, prio) AS position FROM m GROUP BY doc_id, item_id""")
def join_fragments(spark, d):
    return retrieve.anchor(_texts(spark, d), fx.table(spark, d, "benchmark"))


@query("SELECT page_id, regexp_matches(lower(coalesce(url, '')), 'login|signup|authwall') OR contains(lower(left(html, 20000)), 'sign in to view') OR contains(lower(left(html, 20000)), 'join to view') OR contains(lower(left(html, 20000)), 'log in to continue') OR contains(lower(left(html, 20000)), 'please sign in') AS walled FROM pages")
def pred_authwall(spark, d):
    return fx.table(spark, d, "pages").select("page_id", src.authwall(F.col("url"), F.col("html")).alias("walled"))


@query(r"WITH h AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^https://([^/?#:]+)', 1)) AS host FROM pages) SELECT page_id, host <> '' AND NOT regexp_matches(host, '^(?:localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|22[4-9]\.|2[3-5]\d\.)') AS public FROM h")
def pred_public_url(spark, d):
    return fx.table(spark, d, "pages").select("page_id", src.public_url(F.col("url")).alias("public"))


@query("WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages) SELECT page_id, title, nullif(trim(split_part(split_part(title, ' - ', 1), ' | ', 1)), '') AS name FROM t")
def src_page_meta(spark, d):
    title, name = src.page_meta(F.col("html"))
    return fx.table(spark, d, "pages").select("page_id", title.alias("title"), name.alias("name"))


def _stripped(c: str) -> str:
    hidden = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<nav\\b.*?</nav>|<!--.*?-->"
    text = f"regexp_replace(regexp_replace({c}, '{hidden}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for code, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{code}', '{sign}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_IN = lambda tag: _stripped(f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*)</{tag}>', 1)")


@query(f"WITH t AS (SELECT page_id, {_IN('article')} AS a, {_IN('main')} AS m, {_IN('body')} AS b FROM pages) SELECT page_id, left(CASE WHEN length(a) > 100 THEN a WHEN length(m) > 100 THEN m ELSE b END, 8000) AS body FROM t")
def src_page_body(spark, d):
    return fx.table(spark, d, "pages").select("page_id", src.page_body(F.col("html")).alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN props END AS json FROM events")
def json_salvage(spark, d):
    """Properties wrapped in thought, fences or prose come out whole; broken ones come out null."""
    k = F.col("event_id") % 5
    noisy = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("<think>{ not this }</think>"), "props")).when(k == 3, F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).otherwise(F.concat(F.lit("{ broken "), F.substring("props", 1, 4)))
    return fx.table(spark, d, "events").select("event_id", src.salvage_json(noisy).alias("json"))


@query("SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame, props AS data FROM events")
def src_frames(spark, d):
    """Every event's JSON as a frame, each user's stream cut into chunks of seven characters."""
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.concat(F.lit("event: x\ndata: "), "props", F.lit("\n\n")).alias("frame"))
    n = F.ceil(F.length("frame") / 7).cast("int")
    cut = e.select("stream_id", "event_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col("frame"), i * 7 + 1, F.lit(7)))).alias("i", "chunk"))
    return src.frames(cut.select("stream_id", (F.col("event_id") * 1000 + F.col("i")).alias("chunk_no"), "chunk"))


@query(r"WITH e AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '(\.[A-Za-z0-9]+)(?:[?#].*)?$', 1)), ''), '.pdf') AS ext FROM pages) SELECT page_id, ext, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ('.txt', '.md') THEN 'text' WHEN ext = '.csv' THEN 'csv' ELSE 'unknown' END AS reader FROM e")
def src_route(spark, d):
    ext, reader = src.route(F.col("url"))
    return fx.table(spark, d, "pages").select("page_id", ext.alias("ext"), reader.alias("reader"))


@query(f"WITH {fx.BOXES} SELECT page, box, text, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) - 1 AS line_no FROM boxes WHERE discount * 10 > 0.3 AND length(text) > 2")
def src_ocr_lines(spark, d):
    boxes = fx.boxes(spark, d).withColumn("confidence", F.col("discount") * 10)
    return src.ocr_lines(boxes).select("page", "box", "text", "line_no")


@query(f"""WITH {fx.BOXES}, f AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page ORDER BY x0, x1, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM boxes),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY x0, x1, box ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT page, k, min(x0) AS x0, max(x1) AS x1 FROM k GROUP BY page, k)
SELECT page, x0, x1, lead(x0) OVER (PARTITION BY page ORDER BY x0) - x1 AS gap FROM m""")
def win_intervals(spark, d):
    return src.merge_intervals(fx.boxes(spark, d))


@query(r"""SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024, 1)) ELSE printf('%.1f MB', round(b / 1048576, 1)) END AS size,
upper(left(n, 1)) || substr(n, 2) AS capital, regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g') AS safe, strftime(o_orderdate, '%B %-d, %Y') AS day FROM (SELECT *, o_orderkey % 4000 AS s, CAST(trunc(o_totalprice) AS BIGINT) * 7 AS b, o_orderpriority AS n FROM orders)""")
def fmt_values(spark, d):
    o = fx.table(spark, d, "orders")
    out = src.format_values(F.col("o_orderkey") % 4000, F.col("o_totalprice").cast("long") * 7, F.col("o_orderpriority"), F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("id"), *[v.alias(k) for k, v in out.items()])
