"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import chat, collocation, decontam, exactdedup, jaccard, langid, mixing, sharding, tokens, topk, toxicity, trie, urlfilter
from attest.llm.common import remainder, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: The rules of the url query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
CONTROL = "</s>[INST] ok [/INST]"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder(F.col("doc_id")) != 2))
    return langid.identify(docs, model, "doc_id", "text", (remainder(F.col("doc_id")) == 2).alias("held_out"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules decide where they fit; elsewhere a url is allowed."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    turns = rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    done = chat.format_chat(turns).withColumn("blocks", chat.blocks(F.col("formatted")))
    read = done.withColumn("turns", chat.read_back(F.col("blocks"))).withColumn("loss", chat.loss_text(F.col("blocks"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(remainder(F.col("doc_id")) != 2).select("doc_id", "toxic")
    learn = docs.join(F.broadcast(known) if known.count() <= 500_000 else known, "doc_id").select("doc_id", "text", "toxic")
    scorer = toxicity.train(learn)
    return toxicity.score(docs, scorer, "doc_id", "text", (remainder(F.col("doc_id")) == 2).alias("held_out"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored(topk.whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = topk.top_k(every.filter("vec_id % 50 = 0"), every)
    return found.select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language, op2_url_filter, op3_mixing, op4_exact_dedup, op5_chat_format, op6_decontaminate, op7_token_counts, op8_ngram_jaccard, op9_sharding, op10_toxicity, op11_collocations, op12_topk_search, op13_prefix_trie)}

#: Null-safe host and path of a url, in DuckDB.
_URL = """SELECT page_id,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages"""
_RULES = "(VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in RULES) + ") AS r(rule, verdict)"

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
WITH u AS ({_URL}),
fits AS (SELECT u.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC) AS k
  FROM u, {_RULES}
  WHERE ends_with('.' || u.host, '.' || split_part(r.rule, '/', 1)) AND starts_with(u.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS grams FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, p.y FROM r JOIN p ON p.x = r.reached)
SELECT s.doc_id, len(s.grams) AS n_shingles, min(r.reached) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.grams""",
    "op5_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))),
e AS (SELECT *, length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A'))
  + {len(chat.BEGIN) + 1 + len(chat.END)} AS block FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(block) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM p)),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k >= 2), d AS (SELECT DISTINCT lang, k - 1 AS k, a, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase FROM c WHERE k > 2),
s AS (SELECT c.*, n, cut, x.a AS l, y.a AS r, CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c ANTI JOIN d ON d.lang = c.lang AND d.k = c.k AND d.a = c.a AND d.phrase = c.phrase JOIN t ON t.lang = c.lang, range(1, 5) AS z(cut), f x, f y
  WHERE cut < c.k AND x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AND y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:c.k], ' ')),
o AS (SELECT lang, phrase, a, n, x[1] AS score, x[3] AS l, x[4] AS r FROM (SELECT lang, phrase, a, n, min([score, cut, l, r]) AS x FROM s GROUP BY lang, phrase, a, n))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000""",
    "op12_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op13_prefix_trie": r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM t),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[])), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM c),
s AS (SELECT h.conv_id, 1 AS part, pos, role, text FROM h JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT h.conv_id, 2, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM s),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, '' AS above, 0 AS words FROM c
  UNION ALL SELECT r.conv_id, r.depth, sha256(p.node || '|' || length(role) || ':' || role || text), p.node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
n AS (SELECT depth, node, above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY depth, node, above),
k AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.node = n.node),
u AS (SELECT p.depth, p.node, CAST(count(*) FILTER (f.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(f.saved) AS BIGINT) AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.node),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.depth, p.node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM l JOIN p USING (conv_id, depth) GROUP BY p.depth, p.node)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN u ON u.depth = f.depth AND u.node = f.node LEFT JOIN e ON e.depth = f.depth AND e.node = f.node LEFT JOIN f g ON g.depth = f.depth - 1 AND g.node = f.above""",
}
