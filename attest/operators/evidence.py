"""Keyword evidence: how a text supports a keyword that it doesn't state, what to offer, what a rewrite added.

Keywords (job_id, ord, keyword); units (doc_id, job_id, unit_no, section, text), each reviewed against one job.
Implications (keyword, term) are a parameter: a curated table of what a named thing entails. Texts meet terms in an
automaton that reads each text once, and keywords in other words on the forms of their rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.functions.text import let
from attest.operators import within as within_
from attest.operators.keywords import lookup_keys
from attest.operators.terms import best_terms, find_terms
from attest.sources.shared import stored

#: Bytes of texts, and of lists of evidence, that go to every task.
SENT = 64 << 20
TOKEN = r"([a-z0-9+#][a-z0-9+#/.]*)"


def aliases(spark) -> DataFrame:
    """(key, term, term_no) of the names for the same thing, and of those that hold one way only."""
    rows = [(form.lower(), other, i) for group in lx.SAME_NAMES for form in group for i, other in enumerate(o for o in group if o != form)]
    rows = [r for r in rows if r[0] not in lx.ONE_WAY_NAMES] + [(k, t, i) for k, terms in lx.ONE_WAY_NAMES.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "key string, term string, term_no int")


def _exact(term: Column) -> Column:
    return (term != F.lower(term)) | term.isin(lx.EXACT_CASE)


def find(term: Column, text: Column) -> Column:
    """The term as the text writes it, or null: whole tokens; terms with capitals and a few others as they are."""
    return F.regexp_substr(text, F.concat(F.when(_exact(term), "").otherwise("(?i)"), F.lit(r"(?<![A-Za-z0-9])\Q"), term, F.lit(r"\E(?![A-Za-z0-9+#])")))


def states(keyword: Column, text: Column) -> Column:
    """Whether the text states the keyword, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), keyword, F.lit(r"\E(?![a-z0-9+#])")))


def acronym_form(keyword: Column) -> Column:
    """The plural of an acronym, or the singular of such a plural; null for other words."""
    word = F.trim(keyword)
    return F.when(word.rlike("^[A-Z]{3,6}s?$"), F.when(word.endswith("s"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(F.concat(word, F.lit("s"))))


def stems(word: Column) -> Column:
    """Every plausible stem of a word; loose, as all words of a keyword must meet one."""

    def bases(w: Column) -> Column:
        cut = [F.when(w.endswith(s) & (F.length(w) - len(s) >= least) & (~w.endswith("ss") if s == "s" else F.lit(True)), F.concat(F.substr(w, F.lit(1), F.length(w) - len(s)), F.lit("y" if s in ("ies", "ied") else ""))) for s, least in lx.SUFFIXES]
        return F.filter(F.array(w, *cut), lambda b: b.isNotNull())

    def forms(b: Column) -> Column:
        other = F.when(b.endswith("e"), F.substr(b, F.lit(1), F.length(b) - 1)).otherwise(F.concat(b, F.lit("e")))
        single = F.when(b.rlike(r"^.{2,}([^aeious])\1$"), F.substr(b, F.lit(1), F.length(b) - 1))
        return F.filter(F.array(b, other, single), lambda x: x.isNotNull())

    plain = F.replace(F.replace(F.regexp_replace(word, "^[./]+|[./]+$", ""), F.lit("yz"), F.lit("ys")), F.lit("iz"), F.lit("is"))
    plain = F.regexp_replace(plain, "ysis$", "ys")
    return F.array_distinct(F.flatten(F.transform(let(plain, bases), forms)))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")), F.lit("-"), F.lit(" ")), F.lit(TOKEN), 1)


def terms_of(keywords: DataFrame, implications: DataFrame, near) -> DataFrame:
    """(job_id, ord, keyword, via, prio, key_no, term_no, term): what counts as evidence, in order of preference."""
    keyed = keywords.select("job_id", "ord", "keyword", F.posexplode(lookup_keys(F.col("keyword"))).alias("key_no", "key"))
    numbered = implications.select(F.lower("keyword").alias("key"), "term", F.col("term_no").cast("int").alias("term_no"))
    found = keyed.join(near(aliases(keywords.sparkSession)), "key").withColumn("via", F.lit("alias")).withColumn("prio", F.lit(1))
    implied = keyed.join(near(numbered), "key").withColumn("via", F.lit("implied")).withColumn("prio", F.lit(2))
    plural = keywords.withColumn("term", acronym_form(F.col("keyword"))).filter("term is not null")
    plural = plural.select("job_id", "ord", "keyword", F.lit("alias").alias("via"), F.lit(0).alias("prio"), F.lit(0).alias("key_no"), F.lit(0).alias("term_no"), "term")
    return plural.unionByName(found.select(plural.columns)).unionByName(implied.select(plural.columns))


def _named(texts: DataFrame, id_cols: list[str], terms: DataFrame, near) -> DataFrame:
    """texts(*id_cols, job_id, text) that hold a term of their job: all columns of the terms and the evidence."""
    held = find_terms(texts, [*id_cols, "job_id"], terms.select("term", _exact(F.col("term")).alias("exact")))
    return held.join(near(terms), ["job_id", "term"])


def reworded(texts: DataFrame, id_cols: list[str], keywords: DataFrame, strict: bool, few: int = 100_000) -> DataFrame:
    """(*id_cols, job_id, ord, keyword, evidence): every content word of the keyword shares a stem with a word of
    the text; the text's own words, in its order. Strict: lower-case keywords only.

    Stems are taken once of each distinct word. A keyword meets texts on the forms of its rarest word alone; its other
    words are tested against the text's."""
    words = F.filter(_tokens(F.col("keyword")), lambda w: ~w.isin(lx.STOPWORDS))
    wanted = keywords.withColumn("words", words).filter(F.size("words") > 0)
    wanted = wanted.filter((F.size("words") > 1) | ~(F.get("words", F.lit(0)).isin(lx.WORDLIKE_NAMES) | (F.length(F.get("words", F.lit(0))) < 5)))
    if strict:
        wanted = wanted.filter(F.col("keyword") == F.lower("keyword"))
    wanted = wanted.select("job_id", "ord", "keyword", F.array_distinct("words").alias("words"))
    own = stored(texts.select(*id_cols, "job_id", F.array_distinct(_tokens(F.col("text"))).alias("tokens")))
    counted = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    forms = counted.withColumn("stem", F.explode(stems(F.col("token"))))
    asked = wanted.select(F.explode("words").alias("word")).distinct().withColumn("stem", F.explode(stems(F.col("word"))))
    alike = asked.join(forms, "stem").select("word", "token", "n").distinct().groupBy("word").agg(F.collect_list("token").alias("forms"), F.sum("n").alias("n"))
    known = wanted.select("job_id", "ord", "keyword", F.size("words").alias("size"), F.explode("words").alias("word")).join(alike, "word")
    each = known.groupBy("job_id", "ord", "keyword", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word", "forms"))).alias("each")).filter(F.size("each") == F.col("size"))
    rules = stored(each.select("job_id", "ord", "keyword", F.get("each", F.lit(0))["forms"].alias("rarest"), F.transform("each", lambda x: x["forms"]).alias("all")))
    met_on = rules.withColumn("token", F.explode("rarest"))
    if met_on.count() <= few:
        met = own.withColumn("token", F.explode("tokens")).join(F.broadcast(met_on), ["job_id", "token"])
    else:
        keys = own.select(*id_cols, "job_id", F.explode("tokens").alias("token")).join(met_on.select("job_id", "token", "ord", "keyword"), ["job_id", "token"])
        met = keys.join(own, [*id_cols, "job_id"]).join(rules, ["job_id", "ord", "keyword"])
    first = lambda forms: F.get(F.filter("tokens", lambda t: F.array_contains(forms, t)), F.lit(0))
    whole = met.filter(F.forall("all", lambda forms: F.arrays_overlap(forms, F.col("tokens")))).filter(F.col("token") == first(F.col("rarest")))
    used = let(F.transform("all", first), lambda u: F.array_join(F.filter("tokens", lambda t: F.array_contains(u, t)), " "))
    return whole.select(*id_cols, "job_id", "ord", "keyword", used.alias("evidence"))


def _near(few: int):
    return lambda df: F.broadcast(df) if df.count() <= few else df


def support(units: DataFrame, keywords: DataFrame, implications: DataFrame, contexts: DataFrame | None = None, strict: bool = True, few: int = 100_000, within: bool = False) -> DataFrame:
    """(doc_id, unit_no, job_id, ord, keyword, via, evidence) of the keywords that a unit supports, by the best of:
    an acronym's other number, another name, what a named thing implies, the same in other words, and, for units of
    the section SUMMARY, the rest of the document: contexts(doc_id, job_id, text), or ``within``, all units as its lines."""
    keywords, terms = stored(keywords.select("job_id", "ord", "keyword")), stored(terms_of(keywords, implications, _near(few)))
    units = units.select("doc_id", "unit_no", "job_id", "section", "text")
    if terms.count() + keywords.count() > min(few, within_.LISTED):
        units = stored(units)
        return _support_of_many(units, keywords, terms, whole_texts(units) if within else contexts, strict, few)
    out = ["doc_id", "unit_no", "job_id", "ord", "keyword", "via", "evidence"]
    if contexts is None and not within:
        met, pieces = _settled(units, keywords, terms, False, strict, few)
        return met.select("doc_id", "unit_no", "list").join(pieces.filter("code < 0"), "list").select("doc_id", "unit_no", F.inline("hits")).select(*out)
    met, pieces = _settled(_lines(units, None if within else contexts), keywords, terms, True, strict, few)
    return within_.supported(met).join(pieces, ["list", "code"]).select("doc_id", "unit_no", F.inline("hits")).select(*out)


def whole_texts(units: DataFrame) -> DataFrame:
    """(doc_id, job_id, text): the whole text of each document, its units as lines."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda x: x["text"]), "\n")
    return units.groupBy("doc_id", "job_id").agg(texts.alias("text"))


def _best(found: DataFrame) -> DataFrame:
    """The most preferred evidence of each keyword and unit; a job's ``ord`` stands for its keyword."""
    best = F.min_by(F.struct("keyword", "via", "evidence"), F.struct("prio", "key_no", "term_no"))
    out = found.groupBy("doc_id", "unit_no", "job_id", "ord").agg(best.alias("x"))
    return out.select("doc_id", "unit_no", "job_id", "ord", "x.keyword", "x.via", "x.evidence")


def _ruled(terms: DataFrame, fixed: Column | None = None) -> DataFrame:
    return terms.withColumn("exact", _exact(F.col("term"))).withColumn("fixed", F.lit(None).cast("string") if fixed is None else fixed)


def _stated(keywords: DataFrame) -> DataFrame:
    """The keywords themselves as terms, in any case."""
    return keywords.select("job_id", "ord", "keyword", F.lit("resume").alias("via"), F.lit(4).alias("prio"), F.lit(0).alias("key_no"), F.lit(0).alias("term_no"), F.lower("keyword").alias("term"))


def _around(terms: DataFrame) -> DataFrame:
    """Terms as the rest of a document may hold them."""
    return terms.filter("prio > 0").withColumn("via", F.lit("resume")).withColumn("term_no", F.col("prio") * 1000 + F.col("term_no")).withColumn("prio", F.lit(5))


def _name(keyword: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(keyword), r"\s+", " "))


def _judged(texts: DataFrame, keywords: DataFrame, terms: DataFrame, lends: bool, strict: bool, few: int, silent: bool) -> DataFrame:
    """texts(job_id, text) with ``own``, what a text supports itself, ``near``, what it lends to the summary of its document,
    and ``mute``, the keywords that it states, if they are to be left out. Other words are only asked for keywords that a
    name didn't settle.

    Each hit has a code (see ``within``): the place of its keyword in the order of offers, a number of the keyword's name, and
    its place in the order of preference; 0 stands for that of own hits."""
    at, hit = ["job_id", "text"], ["job_id", "ord", "keyword", "via", "evidence"]
    one = keywords.groupBy("job_id", "ord").agg(F.min("keyword").alias("keyword")).withColumn("name", _name(F.col("keyword")))
    order = Window.partitionBy(F.lit(0))  # a list of keywords that goes to every task
    numbers = stored(one.select("job_id", "ord", "keyword", (F.row_number().over(order.orderBy("ord", "name", "keyword", "job_id")) - 1).cast("long").alias("kw"), (F.dense_rank().over(order.orderBy("name")) - 1).cast("long").alias("nm")))
    coded = lambda df, rank: df.join(F.broadcast(numbers.drop("keyword")), ["job_id", "ord"]).withColumn("code", F.shiftleft("kw", 42) + F.shiftleft("nm", 22) + rank)
    listed = lambda df, c: df.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("code", *hit))).alias(c))
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    held = stored(best_terms(texts, _ruled(terms)))
    worded = reworded(held.withColumn("known", F.transform("hits", lambda h: h["ord"])), ["text", "known"], keywords, strict, few)
    worded = worded.filter(~F.array_contains("known", F.col("ord"))).withColumn("via", F.lit("reworded"))
    found = held.select(*at, F.inline("hits")).unionByName(worded.drop("known"))
    if silent:
        found = found.filter(~states(F.col("keyword"), F.col("text")))
    own = listed(coded(found, F.lit(0)), "own")
    out = texts.join(own, at, "left").select(*at, none(own, "own"))
    if lends:
        rules = _ruled(_stated(keywords), F.col("keyword")).unionByName(_ruled(_around(terms)))
        around = best_terms(texts, rules, ranked=True).select(*at, F.inline("hits"))
        near = listed(coded(around, 2 * F.col("rank") + F.when(F.col("prio") == 4, 2).otherwise(3)), "near")
        out = out.join(near, at, "left").select(*out.columns, none(near, "near"))
    if silent:
        said = find_terms(texts.select(F.col("text").alias("by"), "text").distinct(), ["by"], keywords.select(F.col("keyword").alias("term"), F.lit(False).alias("exact")), few)
        mute = said.join(F.broadcast(numbers.select(F.col("keyword").alias("term"), "kw")), "term").groupBy(F.col("by").alias("text")).agg(F.sort_array(F.collect_set("kw")).alias("mute"))
        out = out.join(mute, "text", "left").select(*out.columns, none(mute, "mute"))
    return out


def _settled(rows: DataFrame, keywords: DataFrame, terms: DataFrame, lends: bool, strict: bool, few: int, silent: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows(job_id, text, ...) with the codes of ``_judged`` and the number of their list, null where the job or the text is;
    and pieces(list, code, hits): the hit of a code, all own hits under -1.

    Each distinct text is judged once, and texts that support the same things in the same way share a list. Texts and
    lists go to every task up to SENT bytes or so, beyond that the rows meet them in a shuffle."""
    at, lists = ["job_id", "text"], ["own", *(["near"] if lends else []), *(["mute"] if silent else [])]
    texts = stored(rows.select(*at).dropna().distinct())
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n // 50_000))
    judged = stored(_judged(texts.repartition(tasks), keywords, terms, lends, strict, few, silent))
    shared = stored(judged.select(*lists).distinct().withColumn("list", F.monotonically_increasing_id()))
    small = (shared.agg(F.sum(128 * (1 + sum(F.size(c) for c in lists)))).first()[0] or 0) <= SENT
    near_by = F.broadcast if small else lambda df: df
    codes = shared.select("list", *[(F.transform(c, lambda h: h["code"]) if c != "mute" else F.col(c)).alias(c) for c in lists])
    numbered = judged.join(near_by(shared), lists).select(*at, "list")
    numbered = numbered if small else numbered.join(codes, "list")
    met = rows.join(F.broadcast(numbered) if size <= SENT and small else numbered, at, "left").drop("text")
    met = met.join(F.broadcast(codes), "list", "left") if small else met
    hits = lambda c: F.transform(c, lambda h: F.struct(*[h[f].alias(f) for f in ("job_id", "ord", "keyword", "via", "evidence")]))
    each = shared.select("list", F.explode(F.concat(*lists[: 1 + lends])).alias("h")).select("list", "h.code", hits(F.array("h")).alias("hits"))
    return met, near_by(each.unionByName(shared.select("list", F.lit(-1).cast("long").alias("code"), hits("own").alias("hits"))))


def _lines(units: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """Units, and the lines that make up their documents: the units themselves, or else the texts of ``contexts``."""
    units = units.withColumn("summary", F.coalesce(F.col("section") == "SUMMARY", F.lit(False))).drop("section")
    if contexts is None:
        return units.withColumn("line", F.col("unit_no"))
    told = contexts.select("doc_id", "job_id", "text", F.lit(0).cast(units.schema["unit_no"].dataType).alias("line"))
    return units.unionByName(told, allowMissingColumns=True)


def _support_of_many(units: DataFrame, keywords: DataFrame, terms: DataFrame, contexts: DataFrame | None, strict: bool, few: int) -> DataFrame:
    near, ids = _near(few), ["doc_id", "unit_no"]
    found = _named(units, ids, terms, near).select(*ids, "job_id", "ord", "keyword", "via", "prio", "key_no", "term_no", "evidence")
    worded = reworded(units, ids, keywords, strict, few)
    found = found.unionByName(worded.select(*ids, "job_id", "ord", "keyword", F.lit("reworded").alias("via"), F.lit(3).alias("prio"), F.lit(0).alias("key_no"), F.lit(0).alias("term_no"), "evidence"))
    if contexts is not None:
        stated = _named(contexts, ["doc_id"], _stated(keywords), near).withColumn("evidence", F.col("keyword"))
        around = stated.unionByName(_named(contexts, ["doc_id"], _around(terms), near)).join(units.filter("section = 'SUMMARY'").select("doc_id", "unit_no"), "doc_id")
        found = found.unionByName(around.select(*ids, "job_id", "ord", "keyword", "via", "prio", "key_no", "term_no", "evidence"))
    return _best(found)


def offers(units: DataFrame, keywords: DataFrame, implications: DataFrame, contexts: DataFrame | None = None, per_unit: int = 2, per_keyword: int = 2, few: int = 100_000) -> DataFrame:
    """(doc_id, unit_no, keyword, via, evidence): keywords that a unit may work in. In the order of units, those that
    the document lacks first: at most ``per_unit`` a unit and ``per_keyword`` a keyword (the caps are the rule), none
    that the unit states, and only the first unit of a repeated text. A document is contexts(doc_id, job_id, text), or
    all units as its lines."""
    keywords, terms = stored(keywords.select("job_id", "ord", "keyword")), stored(terms_of(keywords, implications, _near(few)))
    units = units.select("doc_id", "unit_no", "job_id", "section", "text")
    if terms.count() + keywords.count() > min(few, within_.LISTED):
        lists = _candidates_of_many(units, keywords, terms, whole_texts(units) if contexts is None else contexts, few)
        chosen = lists.select("doc_id", F.explode(_given(lists, per_unit, per_keyword)).alias("x"))
        return chosen.select("doc_id", "x.unit_no", "x.hit.*")
    first = F.col("text").isNotNull() & (F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("unit_no")) == 1)
    met, pieces = _settled(_lines(units.withColumn("first", first), contexts), keywords, terms, True, True, few, silent=True)
    chosen = within_.offered(met, per_unit, per_keyword).join(pieces, ["list", "code"])
    return chosen.select("doc_id", "unit_no", F.inline("hits")).select("doc_id", "unit_no", "keyword", "via", "evidence")


def _given(lists: DataFrame, per_unit: int, per_keyword: int) -> Column:
    """Of ``units``, in order, each with its rows(name, hit), the (unit_no, hit) that are taken under both caps."""
    hit, number = (lists.schema["units"].dataType.elementType[c].dataType for c in ("rows", "unit_no"))
    hit = hit.elementType["hit"].dataType.simpleString()
    kind = f"struct<given:array<string>,n:int,taken:array<struct<unit_no:{number.simpleString()},hit:{hit}>>>"
    empty = F.struct(F.array().alias("given"), F.lit(0).alias("n"), F.array().alias("taken")).cast(kind)

    def step(unit: Column):
        def take(acc: Column, x: Column) -> Column:
            spent = F.size(F.filter(acc["given"], lambda g: g == x["name"])) >= per_keyword
            more = F.struct(F.array_append(acc["given"], x["name"]).alias("given"), (acc["n"] + 1).alias("n"), F.array_append(acc["taken"], F.struct(unit["unit_no"].alias("unit_no"), x["hit"].alias("hit"))).alias("taken"))
            return F.when((acc["n"] >= per_unit) | spent, acc).otherwise(more.cast(kind))

        return take

    begun = lambda acc: F.struct(acc["given"].alias("given"), F.lit(0).alias("n"), acc["taken"].alias("taken")).cast(kind)
    return F.aggregate("units", empty, lambda acc, u: F.aggregate(u["rows"], begun(acc), step(u)))["taken"]


def _candidates_of_many(units: DataFrame, keywords: DataFrame, terms: DataFrame, contexts: DataFrame, few: int) -> DataFrame:
    ids, contexts = ["doc_id", "unit_no"], stored(contexts)
    first = units.groupBy("doc_id", "text").agg(F.min_by(F.struct("unit_no", "job_id", "section"), "unit_no").alias("x"))
    own = stored(first.select("doc_id", "x.unit_no", "x.job_id", "x.section", "text"))
    found = _support_of_many(own, keywords, terms, contexts, True, few).join(own.select(*ids, "text"), ids)
    found = found.filter(~states(F.col("keyword"), F.col("text")))
    named = _named(contexts, ["doc_id"], _stated(keywords), _near(few)).select("doc_id", "job_id", "ord").distinct()
    said = named.groupBy("doc_id").agg(F.collect_list(F.struct("job_id", "ord")).alias("said"))
    lists = found.join(said, "doc_id", "left")
    present = F.coalesce(F.array_contains("said", F.struct("job_id", "ord")), F.lit(False))
    row = F.struct(present.alias("present"), "ord", _name(F.col("keyword")).alias("name"), F.struct("keyword", "via", "evidence").alias("hit"))
    units = lists.groupBy("doc_id", "unit_no").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_no", "rows"))).alias("units"))


def check(pairs: DataFrame, keywords: DataFrame, implications: DataFrame, few: int = 100_000) -> DataFrame:
    """(doc_id, unit_no, job_id, ord, keyword, supported, via, evidence) of the keywords that a rewrite states and its
    original doesn't, from pairs(doc_id, job_id, unit_no, original, rewritten). Support is lenient here."""
    near, ids = _near(few), ["doc_id", "unit_no"]
    pairs, keywords = stored(pairs.select(*ids, "job_id", "original", "rewritten")), stored(keywords.select("job_id", "ord", "keyword"))
    if keywords.count() <= few:
        rules = _ruled(_stated(keywords))
        had = best_terms(pairs.withColumnRenamed("original", "text"), rules).select(*ids, "job_id", F.col("rewritten").alias("text"), F.transform("hits", lambda h: h["ord"]).alias("had"))
        fresh = best_terms(had, rules).select(*ids, "job_id", F.inline(F.filter("hits", lambda h: ~F.array_contains("had", h["ord"])))).drop("via", "evidence")
    else:
        said = lambda side: _named(pairs.select(*ids, "job_id", F.col(side).alias("text")), ids, _stated(keywords), near).select(*ids, "job_id", "ord", "keyword").distinct()
        fresh = said("rewritten").join(said("original"), [*ids, "job_id", "ord", "keyword"], "left_anti")
    known = support(pairs.select(*ids, "job_id", F.lit("").alias("section"), F.col("original").alias("text")), keywords, implications, None, False, few)
    out = fresh.join(known, [*ids, "job_id", "ord", "keyword"], "left")
    return out.select(*ids, "job_id", "ord", "keyword", F.col("via").isNotNull().alias("supported"), "via", "evidence")


def named(units: DataFrame, keywords: DataFrame, implications: DataFrame, few: int = 100_000) -> DataFrame:
    """(doc_id, unit_no, job_id, ord, keyword, via, evidence) of the keywords that a unit supports by a name alone: an
    acronym's other number, another name, or what a named thing implies, the first of these."""
    ids, terms = ["doc_id", "unit_no"], stored(terms_of(keywords, implications, _near(few)))
    if terms.count() <= few:
        return best_terms(units.select(*ids, "job_id", "text"), _ruled(terms)).select(*ids, "job_id", F.inline("hits"))
    return _best(_named(units, ids, terms, _near(few)))


def spot_vocabulary(texts: DataFrame, vocabulary: DataFrame, few: int = 100_000) -> DataFrame:
    """(doc_id, keywords, company) of texts(doc_id, text): the terms of vocabulary(ord, term) that a text states in any
    case, in the vocabulary's order, and the name after ``at``, ``join`` or ``About``. The terms are read off in one
    pass, however many; texts of one doc_id are one document for the terms."""
    held = find_terms(texts, ["doc_id"], vocabulary.select("term", F.lit(False).alias("exact")), few).select("doc_id", "term").distinct()
    hits = held.join(_near(few)(vocabulary), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("hits"))
    company = texts.select("doc_id", F.regexp_extract("text", lx.COMPANY, 1).alias("company"))
    keywords = F.coalesce(F.transform("hits", lambda h: h["term"]), F.array().cast("array<string>"))
    return company.join(hits, "doc_id", "left").select("doc_id", keywords.alias("keywords"), "company")
