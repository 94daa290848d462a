"""Operators over lines (doc_id, line_no, line): headings, sections, units, contacts, line sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.functions import score
from attest.functions.text import ends_sentence, let, lookup, spaced_words, squeeze, strip_bullet, word_count, words

_MARKS = r"[\*_#`]+"
#: Seven words, and one of two letters or more, so that these are no letters set apart: too long for a heading.
_RUNNING_TEXT = r"^(?=.*?[\p{L}\p{N}]{2})(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]\S*+\s++){6}[^\p{L}\p{N}]*+[\p{L}\p{N}]"
_DECO = "[\\s​﻿ │|▌►▶◆■□●○]+"


def clean_heading(line: Column) -> Column:
    """Without markdown and decoration; letters set apart (T I T L E) are pulled together."""
    out = F.regexp_replace(F.coalesce(line, F.lit("")), _MARKS, "")
    out = F.trim(F.regexp_replace(out, f"^{_DECO}|{_DECO}$", ""))

    def close_up(text: Column) -> Column:
        spaced = text.rlike(r"^(?:[A-Za-z](?:\s+|$)){2,}$") & (F.length(F.replace(text, F.lit(" "))) >= 4)
        return F.when(spaced, squeeze(F.regexp_replace(text, r"(?<=[A-Za-z]) (?=[A-Za-z])", ""))).otherwise(text)

    return let(F.regexp_replace(out, r"[\s:;\-–—|]+$", ""), close_up)


def _known(word: Column, *more: list[str]) -> Column:
    names = word.isin(list(lx.ALIASES))
    for values in more:
        names = names | word.isin(values)
    return names


def _section_of(clean: Column) -> Column:
    """Section of a cleaned heading by the rules for whole phrases, compounds and qualifiers."""

    def lowered(p: Column) -> Column:
        lower = F.array_join(F.transform(p["words"], lambda w: F.regexp_replace(F.lower(w), r"^[:;.,]+|[:;.,]+$", "")), " ")
        lower = F.trim(F.regexp_replace(F.regexp_replace(lower, r"\s*\([^)]*\)$", ""), r"\s*\d+$", ""))
        upper = p["clean"].rlike(r"\p{Lu}") & ~p["clean"].rlike(r"\p{Ll}")
        titled = F.forall(p["words"], lambda w: ~w.rlike(r"^\p{L}") | F.lower(w).isin(lx.CONNECTORS) | w.rlike(r"^\p{Lu}"))
        return F.struct(lower.alias("lower"), (upper | titled).alias("styled"))

    def split(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p["lower"], r"\s*(?:&|/|\||,|\+|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")
        return F.struct(p["lower"].alias("lower"), p["styled"].alias("styled"), parts.alias("parts"), words(p["lower"]).alias("tail"))

    def found(p: Column) -> Column:
        parts, tail, n = p["parts"], p["tail"], F.size(p["tail"])
        head, last = F.try_element_at(tail, F.lit(1)), F.try_element_at(tail, F.lit(-1))
        compound = (F.size(parts) > 1) & F.forall(parts, lambda x: _known(x, lx.COMPOUND_WORDS))
        first = F.try_element_at(F.filter(parts, lambda x: _known(x)), F.lit(1))
        leading = p["styled"] & n.between(2, 4) & F.forall(F.slice(tail, 2, 9), lambda w: _known(w, lx.COMPOUND_WORDS, lx.CONNECTORS))
        trailing = p["styled"] & n.between(2, 3) & ~F.exists(F.slice(tail, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w: w.isin(lx.CONNECTORS))
        return F.coalesce(lookup(lx.ALIASES, p["lower"]), F.when(compound, lookup(lx.ALIASES, first)), F.when(leading, lookup(lx.ALIASES, head)), F.when(trailing, lookup(lx.ALIASES, last)))

    named = let(let(F.struct(clean.alias("clean"), words(clean).alias("words")), lowered), split)
    return F.when((clean != "") & (word_count(clean) <= 6), let(named, found))


def match_section(line: Column) -> Column:
    """Canonical section of a heading line, or null."""
    joined = {a.replace(" ", ""): s for a, s in reversed(lx.ALIASES.items()) if " " in a}

    def glued(p: Column) -> Column:
        return F.when(p["camel"].contains(" "), _section_of(p["camel"])).otherwise(lookup(joined, F.lower(p["clean"])))

    def of(clean: Column) -> Column:
        camel = F.regexp_replace(clean, r"(?<=[a-z])(?=[A-Z])", " ")
        one = ~clean.rlike(r"\s") & (F.length(clean) >= 8)
        return F.coalesce(_section_of(clean), F.when(one, let(F.struct(clean.alias("clean"), camel.alias("camel")), glued)))

    label = F.regexp_replace(F.coalesce(line, F.lit("")), _MARKS, "").rlike(lx.INLINE_LABEL)
    return F.when((F.length(F.coalesce(line, F.lit(""))) <= 400) & ~F.coalesce(line, F.lit("")).rlike(_RUNNING_TEXT) & ~label, let(clean_heading(line), of))


def heading_fragment(line: Column) -> Column:
    """One stylised word that begins some heading: perhaps the first half of a wrapped one."""
    clean = clean_heading(line)
    starters = sorted({a.split()[0] for a in lx.ALIASES if " " not in a} | set("work professional employment career technical core key academic personal side selected notable relevant volunteer community extracurricular".split()))
    whole = let(clean, lambda c: F.lower(c).isin(starters) & c.rlike(r"^(?:\p{Lu}+|\p{Lu}\p{Ll}*)$"))
    return ~F.coalesce(line, F.lit("")).rlike(_RUNNING_TEXT) & whole


def headings(lines: DataFrame) -> DataFrame:
    """Lines with ``heading`` (section opened by the line, alone or with the next one) and ``skipped`` (the
    second half of a wrapped heading)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines.withColumn("own", match_section(F.col("line"))).withColumn("after", F.lead("line").over(order))
    both = match_section(F.concat_ws(" ", clean_heading(F.col("line")), clean_heading(F.col("after"))))
    merged = own.withColumn("merged", F.when(F.col("own").isNull() & F.col("after").isNotNull() & heading_fragment(F.col("line")), both))
    skipped = F.coalesce(F.lag(F.col("merged").isNotNull()).over(order), F.lit(False))
    return merged.withColumn("skipped", skipped).select(*lines.columns, F.coalesce("own", "merged").alias("heading"), "skipped")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, line) of the content lines, each under the last heading before it.

    Only lines that could open a section enter the fold that settles the rules that depend on the current
    section; they come back with their text, and all other lines take the section by a forward fill."""
    found = headings(lines).filter("not skipped")
    bare = F.regexp_replace("line", _MARKS, "")
    label = F.when(F.col("heading").isNull() & F.col("line").contains(":"), lookup(lx.ALIASES, F.lower(F.trim(F.regexp_extract(bare, lx.INLINE_LABEL, 1)))))
    found = found.withColumn("label", label).select("doc_id", "line_no", "line", "heading", "label")
    event = F.struct("line_no", "line", "heading", "label", F.col("line").rlike(lx.SUBLABEL).alias("sub"), F.trim(F.regexp_extract(bare, lx.INLINE_LABEL, 2)).alias("value"))
    sparse = found.filter("heading is not null or label is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    row = "struct<line_no:int,opened:string,kept:boolean,inline:boolean>"
    start = F.struct(F.lit("HEADER").alias("now"), F.array().cast(f"array<{row}>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        now = acc["now"]
        stays = now.isin("SKILLS", "EDUCATION")
        opens = e["heading"].isNotNull() & (e["heading"] != now) & ~(stays & e["heading"].isin(lx.OVERRIDES) & e["sub"])
        inline = e["heading"].isNull() & (e["label"] != now) & ~now.isin(lx.ENTRY_SECTIONS) & ~(stays & e["label"].isin(lx.OVERRIDES))
        section = F.when(opens, e["heading"]).when(inline, e["label"]).otherwise(now)
        done = F.struct(e["line_no"].alias("line_no"), F.when(opens | inline, section).alias("opened"), (~opens).alias("kept"), inline.alias("inline"))
        return F.struct(section.alias("now"), F.concat(acc["done"], F.array(done)).alias("done"))

    folded = sparse.select("doc_id", F.explode(F.arrays_zip("events", F.aggregate("events", start, step)["done"].alias("done"))).alias("x"))
    events = folded.select("doc_id", "x.events.line_no", "x.events.line", "x.events.value", "x.done.opened", "x.done.kept", "x.done.inline")
    rest = found.filter("heading is null and label is null").select("doc_id", "line_no", "line", *[F.lit(None).cast(k).alias(c) for c, k in (("value", "string"), ("opened", "string"), ("kept", "boolean"), ("inline", "boolean"))])
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = rest.unionByName(events).withColumn("section", F.coalesce(F.last("opened", ignorenulls=True).over(order), F.lit("HEADER")))
    return filled.filter("kept is null or kept").select("doc_id", "line_no", "section", F.when(F.col("inline"), F.col("value")).otherwise(F.col("line")).alias("line"))


def _titled(p: Column) -> Column:
    named = F.filter(F.split(p["clean"], " "), lambda w: w.rlike(r"^\p{Lu}") | (w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    return F.size(named) / F.greatest(p["n"], F.lit(1))


def _action(p: Column) -> Column:
    return F.lower(F.regexp_extract(p["clean"], r"(?U)^[^\w]*([A-Za-z]+)", 1)).isin(lx.OPENERS)


def _facts(line: Column, section: Column) -> Column:
    """What the rules for lines ask for more than once; what takes a text apart they ask for themselves, of short texts."""

    def bare(tidy: Column) -> Column:
        return F.struct(F.trim(F.regexp_replace(tidy, lx.BULLET, "")).alias("clean"), tidy.rlike(lx.BULLET).alias("bullet"))

    def of(p: Column) -> Column:
        open_end = ~F.right(p["clean"], F.lit(3)).rlike(r"[.!?]\s*$")  # a squeezed text ends in no more than one space and a line's end
        return F.struct(p["clean"].alias("clean"), section.alias("section"), p["bullet"].alias("bullet"), spaced_words(p["clean"]).alias("n"), open_end.alias("open_end"))

    return let(let(squeeze(line), bare), of)


def _header(p: Column) -> Column:
    clean, section, n, open_end = (p[k] for k in ("clean", "section", "n", "open_end"))
    project = ((n <= 12) & clean.rlike(r"[|–—]") & ~_action(p)) | ((n <= 5) & open_end & ~_action(p) & (_titled(p) >= 0.6))
    dated = clean.contains("19") | clean.contains("20")
    return (
        F.when(p["bullet"], False)
        .when(n == 0, True)
        .when((n <= 3) & clean.endswith(":"), True)
        .when(~section.isin(lx.RELAXED_HEADER) & (n <= 4) & open_end, True)
        .when((n <= 20) & open_end & dated & clean.rlike(lx.DATE_RANGE), True)
        .when((n <= 14) & open_end & clean.rlike(lx.DATE), True)
        .when(open_end & dated & clean.rlike(lx.JOB_TITLE), True)
        .when(section == "SKILLS", False)
        .when(section == "PROJECTS", project)
        .otherwise((n <= 14) & open_end & ~_action(p) & (_titled(p) >= 0.75))
    )


def _judged(line: Column, section: Column) -> Column:
    """struct(clean, header, cand, bullet, n): whether a line heads an entry, and whether it is long and plain enough to be a unit."""

    def of(p: Column) -> Column:
        clean, n = p["clean"], p["n"]
        relaxed = p["section"].isin(lx.RELAXED_UNIT)
        long_enough = (n >= F.when(relaxed, 3).otherwise(6)) & (F.length(clean) >= F.when(relaxed, 20).otherwise(35))
        shaped = p["bullet"] | (n >= F.when(relaxed, 3).otherwise(7)) | ((p["section"] == "PROJECTS") & _action(p))
        cand = long_enough & shaped & ~p["header"] & ~clean.rlike(lx.LINK)
        return F.struct(clean.alias("clean"), p["header"].alias("header"), cand.alias("cand"), p["bullet"].alias("bullet"), n.alias("n"))

    return let(let(_facts(line, section), lambda p: F.struct(*[p[k].alias(k) for k in ("clean", "section", "bullet", "n")], _header(p).alias("header"))), of)


def is_header(line: Column, section: Column) -> Column:
    """Whether a line under ``section`` heads an entry rather than being content."""
    return let(_facts(line, section), _header)


def is_candidate(line: Column, section: Column) -> Column:
    """Whether a line is long and plain enough to be a unit of its own."""
    return _judged(line, section)["cand"]


def looks_like_list(text: Column) -> Column:
    body = F.when(F.instr(F.substring(text, 1, 40), ":") > 0, F.substr(text, F.instr(text, ":") + 1)).otherwise(text)
    parts = F.filter(F.transform(F.split(body, r"[,;|•·]"), lambda p: F.trim(p)), lambda p: p != "")
    short = lambda p: (F.size(p) >= 3) & (F.aggregate(p, F.lit(0), lambda n, x: n + word_count(x)) / F.greatest(F.size(p), F.lit(1)) <= 3)
    return let(parts, short) & (score.verb_strength(text) == 0)


def units(content: DataFrame) -> DataFrame:
    """Lines of sections to units: continuation lines join the unit above; headers are units of their own.

    (doc_id, section, unit_no, unit_id, text, line_indices, eligible)"""
    order = Window.partitionBy("doc_id", "section").orderBy("line_no")
    rows = content.withColumn("idx", F.row_number().over(order) - 1).filter(strip_bullet(F.col("line")) != "")
    rows = rows.withColumn("j", _judged(F.col("line"), F.col("section"))).select("*", F.col("j.clean").alias("text"), "j.header", "j.cand", "j.bullet").drop("j")
    before = F.lag("header").over(order)
    starts = F.col("header") | F.coalesce(before, F.lit(True)) | F.col("bullet") | (F.lag(ends_sentence(F.col("line"))).over(order) & F.col("cand"))
    numbered = rows.withColumn("starts", starts).withColumn("unit_no", F.sum(F.col("starts").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    grouped = numbered.groupBy("doc_id", "section", "unit_no").agg(parts.alias("parts"), F.bool_or("header").alias("header"), F.bool_or("cand").alias("any_cand"))
    text = squeeze(F.array_join(F.transform("parts", lambda p: p["text"]), " "))
    built = grouped.select("doc_id", "section", "unit_no", text.alias("text"), F.transform("parts", lambda p: p["idx"]).alias("line_indices"), "header", "any_cand")
    unit_id = F.concat_ws(":", "section", F.element_at("line_indices", 1).cast("string"), F.substring(F.sha1("text"), 1, 10))
    usable = ~F.col("header") & F.col("any_cand")

    def by_rules(j: Column) -> Column:
        fits = usable & j["cand"]  # no header then
        other = ~F.col("section").isin(lx.LIST_SECTIONS) & (fits | (j["n"] >= 4)) & ~j["header"]
        return F.when(F.col("section").isin(lx.PRIMARY_SECTIONS), fits).otherwise(other) & ~looks_like_list(F.col("text"))

    judged = let(_judged(F.col("text"), F.col("section")), by_rules)
    never = (F.col("section") == "HEADER") | (F.col("section").isin(lx.PRIMARY_SECTIONS) & ~usable) | F.col("section").isin(lx.LIST_SECTIONS)
    eligible = F.when(never, False).otherwise(judged)
    return built.select("doc_id", "section", "unit_no", unit_id.alias("unit_id"), "text", "line_indices", eligible.alias("eligible"))


def missing_sections(docs: DataFrame, content: DataFrame) -> DataFrame:
    """Required sections that a document lacks; documents without a line lack all."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, lx.REQUIRED_SECTIONS))).alias("section"))
    return wanted.join(content.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")


def contacts(lines: DataFrame) -> DataFrame:
    """First e-mail, phone, profiles and other url of the first fifteen lines, and the name on the first."""
    top = lines.filter("line_no < 15")
    take = lambda p: F.nullif(F.regexp_extract("line", f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1), F.lit(""))
    phone = F.when(~F.trim(take(lx.PHONE)).rlike(r"^\(?(19|20)\d{2}\)?\s*[-–—]\s*\(?(19|20)\d{2}\)?$"), F.trim(take(lx.PHONE)))
    url = F.when(~take(lx.URL).rlike("(?i)linkedin|github"), take(lx.URL))
    fields = {"email": take(lx.EMAIL), "phone": phone, "linkedin": take(lx.LINKEDIN), "github": take(lx.GITHUB), "url": url}
    rows = top.select("doc_id", "line_no", "line", *[v.alias(k) for k, v in fields.items()])
    name = F.max(F.when((F.col("line_no") == 0) & F.col("email").isNull() & F.col("phone").isNull(), F.col("line")))
    return rows.groupBy("doc_id").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in fields], name.alias("name"))


def header_residue(lines: DataFrame) -> DataFrame:
    """The lines before any heading that neither hold a contact nor are one."""
    held = contacts(lines)
    values = held.select("doc_id", F.explode(F.array(*[F.col(c) for c in held.columns if c != "doc_id"])).alias("line")).filter("line is not null")
    holds = F.col("line").rlike(lx.EMAIL) | F.col("line").rlike(lx.PHONE) | F.col("line").rlike(lx.LINKEDIN) | F.col("line").rlike(lx.GITHUB)
    return sections(lines).filter("section = 'HEADER'").filter(~holds).join(values, ["doc_id", "line"], "left_anti")


def needs_ocr(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents with fewer than ten lines of more than three characters."""
    n = lines.groupBy("doc_id").agg(F.count_if(F.length(F.trim("line")) > 3).alias("n_lines"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines")).filter("n_lines < 10")


def assemble(content: DataFrame) -> DataFrame:
    """One text per document: ``## SECTION``, then its lines, sections by first line."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), "\n")
    parts = content.groupBy("doc_id", "section").agg(F.min("line_no").alias("first"), body.alias("body"))
    part = F.struct("first", F.concat(F.lit("## "), "section", F.lit("\n"), "body").alias("part"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("text"))


def splice(markdown: Column, section: Column, body: Column) -> Column:
    """The text with the body of ``## SECTION`` replaced; null where it has no such section."""
    head = F.concat(F.lit("\n## "), section, F.lit("\n"))
    padded = F.concat(F.lit("\n"), markdown)
    at = F.instr(padded, head)
    rest = F.substr(padded, at + F.length(head))
    following = F.instr(rest, "\n## ")
    out = F.concat(F.substr(padded, F.lit(1), at + F.length(head) - 1), body, F.when(following > 0, F.concat(F.lit("\n"), F.substr(rest, following))).otherwise(F.lit("")))
    return F.when(at > 0, F.substr(out, F.lit(2)))


def collapse_runs(lines: DataFrame) -> DataFrame:
    """Without lines equal to the one before."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("before", before).filter("before is null or before <> line").drop("before")


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, line, n-th occurrence, change) as multisets: same, removed or added."""
    nth = F.row_number().over(Window.partitionBy("pair", "line").orderBy("line_no"))
    a = left.select("pair", "line", nth.alias("nth"), F.lit(True).alias("in_a"))
    b = right.select("pair", "line", nth.alias("nth"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("same")
    return a.join(b, ["pair", "line", "nth"], "full_outer").select("pair", "line", "nth", change.alias("change"))


def section_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Section names of two versions with each side's text and whether it changed."""
    side = lambda df, name: df.groupBy("pair", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), "\n").alias(name))
    return side(left, "before").join(side(right, "after"), ["pair", "section"], "full_outer").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))
