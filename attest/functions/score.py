"""Column expressions of the scoring rubric for one text unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions import claims
from attest.functions import lexicon as lx
from attest.functions.text import let, lookup, word_count

#: A capitalised word after the first one, then a version number.
VERSION = r"(?<=\s)([A-Z][A-Za-z+#.]*)\s+v?\d+(?:\.\d+)*(?![\w%.])"


def _phrases(alternatives: str) -> str:
    """Any of the alternatives as whole words; a letter that begins none is passed over before borders of words are sought."""
    begins = "".join(sorted({a[0] for a in alternatives.split("|")}))
    return rf"(?iU)(?=[{begins}])\b(?:{alternatives})\b"


def is_quantified(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike("[0-9]"), F.size(claims.claim_tokens(F.regexp_replace(whole, VERSION, "$1"))) > 0).otherwise(False)


def past_forms(word: Column) -> Column:
    """Forms under which a present or gerund may stand in the list of verbs."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    stem_list = (
        F.when(word.endswith("ing") & (n > 5), F.array(word, cut(3), F.concat(cut(3), F.lit("e"))))
        .when(word.endswith("es") & (n > 4), F.array(word, cut(2), cut(1)))
        .when(word.endswith("s") & (n > 3), F.array(word, cut(1)))
        .otherwise(F.array(word))
    )
    forms = F.flatten(F.transform(stem_list, lambda s: F.array(lookup(lx.PRESENT_TO_PAST, s), F.concat(s, F.lit("ed")), F.concat(s, F.lit("d")), F.when(s.endswith("y"), F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.lit("ied"))))))
    return F.concat(F.array(word), F.filter(forms, lambda f: f.isNotNull()))


def verb_strength(text: Column) -> Column:
    """1 for an opener that claims work done, 0.5 for the milder ones, else 0."""

    def of(lead: Column) -> Column:
        form, tier = lead["form"], lead["tier"]
        graded = F.exists(past_forms(form), lambda f: f.isin([v for v, t in lx.VERB_TIER.items() if t >= lx.EXECUTION]))
        unlisted = form.isin(lx.IRREGULAR_PAST) | (form.endswith("ed") & (F.length(form) >= 5) & ~form.endswith("eed"))
        return (
            F.when(form.isNull(), 0.0)
            .when(tier >= lx.EXECUTION, 1.0)
            .when(tier.isNotNull(), F.when(form.isin(lx.MODERATE), 0.5).otherwise(0.0))
            .when(form.contains(" "), 0.0)
            .when(graded | unlisted, 1.0)
            .otherwise(0.0)
        )

    return let(claims.leading_verb(text), of)


def structure_checks(text: Column) -> Column:
    """struct(length, no_first_person, no_filler)."""

    def of(clean: Column) -> Column:
        length = let(word_count(clean), lambda n: F.when(n.between(8, 30), 1.0).when(n.between(5, 40), 0.5).otherwise(0.0))
        first = clean.rlike(_phrases(lx.FIRST_PERSON)) | clean.rlike(r"(?U)(?=us)\bus\b")
        return F.struct(length.alias("length"), (~first).alias("no_first_person"), (~clean.rlike(_phrases(lx.FILLER))).alias("no_filler"))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(?=[ie])(?:\b(?:i\.e|e\.g)\.?|\bi/o\b)", " "), of)


def structure(text: Column) -> Column:
    return let(structure_checks(text), lambda c: (c["length"] + c["no_first_person"].cast("double") + c["no_filler"].cast("double")) / 3)


def signals(text: Column) -> Column:
    """struct(quantified, action_verb, structure, score, form); halves round to even; ``form`` is the structure
    before rounding."""
    parts = F.struct(is_quantified(text).alias("quantified"), verb_strength(text).alias("action_verb"), structure(text).alias("form"))

    def of(p: Column) -> Column:
        points = lx.WEIGHTS["quantified"] * p["quantified"].cast("double") + lx.WEIGHTS["action_verb"] * p["action_verb"] + lx.WEIGHTS["structure"] * p["form"]
        return F.struct(p["quantified"].alias("quantified"), p["action_verb"].alias("action_verb"), F.bround(p["form"], 2).alias("structure"), F.bround(points, 0).cast("int").alias("score"), p["form"].alias("form"))

    return let(parts, of)


def strong(text: Column) -> Column:
    """``is_strong`` of a text's signals; what the first no settles isn't worked out."""
    return is_quantified(text) & (verb_strength(text) == 1.0) & (F.bround(structure(text), 2) == 1.0)


def is_strong(s: Column) -> Column:
    """Nothing a rewrite should add."""
    return s["quantified"] & (s["action_verb"] == 1.0) & (s["structure"] == 1.0)
