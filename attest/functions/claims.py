"""Column expressions that verify a rewritten text against its original: figures, roles, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions import lexicon as lx
from attest.functions.text import grade, let, lookup, opener

_N = r"\d[\d,]*(?:\.\d+)?"
_SCALE = "k|m|bn?|thousand|million|billion"
# A look at the next character or two comes first, so that no other place pays for what must stand before a figure.
FIGURE = (
    rf"(?i)(?=[$\d])(?<![\w.])(\$\s?{_N}\s*(?:{_SCALE})?|{_N}\s*(?:{lx.UNITS})|{_N}\s*%|{_N}\s*(?:{_SCALE})(?!\w)|{_N}x(?!\w)|{_N})(?!\w)"
)
_YEAR = rf"(?<![\w.$])(?<!\$\s)(?:19|20)\d\d,*(?!\w|\.\d|\s*%|\s*(?:{_SCALE})(?!\w)|\s*(?:{lx.UNITS})(?!\w))"
DATED = (
    rf"(?i)(?=(?:19|20)\d\d)(?:(?<=\b(?:{lx.DATE_WORDS})\s{{0,9}})|(?<=\b(?:{lx.MONTHS})[a-z]{{0,9}}\.?\s{{0,9}})|(?<=(?:19|20)\d\d\s{{0,9}}(?:to|[-–—])\s{{0,9}})){_YEAR}"
    rf"|(?i)(?=(?:19|20)\d\d){_YEAR}(?=\s*(?:to|[-–—])\s*(?:19|20)\d\d\b)"
)


#: Numbers in words; as with figures, a letter that begins none is passed over first.
_NAMED = rf"(?i)(?=[{''.join(sorted({w[0] for w in lx.NUMBER_WORDS}))}])\b({'|'.join(sorted(lx.NUMBER_WORDS, key=len, reverse=True))})\b"
_NONE = "array<string>"


def _figures(text: Column) -> Column:
    """Figures of a text that has digits, as they stand in it."""
    bare = F.when(text.contains("["), F.regexp_replace(text, r"\[[^\]]*\]", " ")).otherwise(text)
    masked = let(bare, lambda t: F.when(t.contains("19") | t.contains("20"), F.regexp_replace(t, DATED, " ")).otherwise(t))
    found = F.regexp_extract_all(masked, F.lit(FIGURE), F.lit(1))
    return F.transform(found, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))


def claim_tokens(text: Column) -> Column:
    """Distinct figures of a text, lower-cased and sorted; not placeholders in brackets, not years that date. Most texts
    have no digit, and cost no more than that look."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike("[0-9]"), F.sort_array(F.array_distinct(_figures(t)))).otherwise(F.array().cast(_NONE)))


def claim_key(token: Column) -> Column:
    """What two figures must share to count as the same claim."""

    def of(p: Column) -> Column:
        text, number, rest = p["text"], p["number"], p["rest"]
        scale = F.coalesce(lookup(lx.SCALES, rest), F.lit(""))
        key = F.when(text.startswith("$"), F.concat(F.lit("$"), number, scale)).when(rest.startswith("%"), F.concat(number, F.lit("%"))).when(rest == "x", F.concat(number, F.lit("x"))).otherwise(F.concat(number, scale))
        return F.when(number == "", text).otherwise(key)

    def parts(text: Column) -> Column:
        number = F.regexp_extract(text, r"^\$?\s*(\d+(?:\.\d+)?)", 1)
        rest = F.trim(F.regexp_extract(text, r"^\$?\s*\d+(?:\.\d+)?\s*(.*)$", 1))
        return F.struct(text.alias("text"), number.alias("number"), rest.alias("rest"))

    return let(let(F.trim(F.replace(F.lower(token), F.lit(","))), parts), of)


def claim_keys(tokens: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(tokens, claim_key)))


def _known(original: Column) -> Column:
    """Keys of the original's figures and of its numbers in words, in any order."""

    def of(text: Column) -> Column:
        named = F.transform(F.regexp_extract_all(text, F.lit(_NAMED), F.lit(1)), lambda w: lookup({k: str(v) for k, v in lx.NUMBER_WORDS.items()}, F.lower(w)))
        figures = F.when(text.rlike("[0-9]"), F.transform(_figures(text), claim_key)).otherwise(F.array().cast(_NONE))
        return F.concat(figures, named)

    return let(F.coalesce(original, F.lit("")), of)


def supported_keys(original: Column) -> Column:
    """Keys of the original's figures and of its numbers in words."""
    return F.sort_array(F.array_distinct(_known(original)))


def new_claims(original: Column, rewritten: Column) -> Column:
    """Figures of the rewrite that the original doesn't support; the original is read only for a rewrite with figures."""

    def of(p: Column) -> Column:
        new = let(_known(p["original"]), lambda known: F.filter(p["tokens"], lambda t: ~F.array_contains(known, claim_key(t))))
        return F.when(F.size(p["tokens"]) == 0, p["tokens"]).otherwise(new)

    return let(F.struct(claim_tokens(rewritten).alias("tokens"), original.alias("original")), of)


def _lead(clean: Column) -> Column:
    """``leading_verb`` of an opener."""
    phrases = sorted(lx.PHRASE_TIER, key=len, reverse=True)

    def of(clean: Column) -> Column:
        phrase = F.coalesce(*[F.when(clean.startswith(p + " "), F.lit(p)) for p in phrases])
        word = F.nullif(F.regexp_extract(clean, "([a-z]+)", 1), F.lit(""))
        return F.struct(phrase.alias("phrase"), word.alias("word"))

    def graded(p: Column) -> Column:
        tier = F.when(p["phrase"].isNotNull(), grade(lx.PHRASE_TIER, p["phrase"])).otherwise(grade(lx.VERB_TIER, p["word"]))
        return F.struct(F.coalesce(p["phrase"], p["word"]).alias("form"), tier.alias("tier"))

    return let(let(F.concat(clean, F.lit(" ")), of), graded)


def _highest(clean: Column) -> Column:
    """``max_tier`` of an opener."""
    words = F.array_max(F.transform(F.regexp_extract_all(clean, F.lit("([a-z]+)"), F.lit(1)), lambda w: F.coalesce(grade(lx.VERB_TIER, w), F.lit(-1))))
    phrases = [F.when(clean.contains(p), t).otherwise(-1) for p, t in lx.PHRASE_TIER.items()]
    return F.greatest(F.coalesce(words, F.lit(-1)), *phrases)


def leading_verb(text: Column) -> Column:
    """struct(form, tier): the opening phrase or word; tier is null where it isn't graded."""
    return _lead(opener(text))


def max_tier(text: Column) -> Column:
    """Highest tier that any phrase (as a plain substring) or word of the text claims; -1 without any."""
    return let(opener(text), _highest)


def escalation(original: Column, rewritten: Column) -> Column:
    """struct(from_verb, to_verb, from_tier, to_tier) where the rewrite claims a higher role than any word of
    the original does; null otherwise. The original is read only for a rewrite that claims more than the lowest role."""
    name = lambda t: F.element_at(F.array(*map(F.lit, lx.TIER_NAMES)), t + 1)

    def compared(p: Column) -> Column:
        a, b = p["a"], p["b"]
        found = F.struct(a["form"].alias("from_verb"), b["form"].alias("to_verb"), name(a["tier"]).alias("from_tier"), name(b["tier"]).alias("to_tier"))
        return F.when(F.coalesce(b["tier"] > a["tier"], F.lit(False)), F.when(_highest(p["clean"]) < b["tier"], found))

    def read(p: Column) -> Column:
        facts = lambda clean: F.struct(_lead(clean).alias("a"), p["b"].alias("b"), clean.alias("clean"))
        return F.when(p["b"]["tier"] > lx.PARTICIPATION, let(let(opener(p["original"]), facts), compared))

    return let(F.struct(leading_verb(rewritten).alias("b"), original.alias("original")), read)
