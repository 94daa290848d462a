"""Column expressions over text: white space, bullets, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions import lexicon as lx


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def has_bullet(text: Column) -> Column:
    return squeeze(text).rlike(lx.BULLET)


def strip_bullet(text: Column) -> Column:
    """The line without its list marker."""
    return F.trim(F.regexp_replace(squeeze(text), lx.BULLET, ""))


#: A text that begins with a word and has single spaces between words and nowhere else.
_TIDY = r"^[A-Za-z]{2}\S*+(?: \S++)*+\z"


def opener(text: Column) -> Column:
    """Without marker, lower-cased, single-spaced."""
    bare = lambda t: squeeze(F.lower(F.regexp_replace(F.trim(t), lx.BULLET, "")))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(_TIDY), F.lower(t)).otherwise(bare(t)))


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def spaced_words(tidy: Column) -> Column:
    """Number of words of a squeezed text, without taking it apart."""
    return F.when(tidy == "", 0).otherwise(F.length(tidy) - F.length(F.replace(tidy, F.lit(" "))) + 1)


def word_count(text: Column) -> Column:
    return let(squeeze(text), spaced_words)


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _fits(keys: list, key: Column) -> Column:
    return key.isin(keys) if len(keys) > 1 else key == keys[0]


def grade(table: dict, key: Column) -> Column:
    """As ``lookup``, for long tables of few values: the keys of a value are a hashed set, a map is searched from end to end."""
    out = F
    for value in dict.fromkeys(table.values()):
        out = out.when(_fits([k for k, v in table.items() if v == value], key), value)
    return out


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike(r"[.!?]\s*$")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"), lambda x: F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"\s"), strip(x)).otherwise(x)), lambda x: x != "")


def strip_markdown(line: Column) -> Column:
    """Without heading marks, bold, italic, underscores, code and quote marks."""
    for pattern, to in ((r"^\s*#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"`([^`]*)`", "$1"), (r"^\s*>\s?", "")):
        line = F.regexp_replace(line, pattern, to)
    return F.trim(line)
