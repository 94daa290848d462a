"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts (type, text, ref, units). A visitor over the parts flattens them in
order: text is escaped, anything else becomes a placeholder ``<|type:k|>``, k counting the turn's attachments,
and is recorded as an attachment reference with the tokens it will expand to. Turns are framed by control
strings; escaping (percent codes for the percent sign, ``<`` and ``[``) leaves none of the characters that
control strings need inside a text and is undone exactly by :func:`read_back`. The loss mask lists, for each
assistant turn, where its text lies in the turn's block, in code points.

Null texts and roles are empty. Turns are ordered by number, then role, then text, so ties and repeated rows
have one order. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|end|>"
#: Tokens that one unit expands to (a tile of an image, a second of audio, a page).
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    for raw, code in (("%", "%25"), ("<", "%3C"), ("[", "%5B")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def flatten(parts: Column) -> Column:
    """The visitor: parts in order, text escaped, attachments as numbered placeholders."""

    def visit(part: Column, i: Column) -> Column:
        ordinal = F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: ~is_text(p)))
        return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), ordinal.cast("string"), F.lit("|>")))

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    expanded = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXPANSION.items() for x in kv]), p["type"]), F.lit(1))
    return F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn_from: str = "assistant") -> DataFrame:
    """(conv, n_turns, formatted, loss_spans, attachments, expanded_tokens), one row per conversation."""
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), flatten(parts).alias("body"), attachments(parts).alias("attached"))
    lists = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN), escape_role(t["role"]), F.lit("\n"))
    block = lambda t: F.concat(head(t), t["body"], F.lit(END))
    spans = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("block"), F.length(head(t)).alias("start"), F.length(t["body"]).alias("length"), (t["role"] == learn_from).alias("on"))), lambda s: s["on"])
    every = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("block"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return lists.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", block), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["block"].alias("block"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        every.alias("attachments"),
        F.aggregate(every, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def blocks(formatted: Column) -> Column:
    """The turn blocks of a formatted conversation; no text can hold the string that begins one."""
    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30), lambda b: F.concat(F.lit(BEGIN), b))


def read_back(turn_blocks: Column) -> Column:
    """array of (role, text) as they were before formatting (attachments stay placeholders)."""

    def turn(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(BEGIN) + 1), F.length(block) - len(BEGIN) - len(END))
        cut = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + 1)).alias("text"))

    return F.transform(turn_blocks, turn)


def loss_text(turn_blocks: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order. ``turn_blocks``: a column made by :func:`blocks`."""
    cut = F.transform(spans, lambda s: F.substr(F.element_at(turn_blocks, s["block"] + 1), s["start"] + 1, s["length"]))
    return unescape(F.array_join(cut, ""))
