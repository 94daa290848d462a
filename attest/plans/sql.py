"""DuckDB expressions for the rubric, written from the same fixed values."""

from __future__ import annotations

from attest.functions import lexicon as lx


def items(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def opener(c: str) -> str:
    return squeeze(f"lower(regexp_replace(trim({c}), '{lx.BULLET}', ''))")


def tier_of(word: str) -> str:
    return f"CASE {' '.join(f'WHEN {word} IN ({items(lx.VERBS[t].split())}) THEN {t}' for t in lx.VERBS)} END"


def lead_form(c: str) -> str:
    phrases = " ".join(f"WHEN starts_with({c} || ' ', '{p} ') THEN '{p}'" for p in sorted(lx.PHRASE_TIER, key=len, reverse=True))
    return f"CASE {phrases} ELSE nullif(regexp_extract({c}, '[a-z]+'), '') END"


def lead_tier(form: str) -> str:
    phrases = " ".join(f"WHEN {form} IN ({items(ps)}) THEN {t}" for t, ps in lx.PHRASES.items())
    return f"CASE {phrases} ELSE {tier_of(form)} END"


def max_tier(c: str) -> str:
    phrases = ", ".join(f"CASE WHEN contains({c}, '{p}') THEN {t} ELSE -1 END" for p, t in lx.PHRASE_TIER.items())
    return f"greatest(coalesce(list_max(list_transform(regexp_extract_all({c}, '[a-z]+'), lambda w: {tier_of('w')})), -1), {phrases})"


def strength(form: str, tier: str) -> str:
    able = items([v for v, t in lx.VERB_TIER.items() if t >= 1])
    past = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.PRESENT_TO_PAST.items())
    stems = (
        f"CASE WHEN {form} LIKE '%ing' AND length({form}) > 5 THEN [{form}, left({form}, length({form}) - 3), left({form}, length({form}) - 3) || 'e'] "
        f"WHEN {form} LIKE '%es' AND length({form}) > 4 THEN [{form}, left({form}, length({form}) - 2), left({form}, length({form}) - 1)] "
        f"WHEN {form} LIKE '%s' AND length({form}) > 3 THEN [{form}, left({form}, length({form}) - 1)] ELSE [{form}] END"
    )
    forms = f"list_concat([{form}], flatten(list_transform({stems}, lambda s: [s || 'ed', s || 'd', CASE WHEN s LIKE '%y' THEN left(s, length(s) - 1) || 'ied' END, CASE s {past} END])))"
    return (
        f"CASE WHEN {form} IS NULL THEN 0.0 WHEN {tier} >= 1 THEN 1.0 WHEN {tier} = 0 THEN CASE WHEN {form} IN ({items(lx.MODERATE)}) THEN 0.5 ELSE 0.0 END "
        f"WHEN contains({form}, ' ') THEN 0.0 WHEN list_has_any({forms}, [{able}]) OR {form} IN ({items(lx.IRREGULAR_PAST)}) "
        f"OR ({form} LIKE '%ed' AND length({form}) >= 5 AND {form} NOT LIKE '%eed') THEN 1.0 ELSE 0.0 END"
    )


def structure_parts(c: str) -> tuple[str, str, str]:
    clean = rf"regexp_replace({c}, '(?i)\b(?:i\.e|e\.g)\.?|\bi/o\b', ' ', 'g')"
    n = f"len(list_filter(regexp_split_to_array({squeeze(clean)}, ' '), lambda w: w <> ''))"
    length = f"CASE WHEN {n} BETWEEN 8 AND 30 THEN 1.0 WHEN {n} BETWEEN 5 AND 40 THEN 0.5 ELSE 0.0 END"
    person = lx.FIRST_PERSON.replace("'", "''")
    # RE2's word boundary knows ASCII only; the rule means letters of any script.
    edge = r"[^\pL\pN_]"
    alone = lambda words, flag="(?i)": f"regexp_matches({clean}, '{flag}(?:^|{edge})(?:{words})(?:$|{edge})')"
    return f"CAST({length} AS DOUBLE)", f"NOT ({alone(person)} OR {alone('us', '')})", f"NOT {alone(lx.FILLER)}"


UNIT_TOKENS = "list_sort(list_distinct(regexp_extract_all(lower({c}), '[0-9]+ users|[0-9]+%')))"
PAIR_TOKENS = r"list_sort(list_distinct(regexp_extract_all(lower(replace({c}, ' since 2019', '')), '\$[0-9]+k|[0-9]+ (?:users|people)|[0-9]+%')))"


def key(t: str) -> str:
    return f"CASE WHEN {t} LIKE '$%' OR {t} LIKE '%\\%' ESCAPE '\\' THEN {t} ELSE regexp_extract({t}, '[0-9]+') END"


def figure(text: str) -> str:
    """Whether any figure stands in a text that dates nothing: versions behind capitalised words go first (white space is
    doubled meanwhile, so that two versions can share it), then what is in brackets."""
    bare = rf"regexp_replace(regexp_replace({text}, '(\s)', '\1\1', 'g'), '(\s)([A-Z][A-Za-z+#.]*)\s+v?\d+(?:\.\d+)*($|[^\w%.])', '\1\2\3', 'g')"
    bare = rf"regexp_replace(replace({bare}, '  ', ' '), '\[[^\]]*\]', ' ', 'g')"
    n, scale = r"\d[\d,]*(?:\.\d+)?", "k|m|bn?|thousand|million|billion"
    body = rf"\$\s?{n}\s*(?:{scale})?|{n}\s*(?:{lx.UNITS})|{n}\s*%|{n}\s*(?:{scale})|{n}x|{n}".replace("'", "''")
    return rf"regexp_matches({bare}, '(?i)(?:^|[^\w.])(?:{body})(?:$|[^\w])')"


def signals(source: str, quantified: str = "regexp_matches(text, '[0-9]')") -> str:
    """CTEs ``scored`` over ``source`` with quantified, action_verb, form (exact structure), structure, score."""
    length, person, filler = structure_parts("text")
    return f"""opened AS (SELECT *, {opener('text')} AS clean FROM {source}), led AS (SELECT *, {lead_form('clean')} AS lead FROM opened),
tiered AS (SELECT *, {lead_tier('lead')} AS tier FROM led),
raw AS (SELECT *, {quantified} AS quantified, CAST({strength('lead', 'tier')} AS DOUBLE) AS action_verb,
  ({length} + CAST({person} AS DOUBLE) + CAST({filler} AS DOUBLE)) / 3 AS form FROM tiered),
scored AS (SELECT *, round_even(form, 2) AS structure, CAST(round_even(40 * CAST(quantified AS DOUBLE) + 30 * action_verb + 30 * form, 0) AS INTEGER) AS score FROM raw)"""
