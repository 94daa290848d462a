"""Toxicity: a lexicon trie intersected with Levenshtein automata, read in context windows.

*Lexicon.* Words and word stems whose share of toxic documents is clearly above the base rate among the
labelled rows one may learn from (counts of documents, one distributed aggregation).
*Matching.* The trie of the lexicon and the Levenshtein automaton of each entry are walked together; the
product is made deterministic as far as words ask for it, so a word costs one table step per character.
Entries of ``FUZZY_LENGTH`` letters or more match within one edit (a swap of neighbours counts as one), but for words
that clean documents know in their own right and toxic ones do not prefer: those are no misspellings.
*Context.* A hit inside a quotation of any length, or within ``WINDOW`` words after a reporting word, counts as
quoted; the classifier has a weight of its own for those, learned from the labels.
*Score.* Logistic regression over a handful of sums of term weights.

The lexicon is counted over all labelled rows but those that fit the classifier; only these are a bounded
sample, a third of about ``bound`` rows (the smallest hashes of their ids), drawn by class so that the rarer one is
not lost, the intercept corrected for it. Null and empty texts are scored as texts without a hit. Without labels of both classes
the score is the base rate. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import hash_unit, pieces, sample_fraction, stored

FUZZY_LENGTH, WINDOW, STEMS = 4, 4, (4, 5, 6, 7)
#: Words that announce someone else's words.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes reported reports word words term".split())
#: Marks that open a quotation, each with those that close it.
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
CLOSING = frozenset("".join(MARKS.values()))
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
FEATURES = 7


def bare(token: str) -> str:
    return EDGE.sub("", token.lower())


def quotations(tokens: list[str]) -> bytearray:
    """1 for every token of a quotation, however long: from a word that begins with an opening mark to the next that ends
    with its closing one. A quotation that is opened anew before it is closed begins there; one never closed is none."""
    inside, opened, closers = bytearray(len(tokens)), -1, ""
    for i, t in enumerate(tokens):
        if t[0] in MARKS and len(t) > 1 and (opened < 0 or MARKS[t[0]] == closers):
            opened, closers = i, MARKS[t[0]]
        if opened >= 0 and (t[-1] in CLOSING or t[-1] in ".,;:!?"):
            end = t.rstrip(".,;:!?")
            if len(end) > 1 and end[-1] in closers:
                inside[opened : i + 1] = b"\1" * (i + 1 - opened)
                opened = -1
    return inside


class Matcher:
    """Deterministic product of the lexicon's trie and Levenshtein automata of one edit, built lazily.

    A state is a set of (trie node, edits, letter owed by a swap). ``match`` gives the entries that a word
    matches: index and number of edits; stems match any word that begins with them, exactly."""

    def __init__(self, words: list[str], stems: list[str], room: int = 400_000):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.fuzzy: set[int] = set()
        for i, w in enumerate(words):
            path = self._insert(w)
            self.word_at[path[-1]] = i
            if len(w) >= FUZZY_LENGTH:
                self.fuzzy.update(path)
        for i, s in enumerate(stems):
            self.stem_at[self._insert(s)[-1]] = len(words) + i
        self.long = {w for w in range(len(words)) if len(words[w]) >= FUZZY_LENGTH}
        self.room, self.steps = room, {}
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self._reset()

    def _insert(self, word: str) -> list[int]:
        node, path = 0, [0]
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
            node = self.children[node][c]
            path.append(node)
        return path

    def _reset(self) -> None:
        self.steps, self.states, self.ids = {}, [], {}
        self._state(self._close({(0, 0, "")}))

    def _state(self, members: frozenset) -> int:
        if members not in self.ids:
            self.ids[members] = len(self.states)
            self.states.append(members)
        return self.ids[members]

    def _close(self, members: set) -> frozenset:
        """Add what a missing letter reaches."""
        out = set(members)
        for node, edits, owed in members:
            if edits == 0 and not owed and node in self.fuzzy:
                out.update((child, 1, "") for child in self.children[node].values() if child in self.fuzzy)
        return frozenset(out)

    def _step(self, state: int, c: str) -> int:
        out: set = set()
        for node, edits, owed in self.states[state]:
            if owed:
                if c == owed:
                    out.add((node, edits, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits, ""))
            if edits == 0 and node in self.fuzzy:
                out.add((node, 1, ""))  # a letter too many
                for letter, other in self.children[node].items():
                    if other in self.fuzzy and letter != c:
                        out.add((other, 1, ""))  # another letter
                        swapped = self.children[other].get(c)
                        if swapped is not None and swapped in self.fuzzy:
                            out.add((swapped, 1, letter))  # two letters swapped: the first is still to come
        return self._state(self._close(out)) if out else -1

    def match(self, word: str) -> list[tuple[int, int]]:
        found: dict[int, int] = {}
        state, stem = 0, 0
        for c in word:
            if stem >= 0:
                stem = self.children[stem].get(c, -1)
                if stem in self.stem_at:
                    found[self.stem_at[stem]] = 0
            if state >= 0:
                following = self.steps.get((state, c))
                if following is None:
                    if len(self.steps) > self.room:
                        return self._fresh(word)
                    following = self.steps[state, c] = self._step(state, c)
                state = following
            if state < 0 and stem < 0:
                return list(found.items())
        if state >= 0:
            for node, edits, owed in self.states[state]:
                entry = self.word_at.get(node)
                if entry is not None and not owed and (edits == 0 or entry in self.long):
                    found[entry] = min(edits, found.get(entry, 9))
        return list(found.items())

    def _fresh(self, word: str) -> list[tuple[int, int]]:
        self._reset()
        return self.match(word)


class Scorer:
    def __init__(self, words: list[str], stems: list[str], weights: list[float], beta: np.ndarray | None = None, known: frozenset[str] = frozenset(), room: int = 500_000):
        self.words, self.stems, self.weights, self.beta, self.known, self.room = words, stems, weights, beta, known, room
        self.matcher, self.seen = Matcher(words, stems), {}

    def __reduce__(self):
        return Scorer, (self.words, self.stems, self.weights, self.beta, self.known, self.room)

    def hits(self, token: str) -> tuple:
        """Entries that a token matches and the edits it takes; a known word is no misspelling of another."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > self.room:
                self.seen.clear()
            word = bare(token)
            got = self.seen[token] = tuple((e, k) for e, k in self.matcher.match(word) if not k or word not in self.known) if word else ()
        return got

    def features(self, text: str) -> list[float]:
        tokens = WORDS.findall(text)
        lookup, seen = self.hits, self.seen
        found = [i for i, t in enumerate(tokens) if (seen[t] if t in seen else lookup(t))]
        between = quotations(tokens) if found else b""
        plain: dict[int, float] = {}
        loose: dict[int, float] = {}
        quoted: dict[int, float] = {}
        stems: dict[int, float] = {}
        for i in found:
            said = between[i] or self.reported(tokens, i)
            for entry, edits in lookup(tokens[i]):
                kind = stems if entry >= len(self.words) else quoted if said else loose if edits else plain
                kind[entry] = self.weights[entry]
        length = math.log1p(len(tokens))
        every = [*plain.values(), *stems.values()]
        return [sum(plain.values()), sum(loose.values()), sum(quoted.values()), sum(stems.values()), max(every, default=0.0), len(plain) + len(stems), length * bool(every)]

    @staticmethod
    def reported(tokens: list[str], i: int) -> bool:
        """At most WINDOW words after a reporting word."""
        return any(bare(t) in REPORTING for t in tokens[max(0, i - WINDOW) : i])

    def score(self, text: str | None) -> float:
        z = self.beta[0] + float(np.dot(self.beta[1:], self.features(text or "")))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


#: Where the classifier stands without evidence: exact hits count in full, misspelled ones half, quoted ones little.
PRIOR = np.array([1.0, 0.5, 0.1, 0.5, 0.0, 0.0, 0.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method, shrunk towards ``PRIOR``; the intercept is free. Rows: a bounded sample."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.hstack([np.ones((len(x), 1)), x / scale])
    prior = np.concatenate([[0.0], PRIOR * scale])
    beta = np.zeros(a.shape[1])
    shrink = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + shrink, a.T @ (y - p) - shrink @ (beta - prior))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([beta[:1], beta[1:] / scale])


def class_fractions(clean: int, toxic: int, bound: int) -> tuple[float, float]:
    """Shares of clean and toxic rows to draw, about ``bound`` in all: the rarer class gives up to half of them."""
    if clean + toxic <= bound:
        return 1.0, 1.0
    rarer = min(clean, toxic, bound // 2)
    drawn = (bound - rarer, rarer) if toxic <= clean else (rarer, bound - rarer)
    return sample_fraction(clean, drawn[0]), sample_fraction(toxic, drawn[1])


def bounded(rows: DataFrame, bound: int) -> list:
    """All rows, or an error where there are more than ``bound``."""
    found = rows.limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"more than {bound} terms: raise the bound or ask more of a term")
    return found


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 12_000, least: int = 4, entries: int = 1_000_000) -> Scorer:
    """Learn lexicon and classifier from ``labelled`` (already only rows that may be learned from).

    A third of a sample of ``bound`` rows fits the classifier, all other rows the lexicon, so that the weights are
    judged on documents that did not choose the entries. Every term that is sure enough enters the lexicon; more than
    ``entries`` of them, or of known words one edit from one, are refused with an error, never cut."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        rate = sizes.get(1, 0) / n if n else 0.0
        return Scorer([], [], [], np.array([math.log((rate + 1e-3) / (1 - rate + 1e-3))] + [0.0] * FEATURES))
    fraction = class_fractions(sizes[0], sizes[1], bound)
    drawn = hash_unit(F.col("id"), F.col("text")) < F.when(F.col("y") == 1, fraction[1]).otherwise(fraction[0])
    picked = rows.withColumn("fit", drawn & (F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(3)) == 0))

    def rows_of(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = sorted(counts[1].keys() | counts[0].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

    def terms(batches: Iterator[pa.RecordBatch], room: int = 500_000) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in pieces(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {bare(t) for t in set(WORDS.findall(text))} - {""}
                counts[y == 1].update({"w" + w for w in words} | {"s" + w[:k] for w in words for k in STEMS if len(w) > k} | {"d"})
                if len(counts[0]) + len(counts[1]) > room:  # the sums go on in the aggregation
                    yield rows_of(counts)
                    counts = (Counter(), Counter())
        yield rows_of(counts)

    counted = picked.filter("not fit").select("text", "y").mapInArrow(terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = stored(counted.filter((F.col("term") == "d") | (F.col("toxic") >= least) | (F.col("term").startswith("w") & (F.col("clean") >= least))))
    base = counted.filter("term = 'd'").select(F.col("toxic").alias("toxic_docs"), F.col("clean").alias("clean_docs"))
    head = base.first()
    toxic_docs, clean_docs = (head["toxic_docs"], head["clean_docs"]) if head else (0, 0)
    weight = F.log((F.col("toxic") + 0.5) / (toxic_docs + 1)) - F.log((F.col("clean") + 0.5) / (clean_docs + 1))
    strongest = counted.filter((F.col("term") != "d") & (F.col("toxic") >= least)).withColumn("weight", weight)
    # Lower end of the weight's interval: seldom seen terms must be purer.
    sure = F.col("weight") - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = bounded(strongest.filter(sure > 1.0).select("term", "weight", "toxic"), entries)
    kept: dict[str, tuple[float, int]] = {}
    for r in chosen:
        kept[r["term"]] = (r["weight"], r["toxic"])
    # A stem says nothing new where one word makes up nearly all of it.
    for name in [t for t in kept if t[0] == "s"]:
        covered = max((n for t, (_, n) in kept.items() if t[0] == "w" and t[1:].startswith(name[1:])), default=0)
        longer = max((n for t, (_, n) in kept.items() if t[0] == "s" and len(t) > len(name) and t.startswith(name)), default=0)
        if max(covered, longer) >= 0.9 * kept[name][1]:
            del kept[name]
    words, stems = sorted(t[1:] for t in kept if t[0] == "w"), sorted(t[1:] for t in kept if t[0] == "s")
    weights = [kept["w" + w][0] for w in words] + [kept["s" + s][0] for s in stems]
    matching = picked.sparkSession.sparkContext.broadcast(Scorer(words, stems, weights))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if any(k for _, k in matching.value.hits(w))], pa.string())], ["word"])

    clean_words = counted.filter(F.col("term").startswith("w") & (F.col("clean") >= least) & (weight <= 0)).select(F.expr("substring(term, 2)").alias("word"))
    known = frozenset(r["word"] for r in bounded(clean_words.mapInArrow(near, "word string"), entries))
    scorer = Scorer(words, stems, weights, None, known)
    shared = picked.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    seen = picked.filter("fit").select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()  # a third of ``bound``
    if len({r["y"] for r in seen}) == 2:
        order = sorted(([*r["x"], r["y"]] for r in seen))
        scorer.beta = fit_logistic(np.array([r[:-1] for r in order]), np.array([r[-1] for r in order], float))
        scorer.beta[0] -= math.log(fraction[1] / fraction[0])
    else:
        rate = sizes[1] / n
        scorer.beta = np.concatenate([[math.log(rate / (1 - rate))], PRIOR])
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", *keep: Column, threshold: float = 0.3) -> DataFrame:
    """(id, *keep, score, predicted) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(id_col), *keep)
    fields = rows.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = np.array([shared.value.score(t) for t in batch.column(0).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*(f.name for f in fields), "score", "predicted"])

    return rows.mapInArrow(run, schema)
