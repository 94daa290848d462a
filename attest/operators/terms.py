"""Terms in texts: an Aho-Corasick automaton over all terms runs once over each text.

A term counts as a whole token: no letter or digit before it, none of those, + or # after it. An exact term counts as
written, any other in any case (A-Z). Up to ``bound`` terms go to every task at a time; a longer list is cut into parts by
hash, each with a pass over the texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOLD = {c: c + 32 for c in range(65, 91)}
_BEFORE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_AFTER = _BEFORE | {"+", "#"}
#: Automata of this worker, by list; a worker serves many tasks.
_built: dict[str, Automaton] = {}
_ruled: dict[str, Rules] = {}


class Automaton:
    def __init__(self, terms: list[tuple[str, bool]]):
        import ahocorasick

        self.terms, self.trie, spelled = terms, ahocorasick.Automaton(), {}
        for i, (term, exact) in enumerate(terms):
            spelled.setdefault(term.translate(_FOLD), []).append((i, term if exact else None))
        for folded, own in spelled.items():
            self.trie.add_word(folded, (len(folded), own))
        self.trie.make_automaton()

    def first(self, text: str) -> dict[int, str]:
        """Numbers of the terms in the text, and how it writes each where it first does."""
        found: dict[int, tuple[int, str]] = {}
        if not len(self.trie):
            return {}
        folded = text.translate(_FOLD)
        for end, (size, own) in self.trie.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1] in _BEFORE) or (end + 1 < len(folded) and folded[end + 1] in _AFTER):
                continue
            written = text[start : end + 1]
            for i, exact in own:
                if (exact is None or exact == written) and i not in found:
                    found[i] = written
        return found


def find_terms(texts: DataFrame, id_cols: list[str], terms: DataFrame, bound: int = 100_000) -> DataFrame:
    """(*id_cols, term, evidence) of texts(*id_cols, text) and terms(term, exact): the terms that a text holds and how it
    writes them. A null or blank term is in no text; a null text holds none."""
    spark = texts.sparkSession
    listed = terms.filter("term <> ''").select("term", "exact").distinct()
    parts = max(1, -(-listed.count() // bound))
    rows = texts.filter(F.col("text").isNotNull()).select(*id_cols, "text")
    kind = rows.drop("text").schema.add("term", "string").add("evidence", "string")
    if parts > 1:
        listed = listed.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    out = None
    for part in range(parts):
        own = [(r["term"], r["exact"]) for r in (listed.filter(F.col("part") == part) if parts > 1 else listed).collect()]
        sent, name = spark.sparkContext.broadcast(own), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                while len(_built) >= 4:
                    del _built[next(iter(_built))]
                _built[name] = Automaton(sent.value)
            automaton = _built[name]
            for batch in batches:
                at, which, written = [], [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1)):
                    for number, evidence in automaton.first(text.as_py()).items():
                        at.append(i)
                        which.append(automaton.terms[number][0])
                        written.append(evidence)
                ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(which, pa.string()), pa.array(written, pa.string())], [*id_cols, "term", "evidence"])

        hits = rows.mapInArrow(run, kind)
        out = hits if out is None else out.unionByName(hits)
    return out


class Rules:
    """What counts as evidence by job, and of a text and job the best evidence of each keyword."""

    def __init__(self, rules: list[tuple]):
        self.automaton = Automaton(sorted({(r[6], r[7]) for r in rules}))
        number = {t: i for i, t in enumerate(self.automaton.terms)}
        self.of: dict[tuple, list[tuple]] = {}
        for job, ord_, keyword, via, rank, fixed, term, exact in rules:
            self.of.setdefault((job, number[term, exact]), []).append((ord_, (*rank, term), keyword, via, fixed))
        self.place = {rank: i for i, rank in enumerate(sorted({(*r[4], r[6]) for r in rules}))}
        self.best = lru_cache(maxsize=65_536)(self._best)

    def _best(self, job, text: str) -> list[tuple]:
        found: dict = {}
        for number, written in self.automaton.first(text).items():
            for ord_, rank, keyword, via, fixed in self.of.get((job, number), ()):
                if ord_ not in found or rank < found[ord_][0]:
                    found[ord_] = (rank, keyword, via, written if fixed is None else fixed)
        return [(o, keyword, via, evidence, rank[0], self.place[rank]) for o, (rank, keyword, via, evidence) in found.items()]


def best_terms(texts: DataFrame, rules: DataFrame, ranked: bool = False) -> DataFrame:
    """texts(job_id, text, ...) with ``hits``: an array of (ord, keyword, via, evidence), for each keyword of the job whose term
    the text holds the best rule by (prio, key_no, term_no). Rules(job_id, ord, keyword, via, prio, key_no, term_no, fixed,
    term, exact) go to every task; ``fixed`` is evidence in place of what the text writes. No rows are shuffled.
    ``ranked`` adds each hit's prio and its place in the order of preference."""
    listed = rules.filter("term <> ''").select("job_id", "ord", "keyword", "via", "prio", "key_no", "term_no", "fixed", "term", "exact").distinct()
    own = [(r[0], r[1], r[2], r[3], (r[4], r[5], r[6]), r[7], r[8], r[9]) for r in listed.collect()]
    sent, name = texts.sparkSession.sparkContext.broadcast(own), uuid.uuid4().hex
    number = rules.schema["ord"].dataType.typeName()
    names = ["ord", "keyword", "via", "evidence", *(["prio", "rank"] if ranked else [])]
    hit = T.StructType([T.StructField("ord", rules.schema["ord"].dataType), *[T.StructField(c, T.StringType() if i < 3 else T.IntegerType()) for i, c in enumerate(names[1:])]])
    columns, kind = texts.columns, T.StructType([*texts.schema.fields, T.StructField("hits", T.ArrayType(hit))])
    types = [pa.int32() if number == "integer" else pa.int64(), *[pa.string()] * 3, *[pa.int32()] * (len(names) - 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ruled:
            while len(_ruled) >= 4:
                del _ruled[next(iter(_ruled))]
            _ruled[name] = Rules(sent.value)
        best = _ruled[name].best
        for batch in batches:
            ends, hits = [0], []
            for job, text in zip(batch.column(columns.index("job_id")).to_pylist(), batch.column(columns.index("text")).to_pylist(), strict=True):
                if text is not None:
                    hits += best(job, text)
                ends.append(len(hits))
            flat = pa.StructArray.from_arrays([pa.array([h[i] for h in hits], t) for i, t in enumerate(types)], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*columns, "hits"])

    return texts.mapInArrow(run, kind)
