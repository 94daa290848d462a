"""Benchmark decontamination: a BM25 index of the test items, searched with every passage of every document.

*Index.* Each item (long ones cut into overlapping units of ``CELL`` words) is a BM25 document; weights are
divided by the unit's own score, so 1 means that a passage holds everything the unit has. Postings are kept in
blocks of ``BLOCK`` units with the largest weight per term and block.
*Search.* Passages are windows of two cells, one cell apart, so that every occurrence of a unit lies whole in
one of them. Block-max WAND in array form: a unit's commonest terms are optional; a block is opened for a
passage only if the block maxima of the passage's essential terms, plus all that the optional terms could add,
reach the threshold. Opened blocks are scored exactly, and every unit at or above the threshold is retrieved.
*Verification.* An item's question is its text up to the last sentence, its answer the last sentence. The
document must hold ``coverage`` of the five-word sequences of the item and of its question, and half of the
answer's words.

Words are runs of letters and digits, lower-cased, whatever the punctuation between them. Null and empty texts hold nothing; items without
words are skipped; an item of fewer than five words counts as one sequence. Repeated rows are reported each.
The index is broadcast in parts of at most ``part_words`` words, one pass over the documents per part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import pieces
from attest.llm.hashing import text_bytes, word_hashes

CELL, BLOCK, GRAM = 64, 8, 5
K1, B = 1.2, 0.75
WORD = regex.compile(r"[a-z0-9\u0080-\U0010FFFF]+")
BETWEEN = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")


def lowered(texts: list[str | None]) -> pa.Array:
    """Lower-cased, with a space for every sign beyond ASCII that is no letter, mark or digit."""
    return pc.replace_substring_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), r"[^\x00-\x7F\pL\pM\pN]+", " ")


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered([text])[0].as_py())


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + GRAM]) for i in range(max(1, len(tokens) - GRAM + 1))} if tokens else set()


def sentences(texts: list[str]) -> list[list[list[str]]]:
    """The words of each sentence of each text, sentences without words left out; all are lowered in one call."""
    cut = [SENTENCE.split(t) for t in texts]
    low = iter(lowered([s for own in cut for s in own]).to_pylist())
    return [[found for _ in own if (found := WORD.findall(next(low)))] for own in cut]


def parts_of(parts: list[list[str]]) -> tuple[list[str], list[str]]:
    """(question, answer) of a text's sentences; both are the whole of a text with one."""
    whole = [w for s in parts for w in s]
    return ([w for s in parts[:-1] for w in s], parts[-1]) if len(parts) > 1 else (whole, whole)


class Index:
    def __init__(self, items: list[tuple], threshold: float):
        """items: (item_id, text)."""
        self.threshold = threshold
        cut = sentences([t or "" for _, t in items])
        self.items = [item for item, parts in zip(items, cut, strict=True) if parts]
        cut = [parts for parts in cut if parts]
        tokens = [[w for s in parts for w in s] for parts in cut]
        halves = [parts_of(parts) for parts in cut]
        self.facts = [(grams(w), grams(question), set(answer)) for w, (question, answer) in zip(tokens, halves, strict=True)]
        units: list[tuple[int, Counter]] = []
        for n, w in enumerate(tokens):
            units += [(n, Counter(w[at : at + CELL])) for at in range(0, max(1, len(w) - CELL // 2), CELL // 2)] if len(w) > CELL else [(n, Counter(w))]
        self.unit_item = np.array([n for n, _ in units], np.int64)
        df = Counter(t for _, c in units for t in c)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        mean = sum(sum(c.values()) for _, c in units) / max(1, len(units))
        self.unit_terms, self.unit_weights, essential = [], [], defaultdict(dict)
        self.blocks = -(-len(units) // BLOCK) if units else 0
        self.optional = np.zeros(self.blocks)
        for u, (_, c) in enumerate(units):
            size = K1 * (1 - B + B * sum(c.values()) / mean)
            weight = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + size) for t, f in c.items()}
            own = sum(weight.values())
            ids = np.array(sorted(self.terms[t] for t in c), np.int64)
            by_id = {self.terms[t]: w / own for t, w in weight.items()}
            self.unit_terms.append(ids)
            self.unit_weights.append(np.array([by_id[i] for i in ids.tolist()]))
            left, block = 0.0, u // BLOCK
            for t in sorted(c, key=lambda t: (-df[t], weight[t], t)):  # commonest first
                w = by_id[self.terms[t]]
                if left + w <= threshold / 2:
                    left += w
                else:
                    k = self.terms[t]
                    essential[k][block] = max(w, essential[k].get(block, 0.0))
            self.optional[block] = max(self.optional[block], left)
        starts = np.zeros(len(self.terms) + 1, np.int64)
        flat_block, flat_max = [], []
        for k in range(len(self.terms)):
            for block, w in sorted(essential.get(k, {}).items()):
                flat_block.append(block)
                flat_max.append(w)
            starts[k + 1] = len(flat_block)
        self.starts, self.block_of, self.max_of = starts, np.array(flat_block, np.int64), np.array(flat_max)
        data, at = text_bytes(pa.array(list(self.terms), pa.large_string()))
        hashes, _ = word_hashes(data, at, BETWEEN)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.present = np.zeros(len(self.terms) + 1, bool)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term number of each word of the (lower-cased) texts, -1 for words that no item has; and the words
        before each text. Words are told apart by 64-bit hashes."""
        hashes, cuts = word_hashes(*text_bytes(texts), BETWEEN)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1), cuts

    def opened(self, ids: np.ndarray, cell: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(first cell, block) of the passages and blocks that may reach the threshold. first: each text's first cell."""
        known = ids >= 0
        at, term = cell[known], ids[known]
        count = self.starts[term + 1] - self.starts[term]
        pair = np.unique(at[count > 0] * (len(self.terms) + 1) + term[count > 0])  # a term counts once per cell
        at, term = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
        count = self.starts[term + 1] - self.starts[term]
        place = np.repeat(self.starts[term] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(term) else np.zeros(0, np.int64)
        key, back = np.unique(np.repeat(at, count) * self.blocks + self.block_of[place], return_inverse=True)
        sums = np.bincount(back, self.max_of[place], len(key)) if len(key) else np.zeros(0)
        # A window is a cell and the next one. The essential terms may all lie in the second, optional ones before it.
        ahead = np.setdiff1d(key[~np.isin(key // max(1, self.blocks), first)] - self.blocks, key)
        key, sums = np.concatenate((key, ahead)), np.concatenate((sums, np.zeros(len(ahead))))
        order = np.argsort(key)
        key, sums = key[order], sums[order]
        following = np.searchsorted(key, key + self.blocks)
        more = np.zeros(len(key))
        hit = following < len(key)
        hit[hit] = key[following[hit]] == key[hit] + self.blocks
        more[hit] = sums[following[hit]]
        ok = sums + more + self.optional[key % self.blocks] >= self.threshold - 1e-9 if len(key) else np.zeros(0, bool)
        return np.stack([key[ok] // self.blocks, key[ok] % self.blocks], axis=1)

    def retrieve(self, ids: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Units of a block whose score for the passage reaches the threshold."""
        self.present[ids] = True
        self.present[-1] = False  # where -1 points
        out = []
        for u in range(block * BLOCK, min(len(self.unit_item), (block + 1) * BLOCK)):
            score = float(self.unit_weights[u][self.present[self.unit_terms[u]]].sum())
            if score >= self.threshold - 1e-9:
                out.append((u, score))
        self.present[ids] = False
        return out

    def search(self, texts: list[str | None], coverage: float, together: int = 1 << 20) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(place of text, item, score, coverage of item, of question, of answer) of every leak."""
        i = 0
        while i < len(texts) and self.blocks:
            own, size = [], 0
            while i < len(texts) and (not own or size < together):
                own.append(i)
                size += len(texts[i] or "")
                i += 1
            low = lowered([texts[k] for k in own])
            ids, cuts = self.ids(low)
            counts = np.diff(cuts)
            cells = counts // CELL + 2  # one stays empty between texts
            first = np.cumsum(cells) - cells
            text_of = np.repeat(np.arange(len(own)), counts)
            cell = first[text_of] + (np.arange(len(ids)) - cuts[text_of]) // CELL
            found: dict[int, dict[int, float]] = defaultdict(dict)
            for at, block in self.opened(ids, cell, first).tolist():
                k = int(np.searchsorted(first, at, side="right")) - 1
                start = int(cuts[k]) + (at - int(first[k])) * CELL
                for u, score in self.retrieve(ids[start : min(start + 2 * CELL, int(cuts[k + 1]))], block):
                    n = int(self.unit_item[u])
                    found[own[k]][n] = max(score, found[own[k]].get(n, 0.0))
            for place in sorted(found):
                tokens = WORD.findall(low[place - own[0]].as_py())
                held, vocabulary = grams(tokens), set(tokens)
                text = " " + " ".join(tokens) + " "
                for n, score in sorted(found[place].items()):
                    share = [self._covered(g, held, text) for g in self.facts[n][:2]]
                    answer = len(self.facts[n][2] & vocabulary) / max(1, len(self.facts[n][2]))
                    if min(share) >= coverage and answer >= 0.5:
                        yield place, n, score, share[0], share[1], answer

    @staticmethod
    def _covered(wanted: set, held: set, text: str) -> float:
        if len(wanted) == 1 and len(next(iter(wanted))) < GRAM:
            return float(f" {' '.join(next(iter(wanted)))} " in text)
        return len(wanted & held) / len(wanted) if wanted else 1.0


def build(items: DataFrame, id_col: str, text_col: str, threshold: float, part_words: int) -> Iterator[Index]:
    """Indexes of at most about ``part_words`` words each, read from the table item by item."""
    part, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").orderBy("id", "text").toLocalIterator():
        part.append((r["id"], r["text"]))
        size += len(r["text"].split())
        if size >= part_words:
            yield Index(part, threshold)
            part, size = [], 0
    if part:
        yield Index(part, threshold)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.6, coverage: float = 0.8, part_words: int = 500_000) -> DataFrame:
    """(id, item_id, score, coverage, question_overlap, answer_overlap) for every item that a document holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = dict(rows.dtypes)["id"], dict(items.dtypes)[item_col]
    schema = f"id {kind}, item_id {item_kind}, score double, coverage double, question_overlap double, answer_overlap double"
    out = None
    for index in build(items, item_col, item_text, threshold, part_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                hits = list(shared.value.search(batch.column(1).to_pylist(), coverage))
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                found = pa.array([shared.value.items[h[1]][0] for h in hits])
                yield pa.RecordBatch.from_arrays([ids, found.cast(pa.int64()) if item_kind == "bigint" else found, *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4, 5))], ["id", "item_id", "score", "coverage", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.6, coverage: float = 0.8, part_words: int = 500_000) -> DataFrame:
    """The documents, all columns, without those that hold an item."""
    at = docs.columns.index(text_col)
    for index in build(items, "item_id", "text", threshold, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                bad = {h[0] for h in shared.value.search(batch.column(at).to_pylist(), coverage)}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
