"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch are laid out as one ragged numpy array of
symbols. In each round every pre-token finds the lowest rank among its own adjacent pairs and applies that
pair everywhere in itself at once (of overlapping places the left one first); pre-tokens without a pair that
can merge leave. The symbols that survive are the tokens. Counts of pre-tokens are kept per Python worker in
a table of bounded size, as words repeat.

Nulls count as empty texts (0 tokens). Special strings inside a text are one token each, as the library has
it by default. Repeated rows give repeated results; an empty table gives an empty result. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import pieces as small

#: Fixed value: how byte-level vocabularies of this family cut a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 characters stand for
    themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Vocabulary:
    """Merge ranks as sorted arrays. Its size is that of the vocabulary file, whatever the data."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.array([vocab[c] for c in byte_names()], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] for a, _ in pairs], np.int64) * self.width + np.array([vocab[b] for _, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (none of them empty)."""
        counts = np.array([len(w) for w in words], np.int64)
        ids = np.arange(len(words))
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        lengths = counts.copy()
        while len(ids):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            row = np.repeat(np.arange(len(ids)), lengths)
            last = np.zeros(len(symbols), bool)
            last[starts + lengths - 1] = True
            ranks = np.full(len(symbols), NONE)
            inner = np.flatnonzero(~last)
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
            best = np.minimum.reduceat(ranks, starts)
            going = best < NONE
            hit = (ranks == best[row]) & going[row]
            # Of places that overlap (x x x), every second one counts from the left of each run.
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.ones(len(at), bool)
                fresh[1:] = np.diff(at) > 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                symbols = symbols.copy()
                symbols[at] = self.made[ranks[at]]
            keep = going[row]
            keep[at + 1] = False
            lengths = lengths - np.bincount(row[at], minlength=len(ids))
            counts[ids] = lengths
            symbols, ids, lengths = symbols[keep], ids[going], lengths[going]
        return counts


class Counter:
    """Counts the tokens of texts; remembers up to ``room`` pre-tokens, then starts afresh."""

    def __init__(self, vocabulary: Vocabulary, room: int = 1_000_000, chunk: int = 200_000):
        self.vocabulary, self.room, self.chunk, self.seen = vocabulary, room, chunk, {}
        self.cut = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), self.chunk):
            part = words[i : i + self.chunk]
            self.seen.update(zip(part, self.vocabulary.count([w.encode("utf-8") for w in part]).tolist(), strict=True))

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            return [w for piece in pieces for w in self.cut.findall(piece)], len(pieces) - 1
        return self.cut.findall(text), 0

    def texts(self, texts: list[str], together: int = 2_000_000) -> list[int]:
        """Tokens of each text. New pre-tokens of several texts (``together`` characters) merge in one go."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= together):
                size += len(texts[j])
                j += 1
            if len(self.seen) > self.room:
                self.seen.clear()
            cut = [self.words(t) for t in texts[i:j]]
            seen = self.seen
            self.learn([w for w in set().union(*(words for words, _ in cut)) if w not in seen])
            out += [special + sum(map(self.seen.__getitem__, words)) for words, special in cut]
            i = j
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. ``path``: the vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value.counter = getattr(shared.value, "counter", None) or Counter(shared.value)  # lives as long as the worker
        for batch in small(batches):
            texts = batch.column(1)
            size = pa.compute.binary_length(texts).cast(pa.int64())
            n = np.array(counter.texts(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
