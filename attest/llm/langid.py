"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 characters of letters, everything else read as one blank sign) per language
in ``buckets`` hash buckets, as one distributed aggregation. The log-probability matrix (buckets x languages,
a size fixed by the parameters) is broadcast; batches of texts are scored in numpy as the product of a sparse
count matrix (its entries are the n-gram positions) with that matrix.

Only a bounded sample is learned from: about ``per_label`` rows of each language, those with the smallest
hashes of their ids. Nulls and texts without a letter get ``und`` and score 0. Ties go to the first label in
alphabetical order. Without any row to learn from every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import hash_unit, pieces, sample_fraction

ORDERS = (1, 2, 3)
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
BLANK = 32
MAX_LABELS = 1000


def letter_table() -> np.ndarray:
    """Lower-case letter for each code point of the first plane; all that isn't a letter becomes a blank."""
    out = np.full(0x10000, BLANK, np.uint32)
    for cp in range(0x10000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            low = chr(cp).lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(letter_table())
    return _LETTERS[0]


class Grams:
    """Bucket of every n-gram of some texts laid end to end, each framed by blanks."""

    def __init__(self, texts: list[str], buckets: int):
        joined = " " + "  ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        table, low = letters(), codes.copy()
        plane = codes < 0x10000
        low[plane] = table[codes[plane]]
        if not plane.all():
            for i in np.flatnonzero(~plane):
                low[i] = ord(chr(codes[i]).lower()[0]) if chr(codes[i]).isalpha() else BLANK
        self.lettered = np.add.reduceat(low != BLANK, self.starts) > 0
        shift = np.uint32(32 - int(buckets).bit_length() + 1)
        self.by_order = []
        for n in ORDERS:
            size = len(low) - n + 1
            mixed = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            letter = np.zeros(size, bool)
            for k in range(n):
                part = low[k : k + size]
                mixed = (mixed ^ part) * MULTIPLIERS[k]
                mixed ^= mixed >> np.uint32(15)
                letter |= part != BLANK
            mixed = mixed * np.uint32(0x9E3779B1) >> shift
            mixed[~letter] = buckets  # only blanks: a row of zeros
            self.by_order.append(mixed)

    def spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.starts, np.maximum(self.starts, self.ends - n + 1)


def chunks(texts: list[str], characters: int = 500_000) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= characters):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


class Model:
    """Labels and the (buckets + 1) x labels matrix of log-probabilities; its last row is zero."""

    def __init__(self, labels: list[str], counts: np.ndarray, smoothing: float):
        self.labels = labels
        self.buckets = counts.shape[0]
        total = counts.sum(axis=0, keepdims=True) + smoothing * self.buckets
        self.logp = np.vstack([np.log((counts + smoothing) / np.maximum(total, 1e-9)), np.zeros((1, counts.shape[1]))]).astype(np.float32)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i, j in chunks(texts):
            part = texts[i:j]
            grams = Grams(part, self.buckets)
            if not self.labels:
                names += ["und"] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            total = np.zeros((len(part), len(self.labels)))
            for n, bucket in zip(ORDERS, grams.by_order, strict=True):
                lo, hi = grams.spans(n)
                for c in range(len(self.labels)):
                    run = np.concatenate(([0.0], np.cumsum(self.logp[:, c][bucket], dtype=np.float64)))
                    total[:, c] += run[np.minimum(hi, len(bucket))] - run[np.minimum(lo, len(bucket))]
            total /= len(ORDERS)  # the orders see the same characters
            best = total.argmax(axis=1)
            odds = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700))
            sure = 1 / odds.sum(axis=1)
            names += [self.labels[b] if ok else "und" for b, ok in zip(best, grams.lettered, strict=True)]
            scores.append(np.where(grams.lettered, sure, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", buckets: int = 1 << 15, per_label: int = 1500, smoothing: float = 0.1) -> Model:
    """Learn from ``rows`` (already only those that may be learned from), about ``per_label`` of each label, drawn by a hash of
    id and text, so that rows of one id, or without any, are drawn like others. More than ``MAX_LABELS`` labels are an
    error."""
    assert buckets & (buckets - 1) == 0, "buckets must be a power of two"
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not sizes:
        return Model([], np.zeros((buckets, 0)), smoothing)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, sample_fraction(n, per_label)).otherwise(share)
    picked = rows.filter("label is not null and text is not null").filter(hash_unit(F.col("id").cast("string"), F.col("text")) < share)
    labels = sorted(sizes)
    at = {label: i for i, label in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((buckets + 1) * len(labels), np.int64)
        for batch in pieces(batches):
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                grams = Grams(texts[i:j], buckets)
                owner = np.array([at[x] for x in names[i:j]], np.int64)
                for n, bucket in zip(ORDERS, grams.by_order, strict=True):
                    lo, hi = grams.spans(n)
                    inside = np.zeros(len(bucket) + 1, np.int64)
                    np.add.at(inside, np.minimum(lo, len(bucket)), 1)
                    np.add.at(inside, np.minimum(hi, len(bucket)), -1)
                    own = np.repeat(owner, grams.ends - grams.starts)[: len(bucket)]
                    keep = np.cumsum(inside)[:-1] > 0
                    counts += np.bincount(own[keep] * (buckets + 1) + bucket[keep].astype(np.int64), minlength=len(counts))
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], ["cell", "n"])

    cells = picked.select("text", "label").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # buckets x labels at most
    table = np.zeros((buckets + 1) * len(labels))
    for cell, n in cells:
        table[cell] = n
    return Model(labels, table.reshape(len(labels), buckets + 1)[:, :buckets].T, smoothing)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """(id, *keep, lang_pred, score) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(id_col), *keep)
    fields = rows.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = shared.value.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents, all columns, without those that have no language: no letter, or no label that reaches
    ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = shared.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.take(pa.array([i for i, name in enumerate(names) if name != "und" and scores[i] >= least], pa.int64()))

    return docs.mapInArrow(run, docs.schema)
