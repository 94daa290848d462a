"""Exact dedup by Golomb-coded fingerprint exchange.

1. Each task reads its texts once: normal form (A-Z lower-cased), 64-bit fingerprint, sha256. Its documents form
   chunks; of a chunk the distinct fingerprints, cut to their first ``BITS`` bits and sorted, are split by owner (ranges
   of the fingerprint space) into one block each: the gaps between neighbours, Golomb-Rice coded. Rows and blocks
   are written by the same job.
2. Only the blocks are shuffled. An owner decodes its blocks, finds fingerprints that more than one block holds, and
   answers each block with a bitmap. A row knows its block and its place in it, so it meets its bit in a join with
   the bitmaps, which are broadcast up to ``few_bytes`` and shuffled beyond; chunks mark their own repeats.
3. Only rows with a marked fingerprint are suspects. Their texts are read again and grouped by the bytes of
   the normal form, which settles equality; partial sums collapse hot groups before the shuffle.

Null texts count as empty, so they equal empty ones. Of equal texts the row with the largest id stays; equal
ids tie harmlessly (``kept`` is then true for each of those rows). A row without an id stays only where no row of
its text has one, and then ties alike: ``keep_id`` is null and ``kept`` is true. Up to ``few`` fingerprints pass
through the driver in a broadcast join. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import pieces, stored


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 -> count, shift, length of the unary stream, first value, then the Golomb-Rice
    coded gaps: quotients in unary as one bit stream, remainders of ``shift`` bits as another."""
    n = len(values)
    if not n:
        return np.zeros(4, np.uint64).tobytes()
    gaps = np.diff(values, prepend=values[:1])
    shift = int(np.log2(max(1.0, float(values[-1] - values[0]) / n)))
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    places = np.arange(shift, dtype=np.uint64)[None, :]
    bits = (gaps[:, None] >> places & np.uint64(1)).astype(np.uint8)
    return np.array([n, shift, len(unary), values[0]], np.uint64).tobytes() + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(block: bytes) -> np.ndarray:
    n, shift, length = (int(x) for x in np.frombuffer(block, np.uint64, 3))
    if not n:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(block, np.uint64, 1, 24)
    size = (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(block, np.uint8, size, 32), count=length)
    quotient = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=32 + size), count=n * shift).reshape(n, shift)
    remainder = (bits.astype(np.uint64) << np.arange(shift, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return first + np.cumsum((quotient.astype(np.uint64) << np.uint64(shift)) + remainder, dtype=np.uint64)


def normal(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


#: Bits of a fingerprint that are exchanged, at least. More rows take more, so that at most about one in ``CHANCE`` rows is a
#: suspect by chance; suspects are verified.
BITS, CHANCE = 40, 128
#: Rows for each owner, whose fingerprints meet in one task.
OWNED = 5_000_000
#: Documents of a chunk.
CHUNK = 1 << 16
#: Rows of documents (owner and place of the fingerprint, ``again``: the chunk holds it twice) and of blocks.
ROWS = "chunk long, owner int, place int, again boolean, print long, sha binary, block binary"


def _chunk(chunk: int, ids: list[pa.Array], prints: np.ndarray, shas: list[bytes], owners: int, bits: int, kind: pa.DataType) -> pa.RecordBatch:
    """The rows of a chunk's documents, then those of its blocks."""
    values, at, count = np.unique(prints >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    width = np.uint64(-(-(1 << bits) // owners))
    owner = (values // width).astype(np.int32)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    place = np.arange(len(values)) - np.repeat(cuts, np.diff(np.append(cuts, len(values))))
    blocks = [golomb_encode(b) for b in np.split(values, cuts[1:])]
    n, m = len(prints), len(blocks)
    none = lambda k, t: pa.nulls(k, t)
    columns = {
        "id": pa.concat_arrays([*ids, none(m, kind)]), "chunk": pa.array(np.full(n + m, chunk)),
        "owner": pa.array(np.concatenate((owner[at], owner[cuts]))), "place": pa.concat_arrays([pa.array(place[at].astype(np.int32)), none(m, pa.int32())]),
        "again": pa.concat_arrays([pa.array(count[at] > 1), none(m, pa.bool_())]), "print": pa.concat_arrays([pa.array(prints.view(np.int64)), none(m, pa.int64())]),
        "sha": pa.concat_arrays([pa.array(shas, pa.binary()), none(m, pa.binary())]), "block": pa.concat_arrays([none(n, pa.binary()), pa.array(blocks, pa.binary())]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _fingerprints(rows: DataFrame, owners: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        prints: list[int] = []
        shas: list[bytes] = []
        kind = pa.int64()
        for batch in pieces(batches):
            texts = [t.as_buffer() for t in normal(batch.column(1))]
            kind = batch.column(0).type
            ids.append(batch.column(0))
            prints += [xxhash.xxh3_64_intdigest(t) for t in texts]
            shas += [hashlib.sha256(t).digest() for t in texts]
            if len(prints) >= CHUNK:
                yield _chunk(chunk, ids, np.array(prints, np.uint64), shas, owners, bits, kind)
                ids, prints, shas, chunk = [], [], [], chunk + 1
        if prints:
            yield _chunk(chunk, ids, np.array(prints, np.uint64), shas, owners, bits, kind)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {ROWS}")


def _answers(blocks: DataFrame) -> DataFrame:
    """(chunk, owner, bitmap): a bit for each fingerprint of a block, 1 if another block of the owner holds it too."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        decoded = [golomb_decode(b) for b in pdf["block"]]
        values, seen = np.unique(np.concatenate(decoded), return_counts=True)
        twice = values[seen > 1]
        maps = [np.packbits(np.isin(b, twice, assume_unique=True), bitorder="little").tobytes() for b in decoded]
        return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "bitmap": maps})

    return blocks.groupBy("owner").applyInPandas(answer, "chunk long, owner int, bitmap binary")


def suspects(prints: DataFrame, few_bytes: int) -> DataFrame:
    """(id, print, sha, suspect) of the documents: whether another one has the same fingerprint."""
    answers = stored(_answers(prints.filter("block is not null").select("chunk", "owner", "block")))
    size = answers.agg(F.sum(F.octet_length("bitmap") + 64)).first()[0] or 0
    bits = F.conv(F.hex(F.expr("substring(bitmap, place div 8 + 1, 1)")), 16, 10).cast("int")
    marked = prints.filter("block is null").join(F.broadcast(answers) if size <= few_bytes else answers, ["chunk", "owner"])
    return marked.select("id", "print", "sha", (F.col("again") | (F.getbit(bits, F.expr("place % 8")) == 1)).alias("suspect"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, few: int = 1_000_000, few_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``few``: up to so many suspect fingerprints (8 bytes each) the second reading drops other texts before any
    shuffle; beyond it, a shuffled semi-join does. ``owners`` are 64, or as many as give each ``OWNED`` rows at most."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    total = rows.count()
    owners = owners or max(64, -(-total // OWNED))
    bits = min(64, max(BITS, (total * CHANCE).bit_length()))
    marked = stored(suspects(stored(_fingerprints(rows, owners, bits)), few_bytes))
    wanted = marked.filter("suspect").select("print").distinct()
    n = wanted.count()

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = normal(batch.column(1))
            prints = np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), texts.cast(pa.binary())], ["id", "print", "bytes"])

    suspect_texts = rows.mapInArrow(reread, f"id {kind}, print long, bytes binary")
    suspect_texts = suspect_texts.join(F.broadcast(wanted) if n <= few else wanted, "print", "left_semi")
    suspect_texts = suspect_texts.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
    classes = suspect_texts.groupBy("sha", "bytes").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).drop("bytes")
    again = marked.filter("suspect").join(classes, "sha").select("id", "keep_id", "group_size", "sha")
    alone = marked.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return again.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
