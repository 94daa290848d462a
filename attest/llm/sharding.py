"""Sharding by sampled splitters, with shards of near equal bytes.

A row's sort key is one long: the leading bits of its text's hash, then bits of its id's hash. Equal texts
are neighbours, and a group of copies of any size can still be cut. A size-weighted sample of keys (each row
drawn by a hash, about as many whatever the table) gives quantile boundaries; records are partitioned by
range; ranges that turn out overfull are subdivided evenly in key space. The exact bytes and rows of each
range (a bounded table) place every range on the line from 0 to the sum of all sizes; inside a range a running
sum places its rows. Shard k takes the k-th equal stretch of that line, so shards differ by about one document.
Slots count rows along the same line, without gaps.

A null text has no bytes (size 16, crc32 of nothing: 0). Repeated rows take slots of their own (ties are
broken by id, then size). An empty table gives an empty result. Other columns can be kept by name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import stored

#: A row's weight besides its bytes.
ROW_BYTES = 16
ID_BITS = 24


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def sort_key(id_: Column, text: Column) -> Column:
    head = F.xxhash64(text).bitwiseAND(F.lit(-(1 << ID_BITS)))
    return head.bitwiseOR(F.shiftrightunsigned(F.xxhash64(id_.cast("string")), 64 - ID_BITS))


def splitters(keyed: DataFrame, samples: int, total: int) -> np.ndarray:
    """Quantile boundaries: the keys of a sample, each row drawn by a hash with a chance in proportion to its size, about
    ``samples`` in all."""
    unit = (F.pmod(F.xxhash64("key", "id", F.lit("draw")), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    drawn = keyed.filter(unit * total <= F.col("size") * samples).select("key").distinct().limit(8 * samples + 64).collect()
    return np.unique(np.array([r[0] for r in drawn], np.int64))


def subdivide(edges: np.ndarray, counts: dict[int, tuple[int, int]], rows: int) -> np.ndarray:
    """Cut each range of more than ``rows`` rows into equal stretches of key space, as far as it has any."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    more = []
    for r, (n, _) in counts.items():
        if n > rows:
            a = int(edges[r - 1]) if r else low
            b = int(edges[r]) if r < len(edges) else high
            pieces = min(64, -(-n // rows) * 2)
            more += [a + (b - a) * k // pieces for k in range(1, pieces) if (b - a) * k // pieces]
    return np.unique(np.concatenate([edges, np.array(more, np.int64)])) if more else edges


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 32, max_ranges: int = 1 << 16, rows_per_range: int = 2_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, *keep). ``max_ranges`` bounds the splitters that
    are broadcast (8 bytes each) and the range totals that come to the driver; a table that needs more is refused. Rows
    alike in text and id have one key, so only their range can stay overfull: its rows are placed in one task."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"), F.crc32(text).alias("crc"), sort_key(F.col(id_col), text).alias("key"), *(F.col(c).alias(f"__{c}") for c in keep)]
    keyed = stored(docs.select(*columns))
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    samples = int(min(max_ranges // 4, max(shards * per_shard, n // rows_per_range)))
    full = max(rows_per_range, 4 * n // max(samples, 1))
    edges = splitters(keyed, samples, total)
    while True:
        ranged = keyed.withColumn("range", range_of(docs, edges)(F.col("key")))
        totals = {r["range"]: (r["n"], r["bytes"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        finer = subdivide(edges, totals, full)
        if len(finer) == len(edges):
            break
        if len(finer) > max_ranges:
            raise ValueError(f"more than {max_ranges} ranges: raise max_ranges or rows_per_range")
        edges = finer
    # Where each range begins on the line of bytes and of rows.
    starts, at_bytes, at_rows = [], 0, 0
    for r in sorted(totals):
        starts.append((r, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + totals[r][1], at_rows + totals[r][0]
    total = max(at_bytes, 1)
    offsets = docs.sparkSession.createDataFrame(starts or [(0, 0, 0)], "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("key", "id", "size")
    placed = ranged.join(F.broadcast(offsets), "range").withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1).withColumn("end", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.col("end") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    placed = stored(placed.select("id", "size", "crc", "shard", "rank", *(f"__{c}" for c in keep)))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # ``shards`` rows
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"__{c}").alias(c) for c in keep))


def range_of(docs: DataFrame, edges: np.ndarray):
    shared = docs.sparkSession.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(np.int64), side="right").astype(np.int32))

    return of.asNondeterministic()  # else a join's null check would have it run twice
