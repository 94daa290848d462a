"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors become whole numbers, floor(256 * x). Candidates are grouped by length into buckets of bounded size. A query with
a threshold t (its k-th best product so far) can only find something in a bucket if the cosine reaches
t / (|q| * longest of the bucket): the local threshold. Above 1 the bucket is left out and the query doesn't travel
there. Else the bucket is pruned for the query, by length (|p| >= t / |q|, a prefix of the bucket sorted by
length) or by coordinates (the cosine bounds a candidate's share along each coordinate of the query; of the query's
three largest the one that leaves fewest, then all eight largest together with what the rest can add), whichever leaves
fewer, and what is left is verified by exact products. Queries that prune little are multiplied with the whole bucket at once.

*Thresholds* come from the probes: the longest vectors and some drawn by hash, ``probes`` in all, which go to every task;
their products are exact, so the k-th best of them is a true lower bound. Bounds are slack by 1e-9 and a threshold is
kept when met, so ties are never lost.

*Partitioning.* Buckets are cut at quantiles of length, and again by row where many vectors have the same length, as are
queries: at most about ``block`` of each meet in one task. A bucket is copied once per block of queries, a query once per
bucket that it can't leave out; each meeting gives out at most k rows a query.

Vectors that are null or hold null or non-finite components take no part. Vectors are met with those of as many components
only. Repeated rows, and rows of one vec_id, are rows of their own: a query's own row is left out, not its id. A null id is
never a query; it comes last among ties. Scores beyond 64 bits raise an error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import stored

SLACK = 1e-9
WIDEST = (1 << 63) - 1
FOUND = "row long, vec_id long, found long, score long"


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v, width, norm): the vectors that take part, numbered."""
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.filter(F.col(vector_col).isNotNull()).filter(finite).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return kept.select("row", "vec_id", "v", F.size("v").alias("width"), F.sqrt(squares).alias("norm"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum of products is exact in them, else in integers. Beyond 64 bits they
    stop at ``WIDEST``."""
    top = lambda m: int(np.abs(m).max(initial=0)) if not (m == np.iinfo(np.int64).min).any() else 1 << 63
    most = top(q) * top(p) * max(1, q.shape[-1])
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ p.T
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, -WIDEST, WIDEST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score, then the smaller id, then the row."""
    if len(score) > 4 * k:
        few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return few[np.lexsort((rows[few], ids[few], -score[few]))[:k]]
    return np.lexsort((rows, ids, -score))[:k]


class Bucket:
    """Candidates of one width by falling length, with each coordinate's shares in order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        self.rows, self.ids, self.v, self.norm = rows[order], ids[order], v[order], norm[order]
        self.unit = self.v / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def left(self, q: np.ndarray, norm: float, threshold: float, focus: int = 8) -> np.ndarray | None:
        """Places that the local cosine threshold leaves; None for all."""
        if norm == 0 or not len(self.norm) or self.norm[0] == 0:
            return None if threshold <= 0 else np.zeros(0, int)
        local = threshold / (norm * self.norm[0]) - SLACK
        if local > 1:
            return np.zeros(0, int)
        if local <= 0:
            return None
        prefix = int(np.searchsorted(-self.norm, -(threshold / norm * (1 - SLACK)), side="right"))
        share, few = q / norm, None
        main = np.argsort(-np.abs(share))[:focus]
        for f in main[:3]:
            order, value = self.coordinate(int(f))
            spread = np.sqrt(max(0.0, (1 - local * local) * (1 - share[f] ** 2))) + SLACK
            a = np.searchsorted(value, share[f] * local - spread) if share[f] > 0 else 0
            b = len(value) if share[f] > 0 else np.searchsorted(value, share[f] * local + spread, side="right")
            if few is None or b - a < few[1] - few[0]:
                few = a, b, order
        if few is None or few[1] - few[0] >= prefix:
            return np.arange(prefix) if prefix < len(self.norm) else None
        places = few[2][few[0] : few[1]]
        if 2 * len(places) > len(self.norm):
            return places
        # The main coordinates' products, and what the others can add at most.
        own = self.unit[places][:, main]
        most = own @ share[main] + np.sqrt(np.maximum(0, 1 - (own * own).sum(axis=1))) * np.sqrt(max(0.0, 1 - float((share[main] ** 2).sum())))
        return places[(most + SLACK) * self.norm[places] * norm >= threshold * (1 - SLACK)]


def search(q_rows: np.ndarray, q: np.ndarray, thresholds: np.ndarray, bucket: Bucket, k: int, dense: float = 0.25, together: int = 256) -> tuple[list, list, list, dict]:
    """(query place, bucket place, score) of each query's k best in the bucket that reach its threshold; counts."""
    at, where, scores, seen = [], [], [], {"verified": 0, "pairs": len(q) * len(bucket.rows)}
    norms, whole = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), []

    def keep(i: int, places: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero((score >= thresholds[i]) & (bucket.rows[places] != q_rows[i]))
        top = good[best(score[good], bucket.ids[places[good]], bucket.rows[places[good]], k)]
        if len(top) and (np.abs(score[top]) == WIDEST).any():
            raise OverflowError("a score is beyond 64 bits")
        at.extend([i] * len(top))
        where.extend(places[top])
        scores.extend(score[top])

    for i in range(len(q)):
        places = bucket.left(q[i].astype(np.float64), norms[i], float(thresholds[i]))
        if places is None or len(places) > dense * len(bucket.rows):
            whole.append(i)
        elif len(places):
            seen["verified"] += len(places)
            keep(i, places, products(q[i : i + 1], bucket.v[places])[0])
    every = np.arange(len(bucket.rows))
    for s in range(0, len(whole), together):
        part = whole[s : s + together]
        seen["verified"] += len(part) * len(every)
        for i, score in zip(part, products(q[part], bucket.v), strict=True):
            keep(i, every, score)
    return at, where, scores, seen


def _no_id(ids: pa.Array) -> np.ndarray:
    """Ids as numbers; a null one comes last."""
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, probes: int = 2_048, block: int = 16_384) -> DataFrame:
    """(row, vec_id, rank, found, score) of the k best candidates of each query, both (row, vec_id, v, width, norm)."""
    spark = candidates.sparkSession
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], "row long, vec_id long, rank int, found long, score long")
    # Bounded by ``probes`` vectors: the longest ones, and as many by a hash of the row.
    half = max(k + 1, probes // 2)
    shown = candidates.select("row", "vec_id", "v", "width")
    longest = candidates.orderBy(F.desc("norm"), "row").limit(half).select("row", "vec_id", "v", "width")
    drawn = shown.orderBy(F.xxhash64("row"), "row").limit(half)
    probe: dict[int, dict[int, list]] = {}
    for r in longest.unionByName(drawn).toLocalIterator():
        probe.setdefault(r["width"], {})[r["row"]] = r["v"]
    sent = spark.sparkContext.broadcast({w: (np.array(list(rows)), np.array(list(rows.values()), np.int64).reshape(len(rows), w)) for w, rows in probe.items()})
    lowest = np.iinfo(np.int64).min

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, widths = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            out = np.full(len(rows), lowest)
            for w in np.unique(widths):
                own = np.flatnonzero(widths == w)
                p_rows, p = sent.value.get(int(w), (np.zeros(0, np.int64), np.zeros((0, int(w)), np.int64)))
                if len(p_rows) <= k:
                    continue
                score = products(matrix(batch.column(2).take(pa.array(own)), int(w)), p)
                score[rows[own][:, None] == p_rows[None, :]] = lowest
                out[own] = np.partition(score, len(p_rows) - k, axis=1)[:, len(p_rows) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "threshold"])

    kinds = "row long, vec_id long, v array<long>, width int, norm double"
    bounded = stored(queries.select("row", "vec_id", "v", "width", "norm").mapInArrow(bounds, f"{kinds}, threshold long"))
    m = bounded.count()
    # Buckets of about ``block`` rows: quantiles of length, and parts of those that many rows share.
    steps = max(1, -(-n // block))
    edges = candidates.approxQuantile("norm", [i / steps for i in range(1, steps)], 0.2 / steps) if steps > 1 else []
    band = lambda c: F.array_size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e <= c))
    banded = candidates.withColumn("band", band(F.col("norm")))
    sizes = banded.groupBy("width", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    buckets = stored(sizes.select(F.col("width"), "band", "longest", "parts"))
    blocks = max(1, -(-m // block))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    right = banded.join(F.broadcast(buckets), ["width", "band"]) if steps <= 100_000 else banded.join(buckets, ["width", "band"])
    right = right.select("row", "vec_id", "v", "width", "band", part.alias("part"), every.alias("block"))
    reach = (F.col("threshold") <= F.col("norm") * F.col("longest") * (1 + SLACK)) | (F.col("threshold") <= 0)
    left = bounded.join(F.broadcast(buckets) if steps <= 100_000 else buckets, "width").filter(reach)
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("row", "vec_id", "v", "width", "band", "part", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "threshold")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])
        if not a.num_rows or not b.num_rows:
            return kind.empty_table()
        a, b, w = a.combine_chunks(), b.combine_chunks(), a["width"][0].as_py()
        own = lambda t, c: t[c].combine_chunks()
        bucket = Bucket(own(b, "row").to_numpy(), _no_id(own(b, "vec_id")), matrix(own(b, "v"), w))
        at, where, score, _ = search(own(a, "row").to_numpy(), matrix(own(a, "v"), w), own(a, "threshold").to_numpy(), bucket, k)
        at, where = np.array(at, np.int64), np.array(where, np.int64)
        ids = bucket.ids[where]
        found = pa.array(ids, mask=ids == np.iinfo(np.int64).max)
        return pa.Table.from_arrays([own(a, "row").take(pa.array(at)), own(a, "vec_id").take(pa.array(at)), found, pa.array(np.array(score, np.int64))], schema=kind)

    keys = ["width", "band", "part", "block"]
    left = left.toDF(*left.columns)  # columns of their own, as both sides come from one table
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("row", "vec_id", "rank", "found", "score")
