"""Vectors in cells around pivots, so that far pairs are never compared.

Angles between vectors obey the triangle inequality. Each vector belongs to the cell of its nearest pivot; a query can only
find something within an angle t in a cell whose pivot is at most t plus the cell's radius away, and t plus twice the
query's distance to its own pivot; inside the cell only among members whose angle to the pivot differs from the query's by
at most t. What is left out can't be near enough: the results are exact.

Pivots are drawn by hash, the square root of the number of vectors, at most ``MOST``; they and their radii go to every
task. Neighbouring cells are packed into groups of a block of members, a larger cell is cut over several; a query is
copied once for each group that it looks into, with a bit for each cell, so where pivots tell nothing it is copied as often as
there are blocks, not cells. Groups meet blocks of queries pairwise, so no task gathers more than two blocks. Vectors
of different lengths, and zero vectors, are cells apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.sources.shared import stored

#: Vectors of a block, numbers in a block, and pivots at most.
BLOCK, NUMBERS, MOST = 16_384, 1 << 20, 1_024
#: Angles are known to about 1e-8.
SLACK = 1e-6
ROWS = "id long, v array<double>, width int, cell int, angle double"
VISITS = "id long, v array<double>, width int, grp int, block int, cells binary, reach double"


def as_rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)

#: (limits, angles, least angles, sizes of cells) -> (chosen cells, reach), see ``meet``.
Choice = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Cells:
    """Pivots by width, and once the vectors have been placed the radius and size of each cell and the cells of each group."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius: dict[int, np.ndarray] = {}
        self.size: dict[int, np.ndarray] = {}
        self.groups: dict[int, list[np.ndarray]] = {}

    def block(self, width: int) -> int:
        """Rows of a block: small tables are cut too, for the sake of more tasks."""
        n = int(self.size[width].sum())
        return max(1, min(BLOCK, NUMBERS // max(width, 1), max(1_024, -(-n // 8))))

    def _chain(self, width: int) -> list[int]:
        """Cells in an order in which neighbours follow one another."""
        p = self.pivots.get(width)
        if p is None:
            return [0]
        near, at, order = p @ p.T, 0, [0]
        near[:, 0] = -np.inf
        for _ in range(len(p) - 1):
            at = int(near[at].argmax())
            near[:, at] = -np.inf
            order.append(at)
        return [*order, len(p)]

    def pack(self) -> list[tuple[int, int, int, int]]:
        """(width, cell, its first group, its groups) of each cell that isn't empty."""
        out = []
        for width, size in self.size.items():
            block, groups, room = self.block(width), [], 0
            for cell in self._chain(width):
                n = int(size[cell])
                if n > block:
                    out.append((width, cell, len(groups), -(-n // block)))
                    groups += [[cell]] * -(-n // block)
                    room = 0
                elif n:
                    if n > room:
                        groups.append([])
                        room = block
                    groups[-1].append(cell)
                    room -= n
                    out.append((width, cell, len(groups) - 1, 1))
            self.groups[width] = [np.array(g) for g in groups]
        return out

    def angles(self, v: np.ndarray) -> np.ndarray:
        """To each pivot; the last column is the cell of vectors without an angle."""
        p = self.pivots.get(v.shape[1])
        own = np.arccos(np.clip(v @ p.T, -1, 1)) if p is not None else np.zeros((len(v), 0))
        return np.hstack([own, np.full((len(v), 1), np.pi / 2)])

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = self.angles(v)
        flat = ~(v != 0).any(axis=1)
        cell = np.where(flat | (angle.shape[1] == 1), angle.shape[1] - 1, angle[:, :-1].argmin(axis=1) if angle.shape[1] > 1 else 0)
        return cell, angle[np.arange(len(v)), cell]

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(angle to each pivot, least angle that a member of its cell can have); empty cells are beyond all."""
        angle, width = self.angles(v), v.shape[1]
        none = np.zeros(angle.shape[1])
        least = np.maximum(angle - self.radius.get(width, none), 0)
        if angle.shape[1] > 1:
            least[:, :-1] = np.maximum(least[:, :-1], (angle[:, :-1] - angle[:, :-1].min(axis=1, keepdims=True)) / 2)
        # A vector without an angle has the product 0 with all, so its cell is a right angle away.
        least[:, -1] = np.pi / 2
        least[~(v != 0).any(axis=1)] = np.pi / 2
        return angle, np.where(self.size.get(width, none) > 0, np.maximum(least - SLACK, 0), np.inf)


def draw(vectors: DataFrame, n: int) -> Cells:
    """Pivots out of (id, v)."""
    few = int(min(MOST, max(1, round(n**0.5))))
    chosen = vectors.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(few).collect()
    by_width: dict[int, list] = {}
    for r in chosen:
        by_width.setdefault(len(r["v"]), []).append(r["v"])
    return Cells({w: np.array(x) for w, x in by_width.items()})


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each width in a batch (id, v, ...)."""
    widths = np.diff(batch.column(1).offsets.to_numpy())
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, as_rows(batch.column(1).take(pa.array(at)), int(w))


def placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(id, v) in its cell and group; ``cells`` learns radii, sizes and groups."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _by_width(batch):
                cell, angle = sent.value.nearest(v)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(at), v.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "width", "cell", "angle"])

    rows = stored(vectors.select("id", "v").mapInArrow(run, ROWS))
    for r in rows.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toLocalIterator():
        many = len(cells.pivots.get(r["width"], ())) + 1
        cells.radius.setdefault(r["width"], np.zeros(many))[r["cell"]] = r["radius"]
        cells.size.setdefault(r["width"], np.zeros(many))[r["cell"]] = r["n"]
    packed = spark.createDataFrame(cells.pack(), "width int, cell int, first int, groups int")  # a row a cell, MOST a width
    group = F.col("first") + F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
    return rows.join(F.broadcast(packed), ["width", "cell"]).withColumn("grp", group).drop("first", "groups")


def _visits(queries: DataFrame, cells: Cells, choose: Choice, blocks: dict[tuple[int, int], int] | None) -> DataFrame:
    """A row for each query and group that it looks into, or without ``blocks`` the number of those of each group.

    A few queries at a time: what a task holds doesn't grow with the number of cells that they visit."""
    sent = queries.sparkSession.sparkContext.broadcast((cells, blocks))

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = sent.value[0]
        for batch in batches:
            for places, vectors in _by_width(batch):
                width = vectors.shape[1]
                for s in range(0, len(places) if known.groups.get(width) else 0, 256):
                    own, v = batch.take(pa.array(places[s : s + 256])), vectors[s : s + 256]
                    angle, least = known.bounds(v)
                    chosen, reach = choose(own.column(2).to_numpy(zero_copy_only=False), angle, least, known.size[width])
                    chosen = chosen & np.isfinite(least)
                    for g, held in enumerate(known.groups[width]):
                        cut = chosen[:, held]
                        row = np.flatnonzero(cut.any(axis=1))
                        if len(row):
                            yield own, width, g, row, cut, reach

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for _, width, g, row, _, _ in looked(batches):
            found[width, g] = found.get((width, g), 0) + len(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int32()), pa.array([g for _, g in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["width", "grp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, width, g, row, cut, reach in looked(batches):
            picked = own.take(pa.array(row))
            mixed = picked.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            block = (mixed >> np.uint64(33)).astype(np.int64) % sent.value[1][width, g]
            bits = [x.tobytes() for x in np.packbits(cut[row], axis=1)]
            same = lambda x: pa.array(np.full(len(row), x, np.int32))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), same(width), same(g), pa.array(block.astype(np.int32)), pa.array(bits, pa.binary()), pa.array(reach[row])], ["id", "v", "width", "grp", "block", "cells", "reach"])

    rows = queries.select("id", "v", "limit")
    return rows.mapInArrow(count, "width int, grp int, n long") if blocks is None else rows.mapInArrow(run, VISITS)


def _first(i: np.ndarray, other: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` rows of each i, by score, ties by id."""
    order = np.lexsort((other, -score, i))
    i = i[order]
    began = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    at = np.arange(len(i)) - np.repeat(began, np.diff(np.r_[began, len(i)]))
    return order[at < top]


def meet(members: DataFrame, queries: DataFrame, cells: Cells, choose: Choice, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], top: int, compared: Accumulator | None = None, together: int = 256) -> DataFrame:
    """(id, other, score) of the members that ``pick``(products, query ids, member ids) chooses for queries (id, v, limit), from
    those within reach; of each query and pair of blocks the ``top`` best, ties by id. choose(limits, angles, least angles,
    sizes): which cells, and how far each query reaches in them."""
    spark = queries.sparkSession
    counts = _visits(queries, cells, choose, None).groupBy("width", "grp").agg(F.sum("n").alias("n")).collect()  # a row a group
    blocks = {(r["width"], r["grp"]): -(-r["n"] // cells.block(r["width"])) for r in counts}
    cut = spark.createDataFrame([(*k, n) for k, n in blocks.items()], "width int, grp int, blocks int")
    own = members.join(F.broadcast(cut), ["width", "grp"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    other = _visits(queries, cells, choose, blocks)
    kind = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])
    sent = spark.sparkContext.broadcast(cells)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kind.empty_table()
        a, b, w = a.combine_chunks(), b.sort_by([("cell", "ascending"), ("angle", "ascending")]).combine_chunks(), a["width"][0].as_py()
        read = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        q_id, q, reach = read(a, "id"), as_rows(a["v"].combine_chunks(), w), read(a, "reach")
        m_id, m, m_cell, m_angle = read(b, "id"), as_rows(b["v"].combine_chunks(), w), read(b, "cell"), read(b, "angle")
        held = sent.value.groups[w][a["grp"][0].as_py()]
        bits = np.frombuffer(b"".join(a["cells"].to_pylist()), np.uint8).reshape(len(q_id), -1)
        pivots = sent.value.pivots.get(w)
        apart = 0 if pivots is None else len(pivots)
        flat = ~(q != 0).any(axis=1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        some = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, o, score = (np.concatenate(c) for c in zip(*out, strict=True))
            kept = _first(i, o, score, top)
            return i[kept], o[kept], score[kept]

        for k, cell in enumerate(held):
            lo, hi = np.searchsorted(m_cell, [cell, cell + 1])
            visitors = np.flatnonzero(bits[:, k // 8] >> (7 - k % 8) & 1)
            if lo == hi or not len(visitors):
                continue
            # Zero vectors, and the cell of such, know no window of angles.
            angle = np.full(len(visitors), np.pi / 2) if cell == apart else np.arccos(np.clip(q[visitors] @ pivots[cell], -1, 1))
            far = np.where(flat[visitors] | (cell == apart), np.inf, reach[visitors])
            order = np.argsort(angle, kind="stable")
            for s in range(0, len(order), together):
                t = order[s : s + together]
                x = lo + int(np.searchsorted(m_angle[lo:hi], (angle[t] - far[t]).min() - SLACK))
                y = lo + int(np.searchsorted(m_angle[lo:hi], (angle[t] + far[t]).max() + SLACK, side="right"))
                for z in range(x, y, 4_096):
                    e = min(y, z + 4_096)
                    score = q[visitors[t]] @ m[z:e].T
                    if compared is not None:
                        compared.add(score.size)
                    i, j = pick(score, q_id[visitors[t]], m_id[z:e])
                    out.append((visitors[t][i], m_id[z:e][j], score[i, j]))
                    some += len(i)
                    if some > 1_000_000:
                        out = [best()]
                        some = 0
        if not out:
            return kind.empty_table()
        i, o, score = best()
        return pa.Table.from_arrays([pa.array(q_id[i], pa.int64()), pa.array(o, pa.int64()), pa.array(score, pa.float64())], schema=kind)

    keys = ["width", "grp", "block"]
    return other.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, "id long, other long, score double")


def within(vectors: DataFrame, angle: float, pick, top: int, compared: Accumulator | None = None, of: DataFrame | None = None) -> DataFrame:
    """``meet`` of stored unit vectors (id, v) with one another, or of those with the vectors ``of``, at most ``angle`` apart."""
    own = vectors if of is None else of
    cells = draw(own, own.count())
    members = placed(own, cells)

    def choose(_, angles, least, sizes):
        return least <= angle, np.full(len(angles), angle)

    return meet(members, vectors.withColumn("limit", F.lit(0.0)), cells, choose, pick, top, compared)
