"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

*Sets.* A document's set holds the 64-bit hashes of its distinct word n-grams (A-Z lower-cased). Equal sets
are one node from here on, named by a 64-bit digest of the set.
*Tiles.* Sizes fall into bands whose ends are 1/t apart, so partners lie in the same or in neighbouring bands.
For a pair of bands the symmetric difference of partners is at most H = (1-t)/(1+t) * (a+b). Hash space is cut
into H + 1 + m slices, so partners agree in at least m + 1 of them. Every set orders its slices by one rule that
looks at a slice's content alone and leaves out the last m: the best slice that two partners agree in has at most
H before it, so neither leaves it out. The rule prefers slices with many n-grams that are not ``popular``. A tile is
(band, slice, content); all partners share one, and documents that merely share a passage hardly ever do.
``popular`` n-grams are those that repeat among a bounded sample of ``sample`` sets. They sort slices and decide
nothing else: whatever the sample holds, no link is lost.
*Meetings.* Tiles with the same members are one group. First every node meets the first member of the groups it
shares most with, which joins large families of near copies in a number of comparisons linear in their size. Then
groups that still hold several components are compared in full. A meeting compares blocks of bounded size in one
task: sizes and bitmaps rule pairs out, members without a possible partner leave, and for the rest the sorted
arrays are intersected. Only links that join two components of a meeting come out, fewer than it has members.

The result is exact up to collisions of 64-bit hashes. No caps: groups larger than a block are worked off in pairs
of blocks, so a family of documents that are all similar but below the threshold costs comparisons that grow
with the square of its size; they are matrix products, and their rows never leave a task. A null text or one
without words has an empty set and no links; fewer words than n are one n-gram. Repeated ids link by their texts
like any others. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.llm.common import pieces, stored, unused
from attest.llm.graph import components
from attest.llm.hashing import BASE, SIGNS, SPACE, mix64, text_bytes, word_hashes

#: One slice in so many more than a set names is left out.
LEFT_OUT = 4
#: Rows of one tile that are held in memory; longer tiles go out in pieces.
HELD = 100_000


class Sets:
    """Sorted distinct n-gram hashes of several texts, end to end, with the offsets of each text's own."""

    def __init__(self, texts: pa.Array, n: int):
        data, at = text_bytes(pc.ascii_lower(texts))
        if not len(data):
            self.grams, self.offsets = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
            return
        words, cuts = word_hashes(data, at, SPACE)
        grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n):
            grams = mix64(grams + words[k : k + len(grams)] * SIGNS[k])
        pieces = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo >= n:
                own = grams[lo : hi - n + 1].copy()
                own.sort()
                pieces.append(own)
            elif hi > lo:  # fewer words than n: the whole sequence
                whole = np.array([hi - lo], np.uint64)
                for w in words[lo:hi]:
                    whole = mix64(whole * BASE + w)
                pieces.append(whole)
            else:
                pieces.append(grams[:0])
        flat = np.concatenate(pieces)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        fresh = np.ones(len(flat) + 1, bool)
        fresh[1:-1] = flat[1:] != flat[:-1]
        fresh[offsets] = True
        fresh = fresh[:-1]
        self.grams = flat[fresh]
        self.offsets = np.concatenate(([0], np.cumsum(fresh)))[offsets]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def of(self, i: int) -> np.ndarray:
        return self.grams[self.offsets[i] : self.offsets[i + 1]]

    def digests(self) -> np.ndarray:
        """Names of the sets; the empty set's is 0."""
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(self.grams * BASE + np.uint64(7)), dtype=np.uint64)))
        own = total[self.offsets[1:]] - total[self.offsets[:-1]]
        return np.where(self.sizes > 0, mix64(own + self.sizes.astype(np.uint64)).view(np.int64), 0)

    def bitmaps(self) -> list[bytes]:
        """A bitmap of 4 to 8 bits per member (8 to 16 for sets under 512), a power of two, so that bitmaps of
        different lengths fold onto each other."""
        sizes = self.sizes
        width = np.maximum(64, np.where(sizes < 512, 8, 4) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        ends = np.cumsum(width)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        bits[(ends - width)[owner] + (self.grams & (width - 1).astype(np.uint64)[owner]).astype(np.int64)] = 1
        packed = np.packbits(bits, bitorder="little")
        return [packed[lo // 8 : hi // 8].tobytes() for lo, hi in zip((ends - width).tolist(), ends.tolist(), strict=True)]

    def only(self, keep: np.ndarray) -> Sets:
        """The sets at the given places."""
        out = object.__new__(Sets)
        out.offsets = np.concatenate(([0], np.cumsum(self.sizes[keep])))
        out.grams = np.concatenate([self.of(i) for i in keep.tolist()]) if len(keep) else self.grams[:0]
        return out


def chunked(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of about ``size`` bytes, so that the arrays of a piece stay in the cache."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


class Bands:
    """Bands of sizes for a threshold of ``percent``: [1..1], [2..2], ... each ends at floor(first / t). For pairs whose
    larger set lies in a band, the smaller in it or in the one before: ``slices`` of hash space and the ``quota`` of
    them that a set names (0 where partners must be equal)."""

    def __init__(self, percent: int, longest: int = 1 << 26):
        firsts = [1]
        while firsts[-1] <= longest:
            firsts.append(firsts[-1] * 100 // percent + 1)
        self.firsts = np.array(firsts)
        high = np.append(self.firsts[1:], self.firsts[-1] * 100 // percent + 1) - 1
        differ = 2 * high * (100 - percent) // (100 + percent)
        self.quota = np.where(differ > 0, differ + 1, 0)
        self.slices = self.quota + -(-self.quota // LEFT_OUT)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, sizes, side="right") - 1


def tiles(sets: Sets, bands: Bands, popular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile names of the sets, for their own bands and the next, and the place of each name's set. popular: sorted."""
    sizes = sets.sizes
    names, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(sets.grams):
        return names[0].view(np.int64), owners[0]
    place = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix64(sets.grams + np.uint64(11))
    own = np.ones(len(mixed), np.int64)
    if len(popular):
        own = (popular[np.minimum(np.searchsorted(popular, sets.grams), len(popular) - 1)] != sets.grams).astype(np.int64)
    for step in (0, 1):
        band = bands.of(np.maximum(sizes, 1)) + step
        k, quota = bands.slices[band], np.where(sizes > 0, bands.quota[band], 0)
        salt = (band + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        where = (sets.grams >> np.uint64(32)) * k[place].astype(np.uint64) >> np.uint64(32)  # sorted within a set, as the hashes are
        fresh = np.ones(len(where), bool)
        fresh[1:] = (where[1:] != where[:-1]) | (place[1:] != place[:-1])
        starts = np.flatnonzero(fresh)
        owner = place[starts]
        name = mix64(np.add.reduceat(mixed, starts) * BASE + mix64(where[starts] + salt[owner]))
        # Best first: n-grams of its own, then n-grams, then by name.
        rank = np.minimum(np.add.reduceat(own, starts), 255) * 256 + np.minimum(np.diff(np.append(starts, len(where))), 255)
        order = np.argsort(owner.astype(np.uint64) << np.uint64(48) | (65535 - rank).astype(np.uint64) << np.uint64(32) | name >> np.uint64(32), kind="stable")
        filled = np.bincount(owner, minlength=len(sizes))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        keep = order[nth < quota[owner[order]]]
        names.append(name[keep])
        owners.append(owner[keep])
        for i in np.flatnonzero(filled < quota):  # empty slices come last
            none = np.setdiff1d(np.arange(k[i], dtype=np.uint64), where[starts[owner == i]])[: quota[i] - filled[i]]
            names.append(mix64(mix64(none + salt[i]) + np.uint64(13)))
            owners.append(np.full(len(none), i))
    return np.concatenate(names).view(np.int64), np.concatenate(owners)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _nodes(rows: DataFrame, n: int) -> DataFrame:
    """(id, size, node, bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for at, texts in chunked(batch.column(1)):
                sets = Sets(texts, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets.sizes), pa.array(sets.digests()), pa.array(sets.bitmaps(), pa.binary())], ["id", "size", "node", "bits"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, size long, node long, bits binary")


def _fresh(nodes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of nodes that were not seen yet (0, the empty set, never counts)."""
    keep = []
    for i, node in enumerate(nodes.tolist()):
        if node and node not in seen:
            seen.add(node)
            keep.append(i)
    return np.array(keep, np.int64)


def _popular(rows: DataFrame, n: int, unique: DataFrame, few: int, sample: int, least: int = 4, entries: int = 200_000) -> np.ndarray:
    """The n-grams (at most ``entries``, the commonest) that at least ``least`` of about ``sample`` distinct sets hold."""
    share = min(1.0, sample / max(1, unique.count()))
    some = unique.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, _, keep in _each_once(batches, n):
            grams, counts = np.unique(sets.only(keep).grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], ["gram", "n"])

    counts = _read_again(rows, some, unique, few).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    common = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(entries).collect()
    return np.sort(np.array([r["gram"] for r in common], np.int64).view(np.uint64))


def _each_once(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[Sets, np.ndarray, np.ndarray]]:
    """(sets, nodes, places of the nodes new to this task) of the texts in the first column, piece by piece."""
    seen: set[int] = set()
    for batch in pieces(batches):
        for _, texts in chunked(batch.column(0)):
            sets = Sets(texts, n)
            nodes = sets.digests()
            yield sets, nodes, _fresh(nodes, seen)


def _tiled(rows: DataFrame, n: int, bands: Bands, popular: np.ndarray) -> DataFrame:
    """(tile, node), once per task for each node."""
    shared = rows.sparkSession.sparkContext.broadcast(popular)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, nodes, keep in _each_once(batches, n):
            names, owners = tiles(sets.only(keep), bands, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(nodes[keep][owners])], ["tile", "node"])

    return rows.select("text").mapInArrow(run, "tile long, node long")


def _shared(tiled: DataFrame) -> DataFrame:
    """(tile, node, lead) of tiles with more than one node; lead is the tile's first node. Tiles with the same members
    are one, named by them; those too long for a batch keep their own names."""
    spread = tiled.repartition("tile").sortWithinPartitions("tile", "node")

    def emit(tile: np.ndarray, node: np.ndarray, first: int | None, open_: bool) -> Iterator[pa.RecordBatch]:
        """first: the first node of the tile that runs over from earlier batches; open_: the last tile may go on."""
        if not len(tile):
            return
        start = np.concatenate(([True], tile[1:] != tile[:-1]))
        fresh = start.copy()
        fresh[1:] |= node[1:] != node[:-1]
        if first is not None and node[0] == first:
            fresh[0] = False
        head = np.flatnonzero(start)
        lead, members = node[head].copy(), np.add.reduceat(fresh.astype(np.int64), head)
        name = mix64(np.add.reduceat(np.where(fresh, mix64(node.view(np.uint64) + np.uint64(17)), np.uint64(0)), head) + members.astype(np.uint64)).view(np.int64)
        if first is not None:
            lead[0], name[0] = first, tile[0]
        several = members > 1
        if first is not None:
            several[0] = True
        if open_:
            name[-1], several[-1] = tile[-1], True
        group = np.cumsum(start) - 1
        keep = several[group] & fresh
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(name[group[keep]]), pa.array(node[keep]), pa.array(lead[group[keep]])], ["tile", "node", "lead"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
                held = []
        if held:
            yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the last tile back, up to ``HELD`` rows of it; a longer one goes out in pieces."""
        tile, node, first, of = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
        for more in joined(batches):
            tile, node = np.concatenate((tile, more[0])), np.concatenate((node, more[1]))
            if not len(tile):
                continue
            if tile[0] != of:
                first = None
            last = int(np.searchsorted(tile, tile[-1]))
            if last:
                yield from emit(tile[:last], node[:last], first, False)
                tile, node, first = tile[last:], node[last:], None
            if len(tile) > HELD:
                yield from emit(tile, node, first, True)
                tile, node, first, of = tile[:0], node[:0], int(node[0]) if first is None else first, int(tile[0])
        yield from emit(tile, node, first, False)

    return spread.mapInArrow(run, "tile long, node long, lead long").groupBy("tile", "node", "lead").agg(F.count("*").alias("n"))


def _known(table: DataFrame, few: int) -> DataFrame:
    """Broadcast if it has at most ``few`` rows (of a few numbers), else left to a shuffle."""
    return F.broadcast(table) if table.count() <= few else table


def _read_again(rows: DataFrame, wanted: DataFrame, unique: DataFrame, few: int) -> DataFrame:
    """Texts for the nodes of ``wanted``: of every node the documents with its least id, so texts of other nodes may
    come along, and the same text several times."""
    ids = stored(unique.join(_known(wanted, few), "node", "left_semi").select(F.col("least").alias("wanted")).distinct())
    return rows.join(_known(ids, few), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")


def _sets_of(rows: DataFrame, n: int, wanted: DataFrame, unique: DataFrame, few: int) -> DataFrame:
    """(node, grams) for the nodes of ``wanted``, and perhaps for others or several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, nodes, keep in _each_once(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array([sets.of(i).tobytes() for i in keep.tolist()], pa.binary())], ["node", "grams"])

    return _read_again(rows, wanted, unique, few).mapInArrow(run, "node long, grams binary")


class Bitmaps:
    """Bitmaps of several sets, side by side for each width; wider ones are folded when they meet narrower ones."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes], percent: int):
        self.sizes, self.bits, self.percent = sizes, bits, percent
        self.width = np.array([len(b) // 8 for b in bits], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps of this width, with those twice and four times as wide folded to it; their rows; their
        bit counts."""
        if width not in self.folded:
            row = np.full(len(self.bits), -1, np.int64)
            own = np.flatnonzero((self.width >= width) & (self.width <= 4 * width))
            row[own] = np.arange(len(own))
            table = np.stack([fold(np.frombuffer(self.bits[i], np.uint64), width) for i in own.tolist()])
            self.folded[width] = table, row, np.bitwise_count(table).sum(axis=1, dtype=np.int64)
        return self.folded[width]

    @staticmethod
    def _pieces(ok: np.ndarray, least: np.ndarray, words: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs of one width at a time, few enough that their bitmaps take 4 MB a side."""
        for width in np.unique(least[ok]).tolist():
            some = np.flatnonzero(ok & (least == width))
            step = max(1, words // width)
            for at in range(0, len(some), step):
                yield width, some[at : at + step]

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that sizes and bitmaps do not rule out. A bit set in one bitmap alone is a member of that set
        that the other lacks, so the overlap is at most the size less such bits."""
        a, b = self.sizes[x], self.sizes[y]
        ok = np.minimum(a, b) * 100 >= np.maximum(a, b) * self.percent
        least = np.minimum(self.width[x], self.width[y])
        for width, some in self._pieces(ok, least):
            table, row, counts = self.at(width)
            left, right = row[x[some]], row[y[some]]
            common = np.bitwise_count(table[left] & table[right]).sum(axis=1, dtype=np.int64)
            most = np.minimum(a[some] - counts[left], b[some] - counts[right]) + common
            ok[some] = 100 * most >= self.percent * (a[some] + b[some] - most)
        return ok


def fold(bits: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, length), axis=0) if len(bits) > length else bits


def pairs_across(group: np.ndarray, root: np.ndarray, side: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in one group, of different roots and of sizes that could link; rows are sorted by group
    and size. side: 0 for members of a block that meets itself, else 1 or 2, and 1 meets 2 only. One array step
    per distance within a group; a row whose partner is too large has only larger ones further on."""
    distance, alive = 1, np.arange(len(group))
    while True:
        alive = alive[alive + distance < len(group)]
        alive = alive[(group[alive] == group[alive + distance]) & (size[alive] * 100 >= size[alive + distance] * percent)]
        if not len(alive):
            return
        x, y = alive, alive + distance
        ok = (root[x] != root[y]) & ((side[x] == 0) | (side[x] != side[y]))
        if ok.any():
            yield x[ok], y[ok]
        distance += 1


def _stars(live: DataFrame) -> DataFrame:
    """(node, lead): of every node the first member that it shares most tiles with."""
    shared = live.filter("node <> lead").groupBy("node", "lead").agg(F.sum("n").alias("n"))
    return shared.groupBy("node").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))


def _star_meetings(stars: DataFrame, sizes: DataFrame, block: int, room: int, few: int) -> DataFrame:
    """meetings(meeting, side, node, root, size) of every node with its lead; a lead that is many nodes' comes to
    one meeting for each block of them."""
    sized = stars.join(sizes, "node")
    blocks = stored(sized.groupBy("lead").agg(_blocks(block, room).alias("blocks")))
    name = F.xxhash64("lead", "mine")
    nodes = sized.join(_known(blocks, few), "lead").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    leads = blocks.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes.withColumnRenamed("node", "lead"), "lead")
    return nodes.select(name.alias("meeting"), F.lit(1).alias("side"), "node", F.col("node").alias("root"), "size").unionByName(
        leads.select(name.alias("meeting"), F.lit(2).alias("side"), F.col("lead").alias("node"), F.col("lead").alias("root"), "size"))


def _blocks(block: int, room: int) -> Column:
    """Blocks of about ``block`` members and ``room`` n-grams for the rows of a group with column ``size``."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum("size") / room)).cast("int")


def _group_meetings(live: DataFrame, roots: DataFrame, stars: DataFrame, sizes: DataFrame, block: int, room: int, few: int) -> DataFrame:
    """meetings(meeting, side, node, root, size) of the tiles that hold several components. Tiles with the same first
    member are taken together under its name, so that a node comes once however many of those tiles it is in. Each
    group is cut into blocks; a block meets itself and every other block of its group. A group of two that have met
    as node and lead is left out."""
    known = live.join(_known(roots, few), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = stored(known.groupBy("tile").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("tile"))
    members = known.join(_known(mixed, few), "tile", "left_semi").select("lead", "node", "root").distinct()
    members = members.join(stars.withColumnRenamed("lead", "met"), "node", "left").join(sizes, "node")
    members = stored(members.select("lead", "node", "root", "size", (F.col("met") == F.col("lead")).alias("met")))
    cut = members.groupBy("lead").agg(_blocks(block, room).alias("blocks"), F.count("*").alias("n"), F.coalesce(F.bool_or("met"), F.lit(False)).alias("met"))
    cut = stored(cut.filter("not (n = 2 and met)").select("lead", "blocks"))
    mine = members.join(_known(cut, few), "lead").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(i == j, 0).when(F.col("mine") == i, 1).otherwise(2)
    return dealt.select(F.xxhash64("lead", i, j).alias("meeting"), side.alias("side"), "node", "root", "size")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which every meeting (the first column, sorted) is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        meeting = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != meeting[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _hopeful(meetings: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The rows of the meetings that have a partner whom sizes and bitmaps do not rule out."""
    gathered = meetings.join(bits, "node").select("meeting", "side", "node", "root", "size", "bits")
    gathered = gathered.repartition("meeting").sortWithinPartitions("meeting", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            group, side, _, root, size = (t.column(c).to_numpy() for c in range(5))
            bitmaps = Bitmaps(size, t.column(5).to_pylist(), percent)
            hope = np.zeros(len(group), bool)
            for x, y in pairs_across(group, root, side, size, percent):
                ok = bitmaps.may_link(x, y)
                hope[x[ok]] = hope[y[ok]] = True
            if hope.any():
                yield from t.select(range(5)).filter(pa.array(hope)).combine_chunks().to_batches()

    return gathered.mapInArrow(run, meetings.schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sorted distinct arrays, as products of their 0/1 matrix."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]  # what one set alone holds is in no intersection
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, step = np.zeros((len(sets), len(sets)), np.float32), 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        some = np.zeros((len(sets), step), np.float32)
        some[row[lo:hi], column[lo:hi] - at] = 1
        out += some @ some.T
    return out.astype(np.int64)  # exact: sets hold fewer than 2^24 n-grams, see links


def links(node: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs (x, y) that join components of one meeting, fewer than its members."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent.setdefault(parent[i], parent[i])
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b:
            parent[a] = b
            out.append((int(node[i]), int(node[j])))

    used = np.unique(np.concatenate((x, y)))
    if len(x) > 2 * len(used) and max(len(sets[i]) for i in used.tolist()) < 1 << 24:  # float32 counts exactly up to there
        place = np.zeros(len(node), np.int64)
        place[used] = np.arange(len(used))
        size = np.array([len(sets[i]) for i in used.tolist()])
        both = overlaps([sets[i] for i in used.tolist()])[place[x], place[y]]
        ok = 100 * both >= percent * (size[place[x]] + size[place[y]] - both)
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            join(i, j)
    else:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if find(int(root[i])) != find(int(root[j])) and linked(sets[i], sets[j], percent):
                join(i, j)
    return out


def _links(hopeful: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a meeting; the sorted arrays are intersected inside it."""
    gathered = hopeful.join(sets, "node").select("meeting", "side", "node", "root", "size", "grams")
    gathered = gathered.repartition("meeting").sortWithinPartitions("meeting", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            group, side, node, root, size = (t.column(c).to_numpy() for c in range(5))
            sets = [np.frombuffer(g.as_buffer(), np.uint64) for chunk in t.column(5).chunks for g in chunk]
            pairs = list(pairs_across(group, root, side, size, percent))
            if not pairs:
                continue
            x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            order = np.argsort(x, kind="stable")  # rows are sorted by meeting
            x, y = x[order], y[order]
            ends = np.flatnonzero(np.diff(group[x])) + 1
            found = [e for xs, ys in zip(np.split(x, ends), np.split(y, ends), strict=True) for e in links(node, root, side, sets, xs, ys, percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return gathered.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, few: int, block: int, room: int = 1 << 20, sample: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """nodes(id, size, node, bits) of every row, and (node, least, root) of every node: its smallest id (null if
    none has one) and its component."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nodes = stored(_nodes(rows, n))
    filled = nodes.filter("size > 0")
    unique = stored(filled.groupBy("node").agg(F.min("size").alias("size"), F.min("id").alias("least")))
    sizes = unique.select("node", "size")
    live = stored(_shared(_tiled(rows, n, Bands(percent), _popular(rows, n, unique, few, sample))))
    bits = stored(filled.select("node", "bits").join(_known(live.select("node").distinct(), few), "node", "left_semi").dropDuplicates(["node"]))

    def meet(meetings: DataFrame) -> DataFrame:
        hopeful = stored(_hopeful(meetings, bits, percent))
        return stored(_links(hopeful, _sets_of(rows, n, hopeful.select("node").distinct(), unique, few), percent))

    stars = stored(_stars(live))
    edges = meet(_star_meetings(stars, sizes, block, room, few))
    roots = components(edges)
    found = meet(_group_meetings(live, roots, stars, sizes, block, room, few))
    if found.take(1):
        roots = components(edges.unionByName(found))
    smallest = unique.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return nodes, smallest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, few: int = 200_000, block: int = 1_000) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links reach, the row's own included."""
    nodes, smallest = _grouped(docs, id_col, text_col, n, percent, few, block)
    names = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    named = smallest.join(names, "root").select("node", "component_id")
    linked_rows = nodes.filter("size > 0").join(named, "node").select("id", "size", "component_id")
    empty = nodes.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return linked_rows.unionByName(empty).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def _with_nodes(docs: DataFrame, text_col: str, n: int, name: str) -> DataFrame:
    """The rows, all columns, and the node of each text under ``name``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes = [Sets(pc.fill_null(piece, ""), n).digests() for _, piece in chunked(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, few: int = 200_000) -> DataFrame:
    """The documents, all columns, one of each group: the one with the smallest id (null last), then the smallest
    node. Rows that share both id and set are one document; other texts under a repeated id, or under none, are
    documents of their own. A text without words is no copy, so without an id each such row stays.

    Where an id is one row's alone it tells whether the row goes; only rows of repeated or null ids are read
    again for their nodes."""
    nodes, smallest = _grouped(docs, id_col, text_col, n, percent, few, 1_000)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    stays = stored(smallest.groupBy("root").agg(first.alias("first")).select("first.node", "first.least", F.lit(True).alias("named")))
    own = F.col("named").isNotNull() & F.col("id").eqNullSafe(F.col("least"))
    judged = nodes.select("id", "size", "node").join(stays, "node", "left").select("id", ((F.col("size") == 0) | own).alias("stays"))
    by_id = stored(judged.groupBy("id").agg(F.count("*").alias("n"), F.min("stays").alias("stays")).filter("id is null or n > 1 or not stays"))
    mine, pick, least, node = unused(docs, "id_", "pick_", "least_", "node_")
    alone, again = (by_id.filter(f"id is not null and {n}").select(F.col("id").alias(mine)) for n in ("n = 1", "n > 1"))
    same = F.col(id_col) == F.col(mine)
    left = docs.join(_known(alone, few), same, "left_anti")
    repeats, nulls = bool(again.take(1)), bool(by_id.filter("id is null").take(1))
    if not repeats and not nulls:
        return left
    again = _known(again, few)
    left = left.filter(F.col(id_col).isNotNull()).join(again, same, "left_anti")
    doubtful = docs.filter(F.col(id_col).isNull()).unionByName(docs.filter(F.col(id_col).isNotNull()).join(again, same, "left_semi"))
    doubtful = _with_nodes(doubtful, text_col, n, node)
    picks = _known(stays.select(F.col("node").alias(pick), F.col("least").alias(least)), few)
    filled = doubtful.filter(F.col(node) != 0).join(picks, (F.col(node) == F.col(pick)) & F.col(id_col).eqNullSafe(F.col(least)), "left_semi")
    empty = doubtful.filter(F.col(node) == 0)
    one = filled.unionByName(empty.filter(F.col(id_col).isNotNull())).dropDuplicates([id_col, node])
    return left.unionByName(one.unionByName(empty.filter(F.col(id_col).isNull())).drop(node))
