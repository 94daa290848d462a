"""Phrases that hang together, from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), split at punctuation into pieces and those at blanks into words; everything is counted per
language.

*Words.* One pass counts all words. Those that occur ``least`` times get numbers, the order of their 64-bit hashes; a
rarer word ends a piece, as no phrase with it can reach ``least``. That two words share a hash is told by the counts, and
another seed taken. The hashes of up to ``bound`` words (8 bytes each) go to every task; beyond that the hashes
themselves are the numbers and no word ends a piece: wider edges, the same rows.

*Edges.* The graph's nodes are sequences of four words, an edge is five words that run from a node to the next, its
weight how often they occur. A piece's last words, of which no edge starts, are edges that end early: the corrections
for ends of pieces. Edges are summed inside a task first and dealt by range, with splitters of a sample (which decides
the balance alone), so neither a hot word nor a hot pair lands in one task.

*Flow.* A node's count is what flows out of it, the weights of its edges, plus the ends there; that of its first three
words what flows out of all nodes that begin so, and so on. In sorted edges these are sums of runs, found in one pass
with one open run per order; runs that a border of partitions cuts are put together afterwards.

*Compaction.* Where an arc carries all the flow of the node it leaves or enters, the path is unary there: the shorter
phrase never occurs without the longer one and is dropped for it. ``paths`` compacts whole unary paths of edges to
passages of any length.

*Scores* are floor(1000 * a * n / (l * r)) of the worst cut, in decimals of 38 digits and whole-number division.

A null text is empty, a null language is ``und``. Repeated rows count as often as they come. An empty table gives no
phrase. Other columns are ignored. Very long texts are taken whole; what is held of them is bounded by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import hash_unit, pieces, small_batches, stored
from attest.llm.hashing import mix64, span_hashes, text_bytes, word_spans

#: Words of an edge.
ORDER = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: . , ; : ! ? and line feed to carriage return end a piece; blanks and tabs part words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 9]] = True


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, languages) of rows with about ``most`` bytes together, or one row with more."""
    held, size = [], 0
    for piece in pieces(batches, 100):
        held.append(piece)
        size += piece.column(0).nbytes
        if size >= most:
            yield tuple(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))


def _words(texts: pa.Array, langs: pa.Array, seed: int) -> tuple[np.ndarray, ...]:
    """(bytes, starts, ends, hash, piece, text) of all words; hashes tell languages apart."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, BETWEEN)
    text = np.searchsorted(offsets[1:], starts, side="right")
    piece = np.searchsorted(np.flatnonzero(ENDS[data]), starts) + text
    coded = pc.dictionary_encode(langs)
    own = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in coded.dictionary.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy()
    mixed = mix64(span_hashes(data, starts, ends, seed) ^ own[codes[text]]) if len(starts) else np.zeros(0, np.uint64)
    return data, starts, ends, mixed.view(np.int64), piece, text


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = ends - starts
    upto = np.concatenate(([0], np.cumsum(size)))
    places = np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[places])).cast(pa.string())


def count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _chunks(batches):
            data, starts, ends, h, _, text = _words(texts, langs, seed)
            if not len(h):
                continue
            own, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(text[first])), pa.array(own), _slices(data, starts[first], ends[first]), pa.array(n)], ["lang", "h", "word", "n"])

    return run


class Numbers:
    """Numbers of words, 1 and up, and their bytes; 0 for a word without one. ``known``: sorted hashes, or None where the
    hashes are the numbers."""

    def __init__(self, known: np.ndarray | None):
        self.known = known
        self.width = 8 if known is None else max(1, (len(known).bit_length() + 7) // 8)

    def of(self, h: np.ndarray) -> np.ndarray:
        if self.known is None:
            return np.where(h == 0, 1, h).view(np.uint64)
        if not len(self.known):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at + 1, 0).astype(np.uint64)

    def write(self, columns: list[np.ndarray]) -> np.ndarray:
        """One row of big-endian bytes per row of the columns."""
        out = np.empty((len(columns[0]), len(columns) * self.width), np.uint8)
        for j, c in enumerate(columns):
            for b in range(self.width):
                out[:, j * self.width + b] = (c >> np.uint64(8 * (self.width - 1 - b))).astype(np.uint8)
        return out


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each comes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return rows[order[first]], np.diff(np.append(first, n))


def edges(seed: int, numbers, splitters):
    """Each place of a text with the up to five words from there on, summed by chunk: (part, key, n). numbers, splitters:
    broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cuts = numbers.value, splitters.value
        for texts, langs in _chunks(batches):
            *_, h, piece, _ = _words(texts, langs, seed)
            ids = own.of(h)
            live = np.flatnonzero(ids)
            if not len(live):
                continue
            ids, piece = np.append(ids, np.zeros(ORDER, np.uint64)), np.append(piece, np.full(ORDER, -1))
            onward = np.append((ids[1:] > 0) & (ids[:-1] > 0) & (piece[1:] == piece[:-1]), False)
            columns, open_ = [ids[live]], np.ones(len(live), bool)
            for j in range(1, ORDER):
                open_ = open_ & onward[live + j - 1]
                columns.append(np.where(open_, ids[live + j], np.uint64(0)))
            rows, n = _summed(own.write(columns))
            names = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
            part = np.zeros(len(n), np.int32)
            if len(cuts):
                part = np.repeat(np.arange(len(cuts) + 1, dtype=np.int32), np.diff(np.concatenate(([0], np.searchsorted(names, cuts), [len(n)]))))
            for a in range(0, len(n), 1 << 16):
                b = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(part[a:b]), _binary(rows[a:b]), pa.array(n[a:b])], ["part", "key", "n"])

    return run


def flow(width: int, least: int):
    """Sorted edges (part, key, n) -> (key, n) of the sequences of one to five words that begin them. Those below ``least`` are
    left out, unless a border of the partition may have cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each order: the bytes of the run that is open, its sum, whether it is the partition's first.
        state: list[tuple[bytes, int, bool] | None] = [None] * ORDER
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, _ = text_bytes(batch.column(1))
            rows, n = flat.reshape(batch.num_rows, ORDER * width), batch.column(2).to_numpy()
            words = rows.reshape(len(n), ORDER, width)
            changed = np.zeros(len(n) - 1, bool)
            for k in range(ORDER):
                changed = changed | (words[1:, k] != words[:-1, k]).any(axis=1)
                first = np.concatenate(([0], np.flatnonzero(changed) + 1))
                sums, size = np.add.reduceat(n, first), (k + 1) * width
                head, keep, out = rows[0, :size].tobytes(), sums >= least, []
                whole = words[first, k].any(axis=1)  # else the sequence ends before its k-th word
                begins = state[k] is None
                if state[k] is not None:
                    key, held, edge = state[k]
                    if key == head:
                        sums[0] += held
                        keep[0], begins = sums[0] >= least, edge
                    elif (held >= least or edge) and any(key[-width:]):
                        out.append((key, held))
                keep[0] |= begins
                state[k] = (rows[first[-1], :size].tobytes(), int(sums[-1]), begins and len(first) == 1)
                keep[-1] = False
                kept = np.flatnonzero(keep & whole)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([_binary(rows[first[kept], :size]), pa.array(sums[kept])], ["key", "n"])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())], ["key", "n"])
        rest = [(s[0], s[1]) for s in state if s and any(s[0][-width:])]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rest], pa.binary()), pa.array([x[1] for x in rest], pa.int64())], ["key", "n"])

    return run


class Graph:
    """Counts of the sequences of up to five words that occur ``least`` times: ``counts`` (key, words, n), key being the
    ``width`` bytes of each word; ``names`` (id, lang, word, total), total being the language's words."""

    def __init__(self, counts: DataFrame, names: DataFrame, width: int):
        self.counts, self.names, self.width = counts, names, width

    def head(self, key: Column, words) -> Column:
        return F.substring(key, F.lit(1), words * self.width)

    def tail(self, key: Column, words) -> Column:
        """All but the first ``words``."""
        return F.substring(key, words * self.width + 1, F.length(key))

    def texts(self, keyed: DataFrame) -> DataFrame:
        """keyed (key, ...) with the words as a text, by a join of each word; for few rows."""
        place = F.explode(F.sequence(F.lit(0), F.floor(F.length("key") / self.width).cast("int") - 1))
        each = keyed.select("key").distinct().withColumn("at", place)
        each = each.withColumn("id", F.substring("key", F.col("at") * self.width + 1, F.lit(self.width))).join(self.names.select("id", "word"), "id")
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
        return keyed.join(each.groupBy("key").agg(said.alias("phrase")), "key")


def graph(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, bound: int = 4_000_000, per_part: int = 4_000_000, sample: int = 64, seed: int = 0) -> Graph:
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    for seed in range(seed, seed + 8):
        counted = own.mapInArrow(count_words(seed), "lang string, h long, word string, n long").groupBy("h")
        one = F.struct("lang", "word")
        words = stored(counted.agg(F.sum("n").alias("n"), F.min(one).alias("a"), F.max(one).alias("b")))
        if not words.filter("a <> b").take(1):
            break
    else:
        raise RuntimeError("words share a hash under every seed")
    totals = words.groupBy("a.lang").agg(F.sum("n").alias("total"))
    frequent = stored(words.filter(F.col("n") >= least).select("h", "a.lang", "a.word").join(totals, "lang"))
    some = frequent.select("h").limit(bound + 1).toArrow()["h"].to_numpy() if frequent.count() <= bound else None
    numbers = Numbers(None if some is None else np.sort(some))
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_part))
    sent, none = spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast([])
    kinds = "part int, key binary, n long"
    drawn = own.filter(hash_unit(F.col("text")) < min(1.0, 4 * sample * parts / max(1, total)))
    with small_batches(spark, 1_000):
        few = drawn.mapInArrow(edges(seed, sent, none), kinds).select("key").orderBy(F.xxhash64("key"), "key").limit(sample * parts).toArrow()["key"]
    drawn_keys = np.sort(np.array(few.to_pylist(), f"S{ORDER * numbers.width}"))
    cuts = np.unique(drawn_keys[[len(drawn_keys) * i // parts for i in range(1, parts)]]) if len(drawn_keys) else drawn_keys
    splitters = spark.sparkContext.broadcast(cuts)
    with_parts = own.mapInArrow(edges(seed, sent, splitters), kinds)
    runs = with_parts.repartitionById(parts, "part").sortWithinPartitions("key").mapInArrow(flow(numbers.width, least), "key binary, n long")
    counts = runs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    counts = stored(counts.select("key", (F.length("key") / numbers.width).cast("int").alias("words"), "n"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = sent.value.write([sent.value.of(batch.column(0).to_numpy())])
            yield pa.RecordBatch.from_arrays([_binary(ids), *batch.columns[1:]], ["id", "lang", "word", "total"])

    names = frequent.select("h", "lang", "word", "total").mapInArrow(name, "id binary, lang string, word string, total long")
    return Graph(counts, stored(names), numbers.width)


def compacted(g: Graph, most: int) -> DataFrame:
    """(key, words, n): the phrases of 2 to ``most`` words that no arc of the same weight absorbs."""
    phrases = g.counts.filter(F.col("words").between(2, most))
    longer = phrases.filter("words > 2")
    shorter = F.explode(F.array(g.head(F.col("key"), F.col("words") - 1), g.tail(F.col("key"), F.lit(1)))).alias("key")
    return phrases.join(longer.select(shorter, "n").distinct(), ["key", "n"], "left_anti")


def scored(g: Graph, phrases: DataFrame) -> DataFrame:
    """phrases with lang, total, and the lowest-scoring cut: cut, l, r, score."""
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumns({"left": g.head(F.col("key"), F.col("cut")), "right": g.tail(F.col("key"), F.col("cut"))})
    part = lambda k, n: g.counts.select(F.col("key").alias(k), F.col("n").alias(n))
    first = g.names.select(F.col("id").alias("first"), "lang", "total")
    known = cut.join(part("left", "l"), "left").join(part("right", "r"), "right").withColumn("first", g.head(F.col("key"), F.lit(1))).join(first, "first")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('n * 1000')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")
    return known.groupBy("key", "words", "n", "lang", "total").agg(worst).select("key", "words", "n", "lang", "total", "x.cut", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = ORDER, top: int = 2_000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` words by score, count
    and text."""
    g = graph(docs, text_col, lang_col, least, **how)
    found = scored(g, compacted(g, most))
    order = [F.desc("score"), F.desc("n")]
    near = found.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= top)
    said = g.texts(stored(near.drop("at")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    out = said.withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


def _placed(keys: DataFrame, follows: DataFrame) -> DataFrame:
    """(key, before, steps, start, least): each key's line by its first key, and its place on it, by doubling: each round a
    key learns of twice as many before it. Keys of a ring get no start, but its smallest key as ``least``."""
    first = F.col("before").isNull()
    steps, start = F.when(first, 0).otherwise(1).cast("long"), F.when(first, F.col("key"))
    state = stored(keys.join(follows, "key", "left").select("key", "before", steps.alias("steps"), start.alias("start"), F.least("key", F.coalesce("before", "key")).alias("least")))
    for _ in range(keys.count().bit_length() + 1):
        if not state.filter("start is null").take(1):
            break
        known = state.select(F.col("key").alias("before"), F.col("before").alias("b"), F.col("steps").alias("s"), F.col("start").alias("t"), F.col("least").alias("m"))
        moved = state.join(known, "before", "left")
        state = stored(moved.select("key", F.col("b").alias("before"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"), F.coalesce("start", "t").alias("start"), F.least("least", F.coalesce("m", "least")).alias("least")))
    return state


def paths(g: Graph) -> DataFrame:
    """(lang, phrase, words, n): the unary paths of edges, each compacted to one passage of five words or more that occurs n
    times. An edge follows another where the node between them lets no other flow in or out. A ring begins at its smallest
    edge. A path's words are gathered in one row: it is one passage."""
    edge = g.counts.filter(F.col("words") == ORDER).select("key", "n")
    node = g.counts.filter(F.col("words") == ORDER - 1).select(F.col("key").alias("node"), "n")
    into = edge.select("key", "n", g.tail(F.col("key"), F.lit(1)).alias("node"))
    out = edge.select(F.col("key").alias("next"), "n", g.head(F.col("key"), F.lit(ORDER - 1)).alias("node"))
    follows = stored(into.join(node, ["node", "n"]).join(out, ["node", "n"]).select(F.col("next").alias("key"), F.col("key").alias("before")))
    placed = _placed(edge.select("key"), follows)
    ring = placed.filter("start is null").select("key", "least")
    if ring.take(1):
        cut = follows.join(ring.filter("key <> least").select("key"), "key", "left_semi")
        placed = placed.filter("start is not null").unionByName(_placed(ring.select("key"), cut))
    return _passages(g, edge, placed.select("key", "steps", "start"))


def _passages(g: Graph, edge: DataFrame, placed: DataFrame) -> DataFrame:
    """The first edge of each path and the last words of the others, in order."""
    each = placed.join(edge, "key").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("steps", "key"))).alias("along"), F.max("n").alias("n"))
    bytes_ = F.concat(F.col("start"), F.coalesce(F.unhex(F.array_join(F.transform(F.slice("along", 2, F.size("along")), lambda x: F.hex(g.tail(x["key"], F.lit(ORDER - 1)))), "")), F.lit(b"")))
    whole = each.select(bytes_.alias("key"), (F.size("along") + ORDER - 1).alias("words"), "n")
    first = g.names.select(F.col("id").alias("first"), "lang")
    return g.texts(whole).withColumn("first", g.head(F.col("key"), F.lit(1))).join(first, "first").select("lang", "phrase", "words", "n")
