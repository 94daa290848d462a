"""What the lines of a document lend to its summary, and which keywords its units are offered: by codes, over the rows of whole
documents in Arrow batches. Spark brings a document's rows together; a batch is worked on as arrays.

A code holds a keyword's place (from bit 42), a number of its name (from bit 22), and the place of the evidence in the order of
preference, odd unless the document states the keyword itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keywords, names and terms that codes have room for.
LISTED = 1 << 20


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    equal = pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b)))
    return pc.fill_null(equal, False).to_numpy(zero_copy_only=False)


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut between documents (by the first column) alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(0)
        starts = np.flatnonzero(~_same(doc[1:], doc[:-1])) + 1
        if held and not _same(held[-1].column(0)[-1:], doc[:1])[0]:
            starts = np.append(0, starts)
        if held and len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            held = []
        elif len(starts):
            yield pa.Table.from_batches([batch.slice(0, starts[-1])])
        held.append(batch.slice(starts[-1]) if len(starts) else batch)
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and the row of each."""
    lists = pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), pc.is_valid(column).to_numpy()


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are known; the known ones ascend."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Lines:
    """The rows of whole documents, and the best that their lines hold of each keyword, of equals the first."""

    def __init__(self, rows: pa.Table):
        doc = pa.concat_arrays(rows.column("doc_id").chunks)
        self.doc = np.cumsum(np.append(0, ~_same(doc[1:], doc[:-1])))
        self.known = pc.is_valid(doc).to_numpy(zero_copy_only=False)
        line, told = _numbers(rows.column("line"))
        self.unit_no, self.unit = _numbers(rows.column("unit_no"))
        self.list, self.listed = _numbers(rows.column("list"))
        self.summary = pc.fill_null(rows.column("summary"), False).to_numpy()
        place = np.empty(len(line), np.int64)
        place[np.lexsort((line, self.doc))] = np.arange(len(line))
        code, row = _flat(rows.column("near"))
        kept = (told & self.known)[row]
        code, row = code[kept], row[kept]
        order = np.lexsort((place[row], code, self.doc[row]))
        code, row = code[order], row[order]
        key = self.doc[row] << 21 | code >> 42
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        self.best, self.of, self.key = code[new], row[new], key[new]
        self.own, self.own_row = _flat(rows.column("own"))

    def lent(self, units: np.ndarray, *but: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, list): what its document lends to each summary among the units, except the keywords (kw, row) of ``but``."""
        rows = np.flatnonzero(units & self.summary & self.known)
        low, high = np.searchsorted(self.key, self.doc[rows] << 21), np.searchsorted(self.key, (self.doc[rows] + 1) << 21)
        size = high - low
        row = np.repeat(rows, size)
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(row))
        key = row << 21 | self.best[at] >> 42
        fits = ~np.any([_within(key, r << 21 | kw) for kw, r in ((self.own >> 42, self.own_row), *but)], axis=0)
        return row[fits], self.best[at][fits], self.list[self.of[at][fits]]


def _pointers(rows: pa.Table, at: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    ids = [pa.concat_arrays(rows.column(c).chunks).take(pa.array(at)) for c in ("doc_id", "unit_no")]
    return pa.RecordBatch.from_arrays([*ids, pa.array(lists, pa.int64()), pa.array(codes, pa.int64())], ["doc_id", "unit_no", "list", "code"])


def _together(lines: DataFrame, columns: list[str], work) -> DataFrame:
    """``work`` on the rows of whole documents. Counting over a document brings its rows together, if they aren't already."""
    rows = lines.select(*columns, F.count("*").over(Window.partitionBy("doc_id")).alias("n"))
    kind = rows.select("doc_id", "unit_no").schema.add("list", "long").add("code", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches):
            yield work(table)

    return rows.mapInArrow(run, kind)


def supported(lines: DataFrame) -> DataFrame:
    """(doc_id, unit_no, list, code) of lines(doc_id, unit_no, line, summary, list, own, near): the list of each unit under -1, and
    what its document lends to each summary. A row is a unit if it has a unit_no, and a line of its document if it has a line."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        lines = Lines(rows)
        units = np.flatnonzero(lines.unit & lines.listed)
        row, code, given = lines.lent(lines.unit)
        return _pointers(rows, np.append(units, row), np.append(lines.list[units], given), np.append(np.full(len(units), -1), code))

    return _together(lines, ["doc_id", "unit_no", "line", "summary", "list", "own", "near"], work)


def offered(lines: DataFrame, per_unit: int, per_keyword: int) -> DataFrame:
    """(doc_id, unit_no, list, code) of lines(as in ``supported``, first, mute): what the units that come ``first`` are offered, in
    order, what the document lacks before what it states, under both caps."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        lines = Lines(rows)
        asked = lines.unit & lines.known & pc.fill_null(rows.column("first"), False).to_numpy()
        row, code, given = lines.lent(asked, _flat(rows.column("mute")))
        own = asked[lines.own_row]
        row, code, given = np.append(lines.own_row[own], row), np.append(lines.own[own], code), np.append(lines.list[lines.own_row[own]], given)
        said = _within(lines.doc[row] << 21 | code >> 42, lines.key[lines.best % 2 == 0])
        order = np.lexsort((code, said, lines.unit_no[row], lines.doc[row]))
        row, code, given = row[order], code[order], given[order]
        taken, used, doc, unit, n = [], {}, -1, -1, 0
        for i, (d, u, name) in enumerate(zip(lines.doc[row].tolist(), row.tolist(), (code >> 22 & LISTED - 1).tolist(), strict=True)):
            if u != unit:
                unit, n = u, 0
                if d != doc:
                    doc, used = d, {}
            if n < per_unit and used.get(name, 0) < per_keyword:
                n += 1
                used[name] = used.get(name, 0) + 1
                taken.append(i)
        return _pointers(rows, row[taken], given[taken], code[taken])

    return _together(lines, ["doc_id", "unit_no", "line", "summary", "list", "own", "near", "first", "mute"], work)
