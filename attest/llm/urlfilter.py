"""URL filters over a sorted digest array.

The rule list becomes one file: the sorted 64-bit xxhash keys of all rules, then offsets, verdicts and the
full rule strings. Spark sorts the list; the file goes to the executors with ``addFile`` and is memory-mapped
there. A batch of urls is turned into candidate strings (each suffix of the host joined with each prefix of
the path whose length some rule has), their digests are probed with a vectorised binary search, and every hit
is confirmed against the stored string, so a collision of digests changes nothing. The longest rule wins.

The file holds at most ``bound`` rules with at most ``most_lengths`` lengths of paths; other lists are joined by
digest and string instead, in a shuffle.
Urls that are null or have no ``://`` have an empty host and path, match no rule and get ``default``.
An empty rule list gives every url ``default``. Of equal rules with different verdicts, block wins. Repeated
urls are judged each; other columns are ignored unless kept by name.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import ascii_lower, pieces

MAGIC = 8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_parts(rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(rule, path, flags), one row per rule; ``net/`` is for host net and path /. Flags: 1 a rule that blocks,
    2 a rule that allows, 4 and 8 the same for the second list."""
    flag = lambda block, allow: F.when(F.col("verdict") == "block", block).otherwise(allow)
    parts = rules.select("rule", flag(1, 2).alias("flag"))
    if listed is not None:
        parts = parts.unionByName(listed.select("rule", flag(4, 8).alias("flag")))
    parts = parts.filter("rule is not null").groupBy("rule").agg(F.bit_or("flag").alias("flags"))
    return parts.withColumn("path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))


class DigestArray:
    """The file, memory-mapped: count, keys (sorted), offsets into the strings, flags, strings."""

    def __init__(self, path: str):
        self.n = int(np.fromfile(path, np.int64, 1)[0])
        at, n = MAGIC, self.n
        if n:
            self.keys = np.memmap(path, np.uint64, "r", at, (n,))
            self.offsets = np.memmap(path, np.int64, "r", at + 8 * n, (n + 1,))
            self.flags = np.memmap(path, np.uint8, "r", at + 16 * n + 8, (n,))
            self.strings = np.memmap(path, np.uint8, "r", at + 17 * n + 8, (int(self.offsets[n]),))

    @staticmethod
    def write(path: str, rows: list[tuple[str, int]]) -> None:
        """rows: (rule, flags), in any order."""
        packed = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in rows)
        with open(path, "wb") as f:
            f.write(np.int64(len(packed)).tobytes())
            f.write(np.array([k for k, _, _ in packed], np.uint64).tobytes())
            f.write(np.concatenate(([0], np.cumsum([len(r) for _, r, _ in packed]))).astype(np.int64).tobytes())
            f.write(np.array([b for _, _, b in packed], np.uint8).tobytes())
            f.write(b"".join(r for _, r, _ in packed))

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each candidate's rule, or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not self.n or not candidates:
            return out
        digest = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digest)
        for i in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == digest)):
            k = int(at[i])
            while k < self.n and self.keys[k] == digest[i]:  # equal digests stand side by side
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Longest host suffix first; below it, longest path prefix first."""
    labels = host.split(".")
    tails = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [(h + path[:n]).encode() for h in tails for n in lengths if n <= len(path)]


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bound: int = 2_000_000, listed: DataFrame | None = None, most_lengths: int = 4_096) -> DataFrame:
    """(id, host, path, rule, verdict). rules: rule (host and path prefix, like ``example.net/en/``), verdict.
    ``listed``: a second list of the same form, in the same digest array; it gives the verdict where no rule
    fits, and is not named in ``rule``."""
    spark = urls.sparkSession
    rows = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = rule_parts(rules, listed)
    lengths = sorted((r[0] for r in parts.select(F.length("path")).distinct().limit(most_lengths + 1).collect()), reverse=True)
    if len(lengths) > most_lengths or parts.count() > bound:
        return _judge_by_join(rows, parts, lengths if len(lengths) <= most_lengths else None, default).withColumnRenamed("id", id_col)
    kind = dict(rows.dtypes)["id"]
    name = f"rules-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="attest-rules-")  # the driver serves the file to new executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    DigestArray.write(os.path.join(folder, name), [(r["rule"], r["flags"]) for r in parts.select("rule", "flags").collect()])  # ``bound`` rows at most
    spark.sparkContext.addFile(os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in pieces(batches):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            distinct: dict[bytes, int] = {}
            found = []
            for host, path in zip(hosts, paths, strict=True):
                found.append([distinct.setdefault(c, len(distinct)) for c in candidates(host, path, lengths)])
            hit = array.probe(list(distinct))
            texts = list(distinct)
            rule, verdict = [], []
            for own in found:
                hits = sorted((c for c in own if hit[c] >= 0), key=lambda c: -len(texts[c]))
                best = next((c for c in hits if array.flags[hit[c]] & 3), None)
                below = next((c for c in hits if array.flags[hit[c]] & 12), None)
                rule.append(None if best is None else texts[best].decode())
                if best is not None:
                    verdict.append("block" if array.flags[hit[best]] & 1 else "allow")
                else:
                    verdict.append(default if below is None else "block" if array.flags[hit[below]] & 4 else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _judge_by_join(rows: DataFrame, parts: DataFrame, lengths: list[int] | None, default: str) -> DataFrame:
    """For lists of any length: distinct (host, path prefix) candidates meet the rules in a shuffle; every prefix where
    the rules' lengths aren't known."""
    known = F.sequence(F.lit(0), F.length("path")) if lengths is None else F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    prefixes = F.transform(known, lambda n: F.col("path").substr(F.lit(1), n))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = rows.filter("host <> ''").select("host", prefixes.alias("prefixes"), "path").distinct()
    pairs = pairs.withColumn("tail", F.explode(tails)).withColumn("prefix", F.explode("prefixes"))
    found = pairs.withColumn("rule", F.concat("tail", "prefix")).withColumn("digest", F.xxhash64("rule")).join(parts.select("rule", "flags").withColumn("digest", F.xxhash64("rule")), ["digest", "rule"])
    of = lambda mask: F.max_by(F.struct("rule", "flags"), F.when(F.col("flags").bitwiseAND(mask) > 0, F.length("rule")))
    best = found.groupBy("host", "path").agg(of(3).alias("best"), of(12).alias("below"))
    out = rows.join(best, ["host", "path"], "left")
    verdict = lambda s, mask: F.when(F.col(f"{s}.flags").bitwiseAND(mask) > 0, "block").when(F.col(f"{s}.rule").isNotNull(), "allow")
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(verdict("best", 1), verdict("below", 4), F.lit(default)).alias("verdict"))
