"""The prefix trie of conversations, with depth-band rollup.

*Rebuilding.* Conversation c begins with the first h turns of conversation c - c % 20, h = crc32(decimal c) % 4, and goes
on with its own turns after its first h.

*Nodes.* A depth-d node is a distinct sequence of d rebuilt turns. It is named by its depth and the exclusive or of hashes
of (place, turn) along it, 128 bits that a running window gives: no conversation is gathered. A turn enters by 120 bits
of the SHA-256 of its role and text.

*Rollup.* What a node adds to all its ancestors is summed in bands of ``height`` depths. Inside a band a node explodes to
its ancestors there, ``height`` rows at most. Then, from the deepest band up, the completed totals of a band's roots
explode to their ancestors in the band above, so the rounds are as many as bands and no row ever explodes to a whole
path. A node's path is read off the smallest conversation through it.

*Hot groups.* Counts are sums with map-side combine. The ids that end at a node are joined to pieces in range partitions,
and one task per node digests the pieces in order, which SHA-256 asks for, without holding them.

Rows are ordered by turn (null first), then role, text; a null role or text is empty. Repeated rows are turns of their
own. Rows without conv_id belong to no conversation. An empty table has no node, not even the root. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import stored
from attest.llm.mixing import word_count

NODE = ["depth", "x1", "x2"]
#: Conversations that share a base, and most turns taken from it.
BLOCK, HEADS = 20, 4


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, words): each conversation's turns from 1, digests and words of the text."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    own = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return own.withColumn("pos", pos).withColumn("sha", sha).select("conv_id", "pos", half(1).alias("d1"), half(16).alias("d2"), word_count(F.col("text")).alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, d1, d2, words): a conversation's root (part 0), the turns of its base (1), its own (2)."""
    c = turns.select("conv_id").distinct()
    roots = c.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("words"))
    wanted = c.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("conv_id"), shared_turns(F.col("conv_id")).alias("h")).filter("h > 0")
    heads = wanted.join(turns.filter(F.col("pos") < HEADS), "conv_id").filter("pos <= h").select(F.col("c").alias("conv_id"), F.lit(1).alias("part"), "pos", "d1", "d2", "words")
    own = turns.filter(F.col("pos") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(2).alias("part"), "pos", "d1", "d2", "words")
    return roots.unionByName(heads).unionByName(own)


def prefixes(sequence: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, words, last, band): a row for each conversation and depth; the node it passes
    there, the node before (null above the root), whether it ends there."""
    along = Window.partitionBy("conv_id").orderBy("part", "pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    numbered = sequence.withColumn("depth", (F.row_number().over(along) - 1).cast("long")).withColumn("last", F.lead("part").over(along).isNull())
    mark = lambda *c: F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*c))
    keyed = numbered.withColumns({"x1": F.bit_xor(mark("depth", "d1", "d2")).over(upto), "x2": F.bit_xor(mark("d2", "depth", "d1")).over(upto)})
    keyed = keyed.withColumns({"p1": F.lag("x1").over(along), "p2": F.lag("x2").over(along)})
    return keyed.select("conv_id", *NODE, "p1", "p2", "words", "last", F.floor(F.col("depth") / height).cast("int").alias("band"))


def _join_ids(batches: Iterator[pa.RecordBatch], most: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x1, x2, conv_id) -> (depth, x1, x2, first, ids): ids of a node, comma-joined, ``most`` a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_numpy()
        fresh = np.flatnonzero(np.concatenate(([True], (node[:, 1:] != node[:, :-1]).any(axis=0))))
        cuts = np.unique(np.concatenate([fresh, np.arange(0, len(ids), most)]))
        words = ids.astype(str)
        texts = [",".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(n[cuts]) for n in node), pa.array(ids[cuts]), pa.array(texts)], [*NODE, "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a node in order -> its SHA-256; what is held is one digest's state."""
    node, sha, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != node:
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield out()
            done.clear()
    if node:
        done.append((*node, sha.hexdigest()))
        yield out()


def ends(paths: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends): digest of the ids that end at a node, in order."""
    ids = stored(paths.filter("last").select(*NODE, "conv_id"))
    pieces = ids.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_join_ids, "depth long, x1 long, x2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digest, "depth long, x1 long, x2 long, ends string")


def rollup(nodes: DataFrame, paths: DataFrame, height: int, names: list[str]) -> DataFrame:
    """(depth, x1, x2, *names): parts of the sums of ``names`` over each node's subtree; they add up to the sum."""
    total = lambda df: df.groupBy(*NODE).agg(*[F.sum(n).alias(n) for n in names])
    above = paths.select("conv_id", "band", *NODE)
    low = nodes.select("conv_id", "band", F.col("depth").alias("at"), *names)
    within = stored(total(low.join(above, ["conv_id", "band"]).filter("depth <= at")))
    deepest = nodes.agg(F.max("band")).first()[0] or 0
    parts, below = [within], None
    for band in range(deepest - 1, -1, -1):
        top = (band + 1) * height
        done = within.filter(F.col("depth") == top)
        if below is not None:
            done = total(done.unionByName(below.filter(F.col("depth") == top)))
        roots = nodes.filter(F.col("depth") == top).select("conv_id", *NODE).join(done, NODE).select("conv_id", *names)
        below = stored(total(roots.join(above.filter(F.col("band") == band), "conv_id")))
        parts.append(below)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prefix_trie(rows: DataFrame, height: int = 32) -> DataFrame:
    """A row per node of the trie of rebuilt conversations(conv_id, turn, role, text): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(ordered(rows))
    paths = stored(prefixes(rebuilt(turns), height), by="band")
    found = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("band").alias("band"), F.min("last").alias("bottom"))
    # A node all of whose members end there has no child.
    nodes = stored(found.withColumn("leaves", F.col("bottom").cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("children"))
    facts = nodes.select(*NODE, "conv_id", "n_convs", "p1", "p2")
    for part in (children, rollup(nodes, paths, height, ["leaves", "saved"]), ends(paths)):
        facts = facts.unionByName(part, allowMissingColumns=True)
    one = lambda c: F.max(c).alias(c)
    whole = facts.groupBy(*NODE).agg(one("conv_id"), one("n_convs"), one("p1"), one("p2"), one("ends"), F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = whole.join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
