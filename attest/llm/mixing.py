"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

*Targets.* Sources in code-point order (null last) take the weights in turn; a share of all words is dealt by
weight, and no target exceeds ``cap`` times its source's words: the excess is dealt again by weight among the
rest, until none is above. That is water-filling, solved by running sums over the sources.

*Rates.* For each source the document rates r = min(cap, exp(lambda * x)) minimise the relative entropy to
"take everything once" under the constraint sum(r * size) = target, x being the square root of the document's
size over its source's mean: a document's pull on the constraint, scaled so that very long documents are not
all or nothing. The dual is convex, one lambda per source; Newton steps with a bracket find it. Every sum runs
over the table of (source, size, count), to which the documents are aggregated once, as Spark jobs.

*Copies.* From the largest size down, each cell of equal documents takes a whole number of copies by running sums;
what a source then misses or exceeds is settled with single copies, so it ends within about its smallest documents
of its target. Inside a cell the copies go round; who gets one more depends on a hash of the id, in salted groups of
bounded size.

Null texts and sources are allowed (size 0; a source of its own). Documents without words take one copy of
nothing. Repeated rows each take their own copies. An empty table gives an empty result. Columns of other
names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import WORD, stored, unused

CLOSE = 1e-10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last: no other key begins with ~."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def targets(cells: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(skey, source_size, documents, target). One row per source, so a single ordered pass over them is small."""
    every = Window.partitionBy()
    sources = cells.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    turn = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("pool", share * F.sum("source_size").over(every))
    sources = sources.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("full_at", "skey")
    before = F.coalesce(F.sum("source_size").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("pool") - cap * before) / left)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))).over(every)["level"]
    return sources.select("skey", "source_size", "documents", F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def pull(size: Column, mean: Column) -> Column:
    return F.sqrt(size / mean)


def newton(cells: DataFrame, wanted: DataFrame, cap: float, rounds: int = 48, together: int = 4) -> DataFrame:
    """(skey, source_size, target, mean, lam): the solution of each source's dual."""
    live = cells.filter("size > 0")
    state = wanted.withColumn("mean", F.col("source_size") / F.col("documents")).withColumns({"lam": F.lit(0.0), "lo": F.lit(-400.0), "hi": F.lit(400.0), "gap": F.lit(1.0)})
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = stored(state.withColumn("lam", F.when(full, F.col("hi")).otherwise(F.col("lam"))).withColumn("gap", F.when(full | (F.col("target") <= 0), 0.0).otherwise(F.col("gap"))))
    for _ in range(0, rounds, together):
        for _ in range(together):
            state = _step(live, state, cap)
        state = stored(state)
        if (state.agg(F.max("gap")).first()[0] or 0.0) < CLOSE:
            break
    else:
        raise RuntimeError("the rates did not settle")
    return state.select("skey", "source_size", "target", "mean", F.round("lam", 10).alias("lam"))


def _step(live: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    x = pull(F.col("size"), F.col("mean"))
    rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    mass = F.col("n") * F.col("size")
    open_ = state.filter(F.col("gap") >= CLOSE)
    sums = live.join(open_, "skey").groupBy("skey").agg(F.sum(mass * F.least(rate, F.lit(cap))).alias("f"), F.sum(F.when(rate < cap, mass * x * rate).otherwise(0.0)).alias("slope"))
    moved = state.join(sums, "skey", "left").withColumn("over", F.col("f") - F.col("target"))
    moved = moved.withColumn("lo", F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi")))
    guess = F.col("lam") - F.try_divide(F.col("over"), F.col("slope"))
    inside = (guess > F.col("lo")) & (guess < F.col("hi"))
    gap = F.abs(F.col("over")) / F.col("target")
    moved = moved.withColumn("gap", F.coalesce(gap, F.col("gap")))
    lam = F.when(F.col("f").isNull() | (F.col("gap") < CLOSE), F.col("lam")).when(inside, guess).otherwise((F.col("lo") + F.col("hi")) / 2)
    return moved.withColumn("lam", lam).drop("f", "slope", "over")


def copies_by_cell(cells: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """(skey, size, n, copies): whole copies per cell of equal documents, near their rates and in sum near the target.

    Along a source's cells, largest size first, runs the sum of words due; a cell takes a copy for every multiple of its
    size that the sum passes. What a source then lacks or has too much is first taken from or given to its largest
    cells, a copy each, and the rest to the one cell that leaves least."""
    x = pull(F.col("size"), F.col("mean"))
    rate = F.least(F.lit(cap), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(rate)
    down = Window.partitionBy("skey").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    due, most = F.col("n") * F.col("size") * rate, (F.col("n") * cap).cast("long")
    summed = cells.filter("size > 0").join(solved, "skey").withColumn("due", due).withColumn("upto", F.sum("due").over(down)).withColumn("most", most)
    passed = F.floor(F.col("upto") / F.col("size") + 0.5) - F.floor((F.col("upto") - F.col("due")) / F.col("size") + 0.5)
    state = summed.select("skey", "size", "n", "most", "target", F.greatest(F.lit(0), F.least(passed, "most")).cast("long").alias("copies"))
    miss = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("skey"))
    state = state.withColumn("miss", miss)
    step = F.signum("miss").cast("long")
    free = ((F.col("copies") + step).between(0, F.col("most"))).cast("long") * F.abs(step)
    state = state.withColumn("step", step * free).withColumn("moved", F.sum(free * F.col("size")).over(down))
    state = stored(state.withColumn("copies", F.col("copies") + F.when(F.col("moved") <= F.abs("miss"), F.col("step")).otherwise(0)).drop("miss", "step", "moved"))
    own = Window.partitionBy("skey")
    for _ in range(3):  # windows over one partitioning: no row is read twice
        lacks = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own)
        more = F.greatest(-F.col("copies"), F.least(F.round(F.col("miss") / F.col("size")).cast("long"), F.col("most") - F.col("copies")))
        tried = state.withColumn("miss", lacks).withColumn("more", more)
        best = F.min_by("size", F.struct(F.abs(F.col("miss") - F.col("more") * F.col("size")), F.col("size"))).over(own)
        state = tried.withColumn("best", best).withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("best"), F.col("more")).otherwise(0)).drop("miss", "more", "best")
    return state.select("skey", "size", "n", "copies").unionByName(cells.filter("size = 0").select("skey", "size", "n", F.col("n").alias("copies")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = 4_000) -> DataFrame:
    """(id, size, source_size, target, taken, copies, skey, mark): the source's key and a hash of the text tell rows of
    one id apart."""
    mark = F.xxhash64(F.col(text_col)).alias("mark")
    sizes = stored(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"), mark))
    cells = stored(sizes.groupBy("skey", "size").agg(F.count("*").alias("n")))
    wanted = targets(cells, weights, share, cap)
    solved = newton(cells, wanted, cap)
    chosen = stored(copies_by_cell(cells, solved, cap).join(solved.select("skey", "source_size", "target"), "skey"))
    most = chosen.agg(F.max("n")).first()[0] or 1
    salts = int(-(-most // group_rows))
    salt = F.pmod(F.xxhash64(F.col("id").cast("string"), "mark", F.lit("salt")), F.lit(salts)).cast("int")
    salted = sizes.withColumn("salt", salt)
    along = Window.partitionBy("skey", "size").orderBy("salt")
    shares = salted.groupBy("skey", "size", "salt").agg(F.count("*").alias("own")).withColumn("upto", F.sum("own").over(along.rowsBetween(Window.unboundedPreceding, 0))) if salts > 1 else chosen.select("skey", "size", F.lit(0).alias("salt"), F.col("n").alias("own"), F.col("n").alias("upto"))
    extra = F.col("copies") - F.col("n") * F.expr("copies div n")
    part = F.expr("(extra * upto) div n") - F.expr("(extra * (upto - own)) div n")
    allotted = shares.join(chosen, ["skey", "size"]).withColumn("extra", extra).select("skey", "size", "salt", "source_size", "target", F.expr("copies div n").alias("base"), part.alias("more"))
    turn = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "mark"))
    out = salted.join(allotted, ["skey", "size", "salt"]).withColumn("copies", F.col("base") + F.when(turn <= F.col("more"), 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "skey", "mark")


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it. Rows meet their copies by id, source and a hash of
    the text, null-safe. Where several rows agree in all three, they share their copies evenly; what is left over goes
    to the first of them, which is all that a window is needed for."""
    named, mark, key, rows_, taken, nth = unused(docs, "source_key", "mark", "id_key", "rows", "taken", "nth")
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    allotted = mixed.groupBy(F.col(id_col).alias(key), F.col("skey").alias("s"), F.col("mark").alias("m")).agg(F.count("*").alias(rows_), F.sum("copies").alias(taken))
    own = docs.withColumns({named: source_key(F.col(source_col)), mark: F.xxhash64(F.col(text_col))})
    joined = own.join(allotted.withColumnsRenamed({"s": f"{named}s", "m": f"{mark}s"}), F.col(id_col).eqNullSafe(F.col(key)) & (F.col(named) == F.col(f"{named}s")) & (F.col(mark) == F.col(f"{mark}s")))
    uneven = (F.col(rows_) > 1) & (F.col(taken) % F.col(rows_) > 0)
    plain = joined.filter(~uneven).withColumn(nth, F.lit(0))
    shared = joined.filter(uneven).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, named, mark).orderBy(F.lit(0))))
    each = F.expr(f"`{taken}` div `{rows_}`") + F.when(uneven & (F.col(nth) <= F.col(taken) % F.col(rows_)), 1).otherwise(0)
    return plain.unionByName(shared).withColumn(nth, F.explode(F.array_repeat(F.lit(0), each.cast("int")))).select(*docs.columns)
