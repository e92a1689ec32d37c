"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate (expected copies) that departs least, in relative entropy, from
one copy of everything while each source's words meet its target: the rate is an exponential
tilt of the document's size, exp(lambda_s * size / scale_s), held at ``cap``. The convex dual
has one multiplier a source; guarded Newton steps solve it on the table of
(source, size, documents), which Spark aggregates once. Rates become whole copies by
systematic rounding along the documents of a source in order of size, and what rounding left
over is settled with whole documents, largest fitting first, until none fits.

Native: DataFrame operations only. Documents of one source and size are numbered in 256
hashed cells, so a source with a third of all rows is no single task. The driver sees
nothing but the number of unfinished sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import WORD, cut_lineage, documents, spread

#: Weights of the sources by code point, repeated (fixed values of the mix).
WEIGHTS = (5.0, 2.0, 1.0)
_CELLS = 256


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources by code point, null last, get the repeating weights and share ``share`` of all
    sizes; a target stops at ``cap`` times its source's size and the excess goes to the rest
    by weight, until none is above. One row per source; solved exactly by ordering sources by
    the level at which they fill up.
    """
    byte_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(byte_order) - 1, F.lit(len(weights))))
    t = sizes.withColumn("w", w).withColumn("full", cap * F.col("source_size"))
    # a source is full at level l (words per weight) when w * l reaches its limit
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumns({
        "done": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "total": F.lit(share) * F.sum("source_size").over(everything),
    })
    # the level if this source and all later ones are not full; valid at the first one that isn't
    t = t.withColumn("level", (F.col("total") - F.col("done")) / F.col("left"))
    t = t.withColumn("open", F.col("w") * F.col("level") <= F.col("full"))
    # among sources that fill up at one level the first has the highest and right one
    level = -F.min(F.when(F.col("open"), F.struct((F.col("full") / F.col("w")).alias("at"), (-F.col("level")).alias("l")))).over(everything)["l"]
    return t.withColumn("l", level).select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("w") * F.col("l")), F.col("full")).alias("target"))


def _solve(cells: DataFrame, goal: DataFrame, cap: float, rounds: int = 60, near: float = 1e-6) -> DataFrame:
    """(source, size, n) and (source, target) -> (source, size, n, target, rate).

    ``x`` = size over the source's largest size. Newton on the dual gradient
    ``sum n * size * rate - target`` with a bracket per source; a step that leaves the
    bracket is halved into it. Each round is one aggregation over the cells.
    """
    scale = cells.groupBy("source").agg(F.max("size").alias("scale"))
    cells = cells.join(F.broadcast(scale), cells["source"].eqNullSafe(scale["source"])).drop(scale["source"])
    cells = cut_lineage(cells)
    rate = lambda lam: F.least(F.lit(cap), F.exp(F.least(F.lit(30.0), lam * F.col("size") / F.greatest("scale", F.lit(1)))))
    full = F.col("target") >= (1 - 1e-9) * cap * F.col("source_size")   # every rate is the cap
    state = cut_lineage(goal.select(F.col("source").alias("s"), "target", F.when(full, 1e12).otherwise(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), full.alias("ok")))
    for _ in range(rounds):
        todo = state.where("not ok")
        if todo.isEmpty():
            break
        at = cells.join(F.broadcast(todo), cells["source"].eqNullSafe(todo["s"])).withColumn("r", rate(F.col("lam")))
        words = F.col("n") * F.col("size")
        slope = F.when(F.col("r") < cap, words * F.col("size") / F.greatest("scale", F.lit(1)) * F.col("r")).otherwise(0.0)
        sums = at.groupBy("s", "target", "lam", "lo", "hi").agg((F.sum(words * F.col("r")) - F.col("target")).alias("g"), F.sum(slope).alias("h"))
        sums = sums.withColumns({"lo": F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.col("g") / F.when(F.col("h") > 0, F.col("h"))
        middle = F.when(F.col("hi") > 1e5, F.greatest(2 * F.col("lam"), F.lit(1.0))).when(F.col("lo") < -1e5, F.least(2 * F.col("lam"), F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) < 50)
        done = (F.abs("g") <= near * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("hi") - F.col("lo") < 1e-9) | (F.abs("lam") > 5e4)
        step = sums.select("s", "target", F.when(done, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), "lo", "hi", done.alias("ok"))
        state = cut_lineage(state.where("ok").unionByName(step))
    state = state.select("s", "target", "lam")
    return cells.join(F.broadcast(state), cells["source"].eqNullSafe(state["s"])).select("source", "size", "n", "target", rate(F.col("lam")).alias("rate"))


def _settle(open_: DataFrame) -> DataFrame:
    """(source, size, m, left) -> (source, size, t): how many of ``m`` copies of each size are
    taken to fill ``left``, largest fitting size first, until none fits.

    A round takes sizes in descending order up to the first that does not fit whole, and as
    many as fit of that one. What is left halves at least each round, or nothing fits.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    open_, out = cut_lineage(open_.where("size <= left")), None
    while out is None or not open_.isEmpty():
        rest = F.col("left") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(down), F.lit(0))
        step = open_.withColumn("t", F.greatest(F.lit(0), F.least(F.col("m"), F.floor(rest / F.col("size")))).cast("long"))
        step = cut_lineage(step.withColumn("left", F.col("left") - F.sum(F.col("t") * F.col("size")).over(Window.partitionBy("source"))))
        taken = step.where("t > 0").select("source", "size", "t")
        out = taken if out is None else out.union(taken)
        open_ = step.select("source", "size", (F.col("m") - F.col("t")).alias("m"), "left").where("m > 0 and size <= left")
    return out


def mix(docs: DataFrame, *, source: str = "source", text: str = "text", key: str = "doc_id",
        weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, rate, copies (0 to ``cap``).

    size counts words; null and empty texts have size 0 and one copy. Sources are told apart
    by value, null being one of them. Equal rows are kept apart by their number among equals.
    Columns of ``docs`` with one of the new names are replaced. Reruns give the same copies
    per (key, text) multiset.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    cols = docs.columns
    sized = docs.withColumns({"size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "__s": F.col(source)})
    light = cut_lineage(sized.select(F.col("__s").alias("source"), "size", F.col(key).cast("string").alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    cells = light.groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = cut_lineage(targets(sums, weights=weights, share=share, cap=cap))
    solved = _solve(cells, goal, cap)
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    solved = cut_lineage(solved.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0))))

    # number of every document within its source and size, from counts of hashed cells
    cell = F.pmod(F.xxhash64("k", "h"), F.lit(_CELLS))
    light = light.withColumn("cell", cell)
    counts = light.groupBy("source", "size", "cell").agg(F.count("*").alias("m"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = counts.alias("c").join(solved.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
    plan = plan.select(F.col("c.source"), F.col("c.size"), "cell", "ahead", "target", "rate", "start")
    numbered = light.withColumn("i", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("k", "h")) - 1)
    got = numbered.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.cell") == F.col("p.cell")))
    at = F.col("start") + (F.col("ahead") + F.col("i")) * F.col("rate")
    copies = F.least(F.lit(cap), F.floor(at + F.col("rate") + 0.5) - F.floor(at + 0.5))
    got = got.select(F.col("d.source"), F.col("d.size"), "k", "h", "i", "target", "rate", F.when(F.col("d.size") == 0, 1).otherwise(copies).cast("long").alias("copies"))
    got = cut_lineage(got)

    # what rounding left: copies to add or drop of every size, then of its documents in order
    short = got.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    got = got.alias("g").join(F.broadcast(short).alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.*", "gap").withColumn("cell", cell)
    got = got.withColumn("unit", F.when(F.col("size") == 0, 0).when(F.col("gap") > 0, F.lit(int(cap)) - F.col("copies")).otherwise(F.col("copies")).cast("long"))
    units = cut_lineage(got.groupBy("source", "size", "cell").agg(F.sum("unit").alias("m"), F.first("gap").alias("gap")).where("m > 0"))
    took = _settle(units.groupBy("source", "size").agg(F.sum("m").alias("m"), F.first(F.abs("gap")).alias("left")))
    units = units.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fix = units.alias("u").join(took.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")) & (F.col("u.size") == F.col("t.size"))).select("u.source", "u.size", "cell", (F.col("t") - F.col("before")).alias("want")).where("want > 0")
    in_cell = Window.partitionBy("source", "size", "cell").orderBy("k", "h", "i").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumn("run", F.coalesce(F.sum("unit").over(in_cell), F.lit(0)))
    moved = F.greatest(F.lit(0), F.least(F.col("unit"), F.coalesce("want", F.lit(0)) - F.col("run"))) * F.signum("gap").cast("long")
    same = F.col("g.source").eqNullSafe(F.col("f.source")) & (F.col("g.size") == F.col("f.size")) & (F.col("g.cell") == F.col("f.cell"))
    got = got.alias("g").join(fix.alias("f"), same, "left").select("g.source", "g.size", "k", "h", "i", "target", "rate", (F.col("copies") + moved).alias("copies"))

    # back to the whole rows: equal (key, text) rows are matched by their number
    again = Window.partitionBy("source", "size", "k", "h").orderBy("i")
    got = got.withColumn("j", F.row_number().over(again)).join(F.broadcast(goal.select(F.col("source").alias("gs"), "source_size")), F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    whole = sized.withColumns({"__k": F.col(key).cast("string"), "__h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    whole = whole.withColumn("__j", F.row_number().over(Window.partitionBy("__s", "size", "__k", "__h").orderBy(F.lit(0))))
    got = got.select(*[F.col(c).alias("__g_" + c) for c in got.columns])
    on = (whole["__s"].eqNullSafe(got["__g_source"]) & whole["__k"].eqNullSafe(got["__g_k"]) & (whole["__h"] == got["__g_h"]) & (whole["__j"] == got["__g_j"]) & (whole["size"] == got["__g_size"]))
    return whole.join(got, on).select(*cols, "size", *[F.col("__g_" + c).alias(c) for c in ("source_size", "target", "rate", "copies")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words the mix takes of every document."""
    out = mix(spread(documents(spark, sf_dir).select("doc_id", "text", "source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
