"""Mixing sources to target weights by entropy balancing.

Each source s gets a token target T_s. Document rates r_i in [0, cap] are those of largest entropy
(relative to one copy each) under sum(r_i * size_i) = T_s; the convex dual has one multiplier per
source and its solution tilts documents exponentially: r_i = cap / (1 + (cap - 1) exp(-lambda_s u_i)),
u_i the size over the source's mean size. Newton steps for all sources run together, each as one
aggregation over (source, size) counts. Rates are then rounded into copies by systematic sampling in
order of size, and a few rounds of single-copy flips per source take off what rounding left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, running_totals

#: Rates are rounded as integers of this many parts, so sums do not depend on the order of rows.
PARTS = 1 << 20
#: Documents of a source that one round of flips changes, at most; rounds go on until no flip helps.
STEPS = 16


def word_count(text: Column) -> Column:
    """Words of a text: the length of what is left when each word is cut to its first character and all white space goes."""
    first = F.regexp_replace(text, WORD.removesuffix("+").join("()") + WORD.removesuffix("+") + r"*|[\x20\x09-\x0D]+", "$1")
    return F.coalesce(F.length(first), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(skey, source_size, n, target) per source: share of all sizes by weight, none above cap times its size.

    Sources stand in order of code points, null last, and get the weights in turn. What a capped source
    leaves is shared again by weight among the others until none is above its cap.
    """
    src = materialize(sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    ranked = running_totals(src.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"], "mix-ranks")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("one_before") % len(weights) + 1).cast("int"))
    src = materialize(ranked.withColumn("weight", w).withColumn("capped", F.lit(False)).drop("one", "one_before"), "mix-weights")
    total = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, most = 0.0, F.col("source_size") * float(cap)
    while True:  # the set of capped sources only grows; each pass is an aggregation over sources
        done, free, n = src.agg(F.sum(F.when(F.col("capped"), most)), F.sum(F.when(~F.col("capped"), F.col("weight"))), F.count_if("capped")).first()
        level = max(0.0, total - (done or 0.0)) / free if free else 0.0
        src = src.withColumn("capped", F.col("capped") | (F.col("weight") * level > most))
        src = materialize(src, "mix-caps")
        if src.agg(F.count_if("capped")).first()[0] == n:
            break
    return src.select("skey", "source_size", "n", F.when(F.col("capped"), most).otherwise(F.col("weight") * level).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * size / mean))
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(z))


def solve(sizes: DataFrame, targets: DataFrame, cap: int = 2, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """targets with the multiplier lam of each source; full is true where every rate is at the cap.

    Newton steps on the dual, kept inside a bracket that each step narrows (bisection where Newton
    leaves it). Sources that the rounds leave open raise an error.
    """
    counts = materialize(sizes.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("k")), "mix-counts")
    state = targets.withColumns({
        "mean": F.greatest(F.lit(1.0), F.col("source_size") / F.col("n")),
        "full": F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12),
        "lam": F.lit(0.0), "lo": F.lit(-1e6), "hi": F.lit(1e6), "open": F.lit(True),
    })
    state = materialize(state.withColumn("open", ~F.col("full") & (F.col("target") > 0)), "mix-state")
    for _ in range(rounds):
        x = counts.join(state.where("open").select("skey", "lam", "mean"), "skey")
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        got = x.withColumn("r", r).groupBy("skey").agg(
            F.sum(F.col("k") * F.col("size") * F.col("r")).alias("got"),
            F.sum(F.col("k") * F.col("size") * F.col("size") / F.col("mean") * F.col("r") * (1 - F.col("r") / cap)).alias("slope"),
        )
        s = state.join(got, "skey", "left").withColumn("gap", F.col("target") - F.col("got"))
        s = s.withColumns({
            "lo": F.when(F.col("gap") > 0, F.greatest("lo", "lam")).otherwise(F.col("lo")),
            "hi": F.when(F.col("gap") < 0, F.least("hi", "lam")).otherwise(F.col("hi")),
        })
        step = F.col("lam") + F.col("gap") / F.when(F.col("slope") > 1e-9, F.col("slope"))
        # the bracket is halved on a scale that is fine near zero
        mid = F.when(F.col("lo") * F.col("hi") < 0, F.when(F.col("lo") + F.col("hi") > 0, F.least(F.lit(1.0), F.col("hi") / 2)).otherwise(F.greatest(F.lit(-1.0), F.col("lo") / 2))).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = F.when(step.between(F.col("lo"), F.col("hi")) & (F.abs(step - F.col("lam")) <= 8 + F.abs(F.col("lam"))), step).otherwise(mid)
        moved = F.col("open") & (F.abs("gap") > tolerance * F.col("target"))
        s = s.withColumns({"lam": F.when(moved, new).otherwise(F.col("lam")), "open": F.coalesce(moved, F.lit(False))})
        state = materialize(s.select(*state.columns), "mix-state")
        if state.where("open").isEmpty():
            return state
    left = state.where("open")
    if not left.isEmpty():
        raise RuntimeError(f"{left.count()} sources did not meet their targets within {rounds} rounds")
    return state


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken, row), one row per row of docs(doc_id, text, source).

    Null text: size 0. Null source: a source of its own, last. Null or repeated doc_id: each row counts
    by itself; rows of one size stand in the order of row, a hash of doc_id, source and text, and rows
    that repeat all three may get different copies. A very long text is a row like others. Empty table: no rows.
    Extra columns are ignored, whatever their names. Same rows, same result.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("skey"), F.xxhash64("doc_id", "source", "text").alias("h"), F.monotonically_increasing_id().alias("tie")), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    state = materialize(solve(sizes, targets, cap), "mix-solved")
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    rated = sizes.join(state.select("skey", "source_size", "target", "full", "lam", "mean"), "skey")
    rated = rated.withColumn("rate", rate).withColumn("parts", F.round(F.col("rate") * PARTS).cast("long")).withColumn("one", F.lit(1).cast("long"))
    # systematic sampling: neighbours in size share the rounding, so each source's error stays near one document
    cum = running_totals(rated.drop("full", "lam", "mean"), [F.col("skey"), F.col("size"), F.col("h"), F.col("tie")], ["parts", "one"], "mix-rounded")
    half = PARTS // 2
    copies = F.floor((F.col("parts_before") + F.col("parts") + half) / PARTS) - F.floor((F.col("parts_before") + half) / PARTS)
    cum = cum.withColumn("copies", F.least(F.lit(cap), copies).cast("long")).withColumnRenamed("one_before", "row")
    cum = materialize(cum.select("doc_id", "skey", "size", "source_size", "target", "rate", "copies", "row", "h"), "mix-copies")
    while True:  # each flip brings its source nearer to its target, so this ends
        gap = cum.groupBy("skey").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        some = cum.join(gap, "skey").where(able).select("skey", "row", "size", "gap")
        # the largest that fit; the rank keeps STEPS rows of a source in each task, before the shuffle
        w = Window.partitionBy("skey").orderBy(F.desc("size"), "row")
        fit = some.where(F.col("size") <= F.abs("gap")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= STEPS)
        fit = fit.withColumn("sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("sum <= abs(gap)")
        # or the one that comes nearest, where that leaves less
        one = some.where(F.col("size") < 2 * F.abs("gap")).groupBy("skey").agg(F.first("gap").alias("gap"), F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("left"), "row")).alias("x"))
        rest = fit.groupBy("skey").agg((F.first(F.abs("gap")) - F.max("sum")).alias("rest"))
        single = one.join(rest, "skey", "left").withColumn("single", F.coalesce(F.col("x.left") < F.col("rest"), F.lit(True)))
        by = F.signum("gap").cast("long").alias("by")
        many = fit.join(single.where("NOT single").select("skey"), "skey", "left_semi").select("row", by)
        best = materialize(many.unionByName(single.where("single").select("x.row", by)), "mix-flips")
        if best.isEmpty():
            break
        cum = cum.join(best, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by")
        cum = materialize(cum, "mix-copies")
    return cum.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "skey", F.col("h").alias("row"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() says, with docs' own columns, whatever their names.

    Rows that share doc_id, source and text are taken for one: it comes as often as all of them together.
    """
    row, n, i = fresh(docs.columns, "row", "n", "i")
    got = mix(docs.select("doc_id", "text", "source"), **options).groupBy(F.col("row").alias(row)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    # one of equal rows before the shuffle; the join then finds the texts dealt out by row
    rows = docs.withColumn(row, F.xxhash64("doc_id", "source", "text")).dropDuplicates([row]).join(got, row)
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
