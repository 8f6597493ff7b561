"""Mixing sources to target weights by entropy balancing, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, drop_scratch, materialize, text_of

#: Steps of the dual; bisection alone would settle in as many.
STEPS = 60
#: A source is settled when its expected words are this near to its target.
TOLERANCE = 1e-7
#: Classes of the rounding threshold in a source.
CLASSES = 4096
#: Documents of over a 40th of a source's words are rounded first, then those of over a 400th; the rest makes up for them.
TIERS = (40, 400)
SEED = 20_011
COMPUTED = ("size", "source_size", "target", "rate", "copies")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources: ``sizes`` has src, total; returns src, total, target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; a target stops at
    ``cap`` times its source's size and the excess is shared anew by weight until none is above. That fixed point fills
    sources in order of cap/weight, so two running sums find it without a loop. One row for each source goes through
    the window; documents do not.
    """
    by_name = Window.orderBy(F.col("src").isNull(), F.encode("src", "utf-8"))
    ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("k"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    t = t.withColumns({"w": F.element_at(turn, (F.col("k") % len(weights) + 1).cast("int")), "most": F.col("total") * F.lit(float(cap))})
    t = t.withColumns({
        "left": F.sum("total").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "wleft": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    level = F.col("left") / F.col("wleft")
    t = t.withColumn("full", F.col("most") <= F.col("w") * level)
    # the first source that isn't full sets the level of all after it
    order = F.struct((F.col("most") / F.col("w")).alias("r"), "k")
    t = t.withColumn("level", F.min_by(F.when(~F.col("full"), level), F.when(~F.col("full"), order)).over(everything))
    return t.select("src", "total", F.when(F.col("full") | F.col("level").isNull(), F.col("most")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _tilt(lam, x, cap: float):
    """Rate of a document: exponential in its size, at most ``cap``."""
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def balance(cells: DataFrame, targets: DataFrame, cap: float = 3.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Solve for each source the dual of: least sum of w log w - w over documents, with sum of size * w = target, w <= cap.

    Its solution is w = min(cap, exp(lambda * size / mean size)). ``cells`` (src, size, docs) holds how many documents of
    a source have a size; each step is one distributed pass over it that sums the constraint and its slope for each
    source, then a Newton step on lambda kept inside a bracket (bisection where Newton leaves it). Terms are summed as
    decimals, so the order of summation can't change a result. ``targets`` has src, total, target and one row for each
    source. Returns src, mean, lam; lam is null where every rate is the cap.
    """
    mean = cells.groupBy("src").agg((F.sum(F.col("size") * F.col("docs")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("docs")).otherwise(0)), F.lit(1))).alias("mean"))
    state = targets.join(mean, targets["src"].eqNullSafe(mean["src"]), "inner").select(
        targets["src"], "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        ((F.col("target") >= F.col("total") * cap * (1 - 1e-9)) | (F.col("total") == 0)).alias("full"), F.lit(False).alias("done"),
    )
    state = materialize(state, "dual")
    for _ in range(steps):
        c, s = cells.alias("c"), state.filter(~F.col("full") & ~F.col("done")).alias("s")
        x = F.col("c.size") / F.col("s.mean")
        w = _tilt(F.col("s.lam"), x, cap)
        words = F.col("c.size") * F.col("c.docs")
        slope = F.when(w < cap, words * w * x).otherwise(0.0)
        sums = c.join(s, F.col("c.src").eqNullSafe(F.col("s.src"))).groupBy(F.col("s.src").alias("src2")).agg(
            F.sum((words * w).cast("decimal(38,9)")).cast("double").alias("got"), F.sum(slope.cast("decimal(38,9)")).cast("double").alias("slope"))
        t = state.join(sums, F.col("src").eqNullSafe(F.col("src2")) & ~F.col("full") & ~F.col("done"), "left")
        off = F.col("got") - F.col("target")
        near = F.coalesce(F.abs(off) <= F.col("target") * tolerance, F.lit(True))
        t = t.withColumns({"lo": F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.greatest(F.lit(-8.0), F.least(F.lit(8.0), off / F.col("slope"))))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        tight = F.coalesce(F.col("hi") - F.col("lo") <= 1e-12 * (1 + F.abs(F.col("hi"))), F.lit(False))
        done = F.col("full") | F.col("done") | near | tight
        nxt = materialize(t.select("src", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), "lo", "hi", "full", done.alias("done")), "dual")
        drop_scratch(state)
        state = nxt
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise ArithmeticError(f"the dual of some source is not solved after {steps} steps")
    return state.select("src", "mean", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = SEED) -> DataFrame:
    """Copies of each document, so that each source's words come near its target.

    Returns the input's columns, then size (words of the text; 0 for null), source_size, target, rate and copies (0 to
    ``cap``), which take the place of input columns of the same names; one row for each input row. Rates come from
    :func:`balance`. Rounding gives a document floor(rate) copies and one more if v = u - frac(rate) is below its source's
    threshold, u being a uniform hash of id and seed. The threshold is near 0 and is set from a histogram of v by source
    (``CLASSES`` classes, so its size is bounded): the class limit at which the words taken come nearest the target, for
    large documents first and then for smaller ones (``TIERS``), which make up for what is left. It needs no order over
    documents, and reruns agree. A source of no words takes none; rows that repeat an id are treated alike; a null source
    is a source.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("src"), F.regexp_count(text_of(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long").alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    narrow = materialize(rows.select("id", "src", "size"), "sizes")
    cells = materialize(narrow.groupBy("src", "size").agg(F.count(F.lit(1)).alias("docs")), "cells")
    totals = cells.groupBy("src").agg(F.sum(F.col("size") * F.col("docs")).alias("total"))
    targets = materialize(source_targets(totals, weights, cap), "targets")
    dual = balance(cells, targets, cap)
    per = materialize(targets.alias("t").join(dual.alias("d"), F.col("t.src").eqNullSafe(F.col("d.src"))).select("t.src", "total", "target", "mean", "lam"), "sources")

    hist = _rounded(narrow, per, cap, seed).groupBy("src", "tier", "cls").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("base")).alias("base_words"),
        F.sum((F.col("rate") * F.col("size")).cast("decimal(38,9)")).alias("due"), F.max("target").alias("target"))
    whole = Window.partitionBy("src", "tier")
    run = whole.orderBy("cls").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.when(F.col("cls") < CLASSES // 2, F.col("words")).otherwise(0)).over(run)
    hist = hist.withColumns({"plain": F.sum("base_words").over(whole), "got": F.sum("base_words").over(whole) + upto})
    hist = materialize(hist, "classes")
    done = per.select("src", F.lit(0).cast("long").alias("taken"))
    for tier in range(len(TIERS) + 1):
        later = hist.filter(F.col("tier") > tier).groupBy("src").agg(F.sum("due").cast("double").alias("later"))
        h, d, r = hist.filter(F.col("tier") == tier).alias("h"), done.alias("d"), later.alias("r")
        due = h.join(d, F.col("h.src").eqNullSafe(F.col("d.src"))).join(r, F.col("h.src").eqNullSafe(F.col("r.src")), "left")
        e = _edges(due.select("h.*", (F.col("target") - F.col("taken") - F.coalesce("later", F.lit(0.0))).alias("goal"))).select(F.col("src").alias("esrc"), F.col("edge").alias(f"edge{tier}"), F.col("taken").alias("more"))
        done = materialize(done.join(e, F.col("src").eqNullSafe(F.col("esrc")), "left").select("src", (F.col("taken") + F.coalesce("more", F.lit(0))).alias("taken")), "taken")
        per = per.join(e.drop("more"), F.col("src").eqNullSafe(F.col("esrc")), "left").drop("esrc")
    per = materialize(per, "edges")
    edge = F.coalesce(F.element_at(F.array(*[f"edge{t}" for t in range(len(TIERS) + 1)]), F.col("tier") + 1), F.lit(-CLASSES))
    extra = (F.col("cls") <= edge) & (F.col("base") < cap)
    return _rounded(rows, per, cap, seed).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in COMPUTED],
        "size", F.col("total").alias("source_size"), "target", "rate", (F.col("base") + F.when(extra, 1).otherwise(0)).cast("int").alias("copies"),
    )


def _edges(hist: DataFrame) -> DataFrame:
    """For each source the last class that is taken (-CLASSES: none) to come nearest its goal, and the words taken then."""
    off, none = F.abs(F.col("got") - F.col("goal")), F.abs(F.col("plain") - F.col("goal"))
    best = hist.groupBy("src").agg(F.min(F.struct(off.alias("off"), "cls", "got")).alias("best"), F.min(none).alias("none"), F.max("plain").alias("plain"))
    some = F.col("best.off") < F.col("none")
    return materialize(best.select("src", F.when(some, F.col("best.cls")).otherwise(F.lit(-CLASSES)).alias("edge"), F.when(some, F.col("best.got")).otherwise(F.col("plain")).alias("taken")), "edge")


def _rounded(frame: DataFrame, per: DataFrame, cap: int, seed: int) -> DataFrame:
    """``frame`` (id, src, size, ...) with its source's row of ``per``, rate, base = floor(rate), cls, the class of v, and
    tier, the number of ``TIERS`` that a document's part of its source's words stays below."""
    t = frame.alias("f").join(per.alias("p"), F.col("f.src").eqNullSafe(F.col("p.src"))).drop(per["src"])
    rate = F.when(F.col("total") == 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(_tilt(F.col("lam"), F.col("size") / F.col("mean"), cap))
    t = t.withColumn("rate", rate).withColumn("base", F.floor("rate"))
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    half = CLASSES // 2
    cls = F.floor((u - (F.col("rate") - F.col("base"))) * half)
    t = t.withColumn("tier", sum((F.col("size") * k <= F.col("total")).cast("int") for k in TIERS))
    return t.withColumn("cls", F.when(F.col("base") >= cap, F.lit(half)).otherwise(cls))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; null texts have none, a null source is a source, rows that
    repeat an id are treated alike."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")
