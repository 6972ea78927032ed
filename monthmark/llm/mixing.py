"""Mixing sources to target weights by entropy balancing.

The rates r of the documents of a source minimise sum(r log r - r + 1) under
sum(r * size) = target and r <= cap. The dual has one number for each source, and its
solution is the exponential tilt r = min(cap, exp(lambda * size / mean size)). Newton steps,
kept inside a bracket, find all numbers at once; a step is one grouped sum over the
distinct sizes of each source. Rates become whole copies by a threshold on a hash, which is
then moved for each source until the words taken are as near the target as single documents
allow: histograms of 4096 steps, each inside the chosen step of the one before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.llm.common import WORD, quoted, settle, written

#: Words of a source a rate may be off before rounding, as a share; limit of Newton steps
#: (bisection alone would get there), steps of a histogram and how many are nested.
TOLERANCE, MOST_STEPS, STEPS, LEVELS = 1e-7, 80, 4096, 3


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, sid, n, least, source_size, target): one row for each source.

    Weights repeat over the sources in code point order, null last. The total is shared by
    weight; what exceeds cap times a source's size is shared again among the others. That
    ends where all others stand at one level per weight, which is found directly.
    """
    per = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    # Windows without keys: one row for each source, already summed.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    everything = Window.partitionBy(F.lit(0))
    per = (per.withColumn("sid", rank)
           .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                         F.col("sid") % len(weights) + F.lit(0)
                                         + F.when(F.col("sid") % len(weights) == 0, len(weights)).otherwise(0)))
           .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
           .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything)))
    by_ratio = everything.orderBy(F.col("most") / F.col("w"), "sid")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"),
                         F.struct(F.col("most") / F.col("w"), F.col("sid"), F.col("level")))).over(everything)
    target = F.coalesce(F.least(F.col("most"), level["level"] * F.col("w")), F.col("most"))
    return per.withColumn("target", target).select("source", "sid", "n", "least", "source_size", "target")


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(lam * size / mean))


def tilts(sizes: DataFrame, per: DataFrame, cap: float) -> DataFrame:
    """(sid, mean, lam) for sources with a target below their cap; sizes: (sid, size, n)."""
    f_least = F.col("least") / F.col("mean")
    state = (per.where((F.col("target") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("source_size")))
             .withColumn("mean", F.col("source_size") / F.col("n"))
             .select("sid", "target", "mean", F.lit(0.0).alias("lam"), F.lit(False).alias("done"),
                     F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / f_least).alias("lo"),
                     (F.lit(math.log(cap)) / f_least).alias("hi")))
    state = written(state, "tilts")
    for _ in range(MOST_STEPS):
        exponent = F.col("lam") * F.col("size") / F.col("mean")
        mass = F.col("n") * F.col("size")
        slope = F.when(exponent < math.log(cap), mass * F.col("size") / F.col("mean") * F.exp(exponent))
        sums = (sizes.join(state.where(~F.col("done")), "sid").groupBy("sid").agg(
            F.sum(mass * _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)).alias("got"),
            F.coalesce(F.sum(slope), F.lit(0.0)).alias("slope")))
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - off / F.col("slope"))
        inside = (newton > lo) & (newton < hi)
        done = F.col("done") | (F.abs(off) <= TOLERANCE * F.col("target")) | (hi - lo < 1e-15)
        state = written(state.join(sums, "sid", "left").select(
            "sid", "target", "mean",
            F.when(done | F.col("got").isNull(), F.col("lam"))
            .when(inside, newton).otherwise((lo + hi) / 2).alias("lam"),
            F.coalesce(done, F.lit(True)).alias("done"),
            F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi")), "tilts")
        if state.where(~F.col("done")).isEmpty():
            break
    # Sums of doubles hang on the order of rows in their last digits; the rest of the mix must not.
    return state.select("sid", "mean", F.round("lam", 10).alias("lam"))


def _edges(docs: DataFrame, need: DataFrame, cap: int) -> DataFrame:
    """(sid, edge): the words of documents with mark < edge come nearest to what is needed.

    docs: (sid, size, mark); need: (sid, need).
    """
    name = "edges"
    state = written(need.select("sid", "need", F.lit(-float(cap)).alias("lo"), F.lit(float(cap)).alias("hi")), name)
    for level in range(LEVELS):
        width = (F.col("hi") - F.col("lo")) / STEPS
        step = F.floor((F.col("mark") - F.col("lo")) / width)
        bars = (docs.join(state, "sid")
                .where((F.col("mark") >= F.col("lo")) & (F.col("mark") < F.col("hi")))
                .groupBy("sid", F.least(step, F.lit(STEPS - 1)).alias("step")).agg(F.sum("size").alias("words")))
        # At most STEPS rows for each source.
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("step"))
        crossed = (bars.withColumn("upto", upto).join(state.select("sid", "need"), "sid")
                   .where(F.col("upto") > F.col("need"))
                   .groupBy("sid").agg(F.min(F.struct("step", "upto", "words")).alias("c"))
                   .select("sid", "c.*"))
        a = F.col("lo") + F.col("step") * width
        more = F.col("upto") - F.col("need")  # what taking the whole step overshoots
        less = F.col("words") - more
        last = level + 1 == LEVELS
        new = state.join(crossed, "sid", "left")
        if last:
            edge = (F.when(F.col("step").isNull(), F.col("hi")).when(more < less, a + width).otherwise(a))
            return written(new.select("sid", edge.alias("edge")), name)
        state = written(new.select(
            "sid", F.when(F.col("step").isNull(), F.col("need")).otherwise(less).alias("need"),
            F.when(F.col("step").isNull(), F.col("hi")).otherwise(a).alias("lo"),
            F.when(F.col("step").isNull(), F.col("hi") + 1e-9).otherwise(a + width).alias("hi")), name)
    raise AssertionError("LEVELS must be positive")


def _mixed(df: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], share: float, cap: int,
           keep: list[str]) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, k0, k1, ...) with the columns to keep."""
    if cap < 2 or cap != int(cap):
        raise ValueError("cap is a whole number of at least 2")
    settle(df.sparkSession)
    sized = written(df.select(
        F.col(quoted(key)).alias("key"), F.col(quoted(source)).alias("source"),
        F.coalesce(F.regexp_count(F.col(quoted(text)), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]), "sized")
    per = written(source_targets(sized.select("source", "size"), weights, share, cap), "targets")
    # The side of the sources has one row each; a hot source's rows are split by AQE if they shuffle.
    known = lambda left: left.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    sizes = written(known(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
                          .where(F.col("size") > 0).withColumnRenamed("n", "rows"))
                    .select("sid", "size", F.col("rows").alias("n")), "sizes")
    tilt = tilts(sizes, per, cap)
    settle(df.sparkSession)  # each step was a job with broadcasts of its own
    rate = (F.when(F.col("lam").isNotNull(), _rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
            .when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0))
    # A number in [0, 1) that hangs on the row alone.
    chance = F.shiftrightunsigned(F.xxhash64("key", "source", "size"), 11) / F.lit(float(1 << 53))
    # Copy j of a document is taken where its mark, chance - rate + j, is below an edge. At edge 0 these are
    # rate copies on average; moving the edge takes anything from no copy of the source to all.
    rated = (known(sized).join(tilt, "sid", "left").withColumn("rate", rate)
             .withColumn("tilted", F.col("lam").isNotNull() & (F.col("size") > 0)).withColumn("mark", chance - F.col("rate")))
    marked = (rated.where("tilted").select("sid", "size", "mark", F.explode(F.array(*[F.lit(j) for j in range(cap)])).alias("j"))
              .select("sid", "size", (F.col("mark") + F.col("j")).alias("mark")))
    coarse = _edges(marked, per.select("sid", F.col("target").alias("need")), cap).withColumnRenamed("edge", "coarse")
    settle(df.sparkSession)
    # One document can stand between the sum and the target. Documents no larger than what is
    # missing (or too much) are then decided anew by an edge of their own.
    words = lambda cond: F.sum(F.when(cond, F.col("size")).otherwise(0))
    taken = F.col("mark") < F.col("coarse")
    missing = written(marked.join(coarse, "sid").groupBy("sid", "coarse").agg(words(taken).alias("got"))
                      .join(per.select("sid", "target"), "sid")
                      .select("sid", "coarse", "target", F.abs(F.col("target") - F.col("got")).alias("gap")), "gaps")
    small = F.col("size") <= F.col("gap")
    left = written(marked.join(missing, "sid").groupBy("sid", "target", "coarse", "gap")
                   .agg(words(taken & ~small).alias("large"))
                   .select("sid", "coarse", "gap", (F.col("target") - F.col("large")).alias("need")), "left")
    fine = _edges(marked.join(left.select("sid", "gap"), "sid").where(small), left, cap)
    edges = written(left.join(fine, "sid").select("sid", "gap", "coarse", "edge"), "edges")
    edge = F.when(small, F.col("edge")).otherwise(F.col("coarse"))
    copies = sum((F.col("mark") + j < edge).cast("long") for j in range(cap))
    out = rated.join(edges, "sid", "left").withColumn(
        "copies", F.when(F.col("tilted"), copies).otherwise(F.when(F.col("target") > 0, F.lit(cap)).otherwise(0)).cast("long"))
    return out.select("key", "source", "size", "source_size", "target", "rate", "copies",
                      *[f"k{i}" for i in range(len(keep))])


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(key, size, source_size, target, rate, copies, taken) for each row.

    Size is the number of words, 0 for a null text. A null source is a source of its own.
    Sources without words have target 0; copies of documents without words are of no consequence.
    Copies depend on key, source and size only, so reruns and any partitioning
    agree, and rows that share all three share their copies.
    """
    return _mixed(df, key, text, source, weights, share, cap, []).select(
        F.col("key").alias(key), "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Each row as often as the mix takes it; all columns stay."""
    mixed = _mixed(df, key, text, source, weights, share, cap, df.columns)
    return (mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)]))
