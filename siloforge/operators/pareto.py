"""Pareto fronts, crowding, hypervolume, budgets and early stopping, over tables of solutions (i, o0, o1, ...), all objectives minimised."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.session import cut

FRONT_ROWS = 4096

def dominates(objectives: list[str], a: str = "a", b: str = "b") -> Column:
    no_worse = reduce(lambda x, y: x & y, (F.col(f"{a}.{o}") <= F.col(f"{b}.{o}") for o in objectives))
    better = reduce(lambda x, y: x | y, (F.col(f"{a}.{o}") < F.col(f"{b}.{o}") for o in objectives))
    return no_worse & better


def local_front(solutions: DataFrame, objectives: list[str]) -> DataFrame:
    """The solutions that none of their own partition dominates. Whatever dominates one of the others is dominated by, or is, one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 2 * FRONT_ROWS:
                held = undominated(held).to_batches()
        if held:
            yield from undominated(held).to_batches()

    def undominated(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        x = np.stack([t.column(o).cast(pa.float64()).to_numpy() for o in objectives], axis=1)
        order, keep = np.lexsort(x.T[::-1]), np.ones(len(x), bool)  # whatever dominates a solution comes before it
        for at, i in enumerate(order.tolist()):
            if keep[i]:
                rest = order[at + 1 :]
                rest = rest[keep[rest]]
                keep[rest[(x[i] <= x[rest]).all(1) & (x[i] < x[rest]).any(1)]] = False
        return t.filter(pa.array(keep))

    return solutions.mapInArrow(run, solutions.schema)


def front(solutions: DataFrame, objectives: list[str]) -> DataFrame:
    """The solutions that none dominates; equal ones stay together. Only the fronts of the partitions are compared with each other."""
    local = local_front(solutions, objectives)
    return local.alias("b").join(local.alias("a"), dominates(objectives), "left_anti")


def dominance_counts(solutions: DataFrame, objectives: list[str]) -> DataFrame:
    j = solutions.alias("b").join(solutions.alias("a"), dominates(objectives), "left")
    return j.groupBy(F.col("b.i").alias("i")).agg(F.count(F.col("a.i")).alias("dominated_by"))


def front_ranks(solutions: DataFrame, objectives: list[str]) -> DataFrame:
    """(i, rank): fronts peeled one by one. A round takes the undominated rest and is cut from its lineage."""
    rest, rank, out = cut(solutions, "rest"), 0, None
    while not rest.isEmpty():
        top = cut(front(rest, objectives).select("i").withColumn("rank", F.lit(rank)), "front")
        out = top if out is None else out.unionByName(top)
        rest = cut(rest.join(top, "i", "left_anti"), "rest")
        rank += 1
    return out if out is not None else solutions.select("i").withColumn("rank", F.lit(0))


def crowding(solutions: DataFrame, objectives: list[str], by: str | None = None) -> DataFrame:
    """(i, distance): per objective the gap between a solution's neighbours over the range, summed; null (infinite) at the ends. Objectives without a range add nothing."""
    part = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    out = solutions
    for o in objectives:
        w = part.orderBy(o, "i")
        span = F.max(o).over(part) - F.min(o).over(part)
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        out = out.withColumn(f"__{o}", F.when(span > 0, gap / span).otherwise(F.when(gap.isNull(), gap).otherwise(0.0)))
    total = reduce(lambda x, y: x + y, (F.col(f"__{o}") for o in objectives))
    return out.select(*([by] if by else []), "i", total.alias("distance"))


def blended_order(crowded: DataFrame, risk: DataFrame, blend: float) -> DataFrame:
    """(i, place): by crowding distance less blend times the risk's z-score in units of the range of the finite distances (1 if they have none); infinite distances first."""
    span = F.max("distance") - F.min("distance")
    all_ = crowded.join(risk, "i").agg(F.when(span > 0, span).otherwise(1.0).alias("span"), F.avg("risk").alias("mean"), F.stddev_pop("risk").alias("sd"))
    t = crowded.join(risk, "i").crossJoin(F.broadcast(all_))  # one row
    key = F.col("distance") - blend * F.col("span") * F.when(F.col("sd") > 0, (F.col("risk") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    t = t.withColumn("key", F.round(key, 9))
    return t.select("i", F.row_number().over(W.orderBy(F.col("distance").isNotNull(), F.col("key").desc(), "i")).alias("place"))


def hypervolume2(points: DataFrame, x: str, y: str, ref: tuple[float, float], by: list[str] | None = None) -> DataFrame:
    """(hv): the area that the points dominate below the reference: a sweep by x with the best y so far."""
    p = points.filter((F.col(x) < ref[0]) & (F.col(y) < ref[1]))
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(x, y)
    best = F.coalesce(F.min(y).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(ref[1]))
    part = (F.lit(ref[0]) - F.col(x)) * F.greatest(best - F.col(y), F.lit(0.0))
    return p.withColumn("part", part).groupBy(*(by or [])).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("hv"))


def hypervolume3(points: DataFrame, x: str, y: str, z: str, ref: tuple[float, float, float]) -> DataFrame:
    """(hv): slices between neighbouring distinct x, each the area of the points up to it."""
    p = points.filter((F.col(x) < ref[0]) & (F.col(y) < ref[1]) & (F.col(z) < ref[2])).select(F.col(x).alias("px"), F.col(y).alias("py"), F.col(z).alias("pz")).distinct()
    cuts = p.select(F.col("px").alias("sx")).distinct()
    cuts = cuts.withColumn("width", F.lead("sx", 1, ref[0]).over(W.orderBy("sx")) - F.col("sx"))
    area = hypervolume2(p.join(cuts, F.col("px") <= F.col("sx")), "py", "pz", ref[1:], ["sx", "width"])
    return area.agg(F.coalesce(F.sum(F.col("hv") * F.col("width")), F.lit(0.0)).alias("hv"))


def capped_front(solutions: DataFrame, cap: float) -> DataFrame:
    """Solutions with at most cap selected features; all of them if there are none."""
    some = F.max((F.col("selected") <= cap).cast("int")).over(W.partitionBy(F.lit(0)))
    return solutions.withColumn("__some", some).filter((F.col("__some") == 0) | (F.col("selected") <= cap)).drop("__some")


def best_per_budget(solutions: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget, i, o0, selected): for each budget the best solution that keeps it, by objective, size and number. Budgets that none keeps are left out."""
    j = budgets.join(solutions, F.col("selected") <= F.col("budget"))
    r = F.row_number().over(W.partitionBy("budget").orderBy("o0", "selected", "i"))
    return j.withColumn("r", r).filter("r = 1").select("budget", "i", "o0", "selected")


def early_stop(history: DataFrame, window: int, tolerance: float, patience: int) -> DataFrame:
    """(gen, stagnant, stop): the mean hypervolume of the last generations against the same number before; a relative gain below the tolerance is stagnant, and so many stagnant generations in a row stop the search."""
    w = W.orderBy("gen")
    last, before = F.avg("hv").over(w.rowsBetween(-window + 1, 0)), F.avg("hv").over(w.rowsBetween(-2 * window + 1, -window))
    full = F.row_number().over(w) >= 2 * window
    t = history.withColumn("flat", (full & ((last - before) / F.greatest(F.abs(before), F.lit(1e-12)) < tolerance)).cast("int"))
    t = t.withColumn("run", F.sum(1 - F.col("flat")).over(w))
    n = F.sum("flat").over(W.partitionBy("run").orderBy("gen"))
    return t.withColumn("stagnant", n).select("gen", "stagnant", (F.col("stagnant") >= patience).alias("stop"))
