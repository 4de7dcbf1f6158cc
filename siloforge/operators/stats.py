"""Statistics that compare methods over paired runs. Run tables: (dataset, method, seed, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, seed, d): differences of two methods over the seeds that both have."""
    x, y = (runs.filter(F.col("method") == m).select("dataset", "seed", F.col("value").alias(c)) for m, c in ((a, "va"), (b, "vb")))
    return x.join(y, ["dataset", "seed"]).select("dataset", "seed", (F.col("va") - F.col("vb")).alias("d"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(dataset, n, w_plus, w_minus): signed ranks of the differences that aren't 0, equal sizes sharing their mean rank."""
    t = pairs.filter(F.round("d", 12) != 0).withColumn("m", F.round(F.abs("d"), 12))
    rank = F.rank().over(W.partitionBy("dataset").orderBy("m")) + (F.count(F.lit(1)).over(W.partitionBy("dataset", "m")) - 1) / 2
    t = t.withColumn("rank", rank)
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))


def exact_p(w: float, n: int) -> float:
    """Two-sided p of a signed-rank sum without ties: over all signs, by counting sums of doubled ranks."""
    ways = [1] + [0] * (n * (n + 1))
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, 2 * r - 1, -1):
            ways[s] += ways[s - 2 * r]
    low = min(2 * w, n * (n + 1) - 2 * w)
    return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)


def wilcoxon_p(pairs: DataFrame) -> DataFrame:
    """wilcoxon() with the exact two-sided p."""

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([exact_p(a, int(b)) for a, b in zip(w, n, strict=True)])

    return wilcoxon(pairs).withColumn("p", p("w_plus", "n"))


def holm(tests: DataFrame) -> DataFrame:
    """(family, test, p, adjusted): step-down, running maximum of (m - rank + 1) p, at most 1."""
    w = W.partitionBy("family").orderBy("p", "test")
    m = F.count(F.lit(1)).over(W.partitionBy("family"))
    step = (m - F.row_number().over(w) + 1) * F.col("p")
    t = tests.withColumn("step", step)
    return t.select("family", "test", "p", F.least(F.lit(1.0), F.max("step").over(w)).alias("adjusted"))


def summary(runs: DataFrame, rollup: bool = False) -> DataFrame:
    """Mean, population deviation, least, median and largest value of each dataset and method; with rollup, also over datasets and over all."""
    g = runs.rollup("dataset", "method") if rollup else runs.groupBy("dataset", "method")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.median("value").alias("median"), F.max("value").alias("largest"))


def report(runs: DataFrame, methods: list[str]) -> DataFrame:
    """A row a dataset, a column a method: mean values."""
    return runs.groupBy("dataset").pivot("method", methods).agg(F.avg("value"))


def to_do(grid: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The points of a sweep that the report lacks."""
    return grid.join(done, key, "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(share): how many of a's distinct rows b has as well."""
    n, m = a.distinct().agg(F.count(F.lit(1)).alias("n")), a.intersect(b).agg(F.count(F.lit(1)).alias("m"))
    return n.crossJoin(m).select((F.col("m") / F.col("n")).alias("share"))  # one row each
