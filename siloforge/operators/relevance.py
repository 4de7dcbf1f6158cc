"""Feature relevance from sums that silos can share, and masks from rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import arithmetic_hash, finite


def class_moments(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, l, j, n, pos, s, q, s1): counts and sums of the training rows, per label and feature; s1 sums the rows that carry the label. Pairs of a row's features and its present labels are summed map-side."""
    by = ["silo"] if by is None else by
    t = rows.filter("split = 'train'")
    x = t.select(*by, F.posexplode("x").alias("j", "v")).groupBy(*by, "j").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    y = t.select(*by, F.posexplode("y").alias("l", "w")).groupBy(*by, "l").agg(F.sum("w").alias("pos"))
    present = F.filter(F.transform("y", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    xy = t.select(*by, F.explode(present).alias("l"), "x").select(*by, "l", F.posexplode("x").alias("j", "v")).groupBy(*by, "l", "j").agg(F.sum("v").alias("s1"))
    full = (x.join(y, by) if by else x.crossJoin(F.broadcast(y)))  # y: one row a label
    return full.join(xy, [*by, "l", "j"], "left").fillna(0.0, ["s1"])


def sketch(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(l, j, r): the standardised difference of a feature's means with and without a label, over the sums of all silos. weights: (silo, w)."""
    m = class_moments(rows)
    m = m.join(weights, "silo") if weights is not None else m.withColumn("w", F.lit(1.0))
    t = m.groupBy("l", "j").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "pos", "s", "q", "s1")))
    pos, neg = F.greatest(F.col("pos"), F.lit(1.0)), F.greatest(F.col("n") - F.col("pos"), F.lit(1.0))
    var = F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(1e-9))
    return t.select("l", "j", finite(F.abs(F.col("s1") / pos - (F.col("s") - F.col("s1")) / neg) / F.sqrt(var)).alias("r"))


def global_relevance(sketch_: DataFrame) -> DataFrame:
    return sketch_.groupBy("j").agg(F.avg("r").alias("r"))


def anova(rows: DataFrame) -> DataFrame:
    """(silo, j, rel): F statistics of each label, summed over the labels that are neither absent nor everywhere in the silo."""
    m = class_moments(rows).filter("pos > 0 AND pos < n")
    n, n1, s, s1, q = (F.col(c) for c in ("n", "pos", "s", "s1", "q"))
    ssb = s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n
    m = m.withColumn("ssb", ssb).withColumn("ssw", q - s * s / n - F.col("ssb"))
    f = F.when((F.col("ssw") > 1e-12) & (n > 2), F.col("ssb") / (F.col("ssw") / (n - 2))).otherwise(0.0)
    return m.groupBy("silo", "j").agg(F.sum(f).alias("rel"))


def federated_rank(local: DataFrame, sizes: DataFrame) -> DataFrame:
    """(j, rel): local relevance weighted by the silos' sizes. local: (silo, j, rel); sizes: (silo, n)."""
    return local.join(sizes, "silo").groupBy("j").agg((F.sum(F.col("n") * F.col("rel")) / F.sum("n")).alias("rel"))


def redundancy(rows: DataFrame) -> DataFrame:
    """(i, j, r), i < j: absolute Pearson correlation over the training rows, 0 for constant features. A task sums its rows' outer products in one matrix, so a shuffle has the upper triangle of a matrix a task, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, None, None
        for batch in batches:
            lists = batch.column("x")
            if len(lists):
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                n += len(x)
                sums = x.sum(0) if sums is None else sums + x.sum(0)
                gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            i, j = np.triu_indices(len(sums), 1)
            square = np.diag(gram)
            cols = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), *(pa.array(v) for v in (sums[i], sums[j], square[i], square[j], gram[i, j]))]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "n", "sa", "sb", "qa", "qb", "ab"])

    part = rows.filter("split = 'train'").select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "i int, j int, n long, sa double, sb double, qa double, qb double, ab double")
    m = part.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")))
    n = F.col("n")
    cov, va, vb = n * F.col("ab") - F.col("sa") * F.col("sb"), n * F.col("qa") - F.col("sa") * F.col("sa"), n * F.col("qb") - F.col("sb") * F.col("sb")
    return m.select("i", "j", F.when((va > 1e-9) & (vb > 1e-9), F.abs(cov / F.sqrt(va * vb))).otherwise(0.0).alias("r"))


def histogram_information(rows: DataFrame, bins: int = 8) -> DataFrame:
    """(l, j, mi): mutual information of a label and a feature cut into equal-width bins over the training rows."""
    t = rows.filter("split = 'train'").select("y", F.posexplode("x").alias("j", "v"))
    span = t.groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    c = t.join(span, "j").select("j", bin_.alias("b"), F.posexplode("y").alias("l", "w")).groupBy("l", "j", "b", "w").agg(F.count(F.lit(1)).cast("double").alias("c"))
    w = lambda *by: F.sum("c").over(W.partitionBy("l", "j", *by))
    p = c.select("l", "j", "c", w().alias("n"), w("b").alias("nb"), w("w").alias("nw"))
    return p.groupBy("l", "j").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("nb") * F.col("nw")))).alias("mi"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: shifted up by the recurrence to where the asymptotic series is exact to some 12 digits."""
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(10):
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def within(line: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of each v, how many of the ascending line are not below it, and at most r above it by their difference (v + r may round to a neighbour that is farther)."""
    hi = np.searchsorted(line, v + r, "right")
    last = line[np.maximum(hi - 1, 0)]
    hi = np.where((hi > 0) & (last - v > r), np.searchsorted(line, last, "left"), hi)
    after = line[np.minimum(hi, len(line) - 1)]
    hi = np.where((hi < len(line)) & (after - v <= r), np.searchsorted(line, after, "right"), hi)
    return hi - np.searchsorted(line, v, "left")


def information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of numbers and classes, by nearest neighbours: a number's distance to the k-th nearest of its class, and how many of all are nearer than that (or as near as nothing, itself among them). Classes of one member don't count; at least 0."""
    radius, size, used = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        if len(own) < 2:
            continue
        order = own[np.argsort(x[own], kind="stable")]
        v, near = x[order], min(k, len(own) - 1)
        wide = np.concatenate([np.full(near, -np.inf), v, np.full(near, np.inf)])
        at = np.arange(len(v)) + near
        radius[order] = np.min([np.maximum(v - wide[at - s], wide[at + near - s] - v) for s in range(near + 1)], axis=0)
        size[order], used[order] = len(own), near
    some = size > 0
    if not some.any():
        return 0.0
    line, v, r = np.sort(x[some]), x[some], np.nextafter(radius[some], 0)
    n = int(some.sum())
    inside = within(line, v, r) + within(-line[::-1], -v, r) - (np.searchsorted(line, v, "right") - np.searchsorted(line, v, "left"))
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(used[some]).mean() - digamma(size[some]).mean() - digamma(np.maximum(inside, 1)).mean()))


def neighbour_information(rows: DataFrame, k: int = 3) -> DataFrame:
    """(silo, l, j, mi): in each silo, the mutual information of a label and a feature over the training rows, by nearest neighbours. A task holds a silo."""
    kind = rows.schema["silo"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row_id")
        x, y = (np.array(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1) for c in ("x", "y"))
        l, j = (a.ravel() for a in np.meshgrid(np.arange(y.shape[1]), np.arange(x.shape[1]), indexing="ij"))  # noqa: E741
        mi = [information(x[:, b], y[:, a], k) for a, b in zip(l.tolist(), j.tolist(), strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(l), t.schema.field("silo").type), pa.array(l.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(mi, pa.float64())], names=["silo", "l", "j", "mi"])

    return rows.filter("split = 'train'").select("silo", "row_id", "x", "y").groupBy("silo").applyInArrow(run, f"silo {kind}, l int, j int, mi double")


def label_ranks(sketch_: DataFrame) -> DataFrame:
    """(l, j, rank) by falling relevance, then feature."""
    return sketch_.select("l", "j", F.row_number().over(W.partitionBy("l").orderBy(F.round("r", 9).desc(), "j")).alias("rank"))


def ranking_mask(scores: DataFrame, ratio: float, n_features: int, score: str = "rel") -> DataFrame:
    """(j): the top max(1, round(ratio D)) features, rounding half to even."""
    k = max(1, round(ratio * n_features))
    return scores.orderBy(F.round(score, 9).desc(), "j").limit(k).select("j")


def local_top(local: DataFrame, k: int) -> DataFrame:
    """(silo, j) of each silo's top k."""
    r = F.row_number().over(W.partitionBy("silo").orderBy(F.round("rel", 9).desc(), "j"))
    return local.withColumn("rank", r).filter(F.col("rank") <= k).select("silo", "j")


def top_votes(local: DataFrame, k: int) -> DataFrame:
    """(j, votes): in how many silos a feature is among the top k."""
    return local_top(local, k).groupBy("j").agg(F.count(F.lit(1)).alias("votes"))


def document_frequency(rows: DataFrame, ratio: float, n_features: int) -> DataFrame:
    """(j, df): the features that are positive in the most rows."""
    df = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum((F.col("v") > 0).cast("long")).alias("df"))
    return df.orderBy(F.col("df").desc(), "j").limit(max(1, round(ratio * n_features)))


def random_mask(spine: DataFrame, k: int, seed: int) -> DataFrame:
    """(j): k features in the order of a portable hash."""
    return spine.orderBy(arithmetic_hash(F.col("j"), seed), "j").limit(k).select("j")


def greedy_selection(relevance: list[float], redundant: list[list[float]], k: int) -> list[int]:
    """Features chosen one by one for relevance less mean redundancy with those chosen; the first of equals."""
    chosen: list[int] = []
    load = [0.0] * len(relevance)
    while len(chosen) < min(k, len(relevance)):
        free = [j for j in range(len(relevance)) if j not in chosen]
        best = max(free, key=lambda j: (round(relevance[j] - load[j] / max(len(chosen), 1), 9), -j))
        chosen.append(best)
        for j in range(len(load)):
            load[j] += redundant[best][j]
    return chosen


def greedy_mask(rows: DataFrame, n_features: int, ratio: float, cap: int = 6000) -> list[int]:
    """Mutual information against redundancy; D values and D^2 correlations come to the driver, so D is capped: above it, an error."""
    if n_features > cap:
        raise ValueError(f"{n_features} features; the greedy mask takes {cap} at most")
    mi = {r[0]: r[1] for r in histogram_information(rows).groupBy("j").agg(F.sum("mi")).collect()}
    red = [[0.0] * n_features for _ in range(n_features)]
    for i, j, r in redundancy(rows).collect():
        red[i][j] = red[j][i] = r
    return greedy_selection([mi.get(j, 0.0) for j in range(n_features)], red, max(1, round(ratio * n_features)))
