"""Splitting rows over silos and splits. Draws are portable hashes of row ids, so reruns and other engines agree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import arithmetic_hash


BUCKETS, STRATUM_BUCKETS = 1 << 16, 1 << 12


def placed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Adds place (from 1) in hash order over all rows, and total. Rows are ranked inside hash buckets, and a table of the buckets' counts gives each bucket's first place, so no task orders all rows."""
    t = rows.withColumn("__h", arithmetic_hash(F.col("row_id"), seed))
    t = t.withColumn("__b", F.floor(F.col("__h") / (4294967296 // BUCKETS)).cast("int"))
    sizes = t.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))  # BUCKETS rows at most
    sizes = sizes.select("__b", (F.sum("__c").over(W.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(W.partitionBy(F.lit(0))).alias("total"))
    place = F.row_number().over(W.partitionBy("__b").orderBy("__h", "row_id")) + F.col("__before")
    return t.join(F.broadcast(sizes), "__b").withColumn("place", place).drop("__h", "__b", "__before")


def natural_val_split(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """split: int(share n) rows of all, in hash order, are val."""
    return placed(rows, seed).withColumn("split", F.when(F.col("place") <= F.floor(F.col("total") * share), "val").otherwise("train")).drop("place", "total")


def train_val_test(train: DataFrame, test: DataFrame, share: float = 0.25, seed: int = 0) -> DataFrame:
    """One table of a dataset that comes as train and test: int(share n) of the training rows are val."""
    return natural_val_split(train, share, seed).unionByName(test.withColumn("split", F.lit("test")))


def stratified_folds(rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """stratum, fold: a row's stratum is its rarest label over all rows (ties: the first; -1 without any), and each stratum's rows are dealt to the folds in turn, in hash order. So the rarest labels are spread evenly; nothing is ordered in one task but a hash bucket of a stratum."""
    often = {r["l"]: r["n"] for r in rows.select(F.posexplode("y").alias("l", "v")).groupBy("l").agg(F.sum("v").alias("n")).collect()}  # a row a label
    ranked = sorted(often, key=lambda k: (often[k], k))
    stratum = F.coalesce(*(F.when(F.element_at("y", k + 1) > 0, k) for k in ranked), F.lit(-1)) if ranked else F.lit(-1)
    t = rows.withColumn("stratum", stratum.cast("int")).withColumn("__h", arithmetic_hash(F.col("row_id"), seed))
    t = t.withColumn("__b", F.floor(F.col("__h") / (4294967296 // STRATUM_BUCKETS)).cast("int"))
    sizes = t.groupBy("stratum", "__b").agg(F.count(F.lit(1)).alias("__c"))  # STRATUM_BUCKETS rows a label at most
    sizes = sizes.withColumn("__before", F.sum("__c").over(W.partitionBy("stratum").orderBy("__b")) - F.col("__c")).drop("__c")
    place = F.row_number().over(W.partitionBy("stratum", "__b").orderBy("__h", "row_id")) + F.col("__before") - 1
    return t.join(sizes, ["stratum", "__b"]).withColumn("fold", (place % folds).cast("int")).drop("__h", "__b", "__before")


def silo_val_split(rows: DataFrame, share: float, seed: int = 0, at_least: int = 1) -> DataFrame:
    """split: of each silo max(at_least, int(share n)) rows are val."""
    w = W.partitionBy("silo")
    place = F.row_number().over(w.orderBy(arithmetic_hash(F.col("row_id"), seed), "row_id"))
    n = F.greatest(F.lit(at_least), F.floor(F.count(F.lit(1)).over(w) * share))
    return rows.withColumn("split", F.when(place <= n, "val").otherwise("train"))


def manifest(split_rows: DataFrame) -> DataFrame:
    """(silo, n_train, n_val) of silos with training rows."""
    m = split_rows.groupBy("silo").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return m.filter("n_train > 0")


def held_out_silos(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """(silo, held_out): the last max(1, round(share K)) silos in order, rounding half to even."""
    s = rows.select("silo").distinct()
    k = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return s.withColumn("held_out", F.row_number().over(W.orderBy(F.col("silo").desc())) <= F.greatest(F.lit(1.0), F.bround(k * share)))


def iid(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """client: k chunks of hash order, equal but for one row; the larger come first."""
    div = lambda a, b: F.call_function("div", a, b)
    size, rest, at = div(F.col("total"), F.lit(k)), F.col("total") % k, F.col("place") - 1
    large = rest * (size + 1)
    client = F.when(at < large, div(at, size + 1)).otherwise(rest + div(at - large, F.greatest(size, F.lit(1))))
    return placed(rows, seed).withColumn("client", client.cast("int")).drop("place", "total")


def quantity_counts(weights: list[float], n: int) -> list[int]:
    """How many of n rows each client gets: by weight, at least one, the rest to or from the largest."""
    w = np.asarray(weights, float)
    counts = np.maximum(1, np.floor(w / w.sum() * n).astype(int))
    while counts.sum() > n and counts.max() > 1:
        counts[counts.argmax()] -= 1
    counts[w.argmax()] += max(0, n - counts.sum())
    return counts.tolist()


def quantity_skew(rows: DataFrame, weights: list[float], seed: int = 0) -> DataFrame:
    """client: runs of hash order as long as the weights say."""
    counts = quantity_counts(weights, rows.count())
    bounds = np.cumsum(counts).tolist()
    client = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("place")))
    return placed(rows, seed).withColumn("client", client).drop("place", "total")


def label_skew(rows: DataFrame, probability: list[list[float]], seed: int = 0) -> DataFrame:
    """client: drawn with the sum over a row's labels of the label's client probabilities; evenly for rows without a label. probability[l][c] is a small parameter."""
    k = len(probability[0])
    p = F.array(*(F.array(*map(F.lit, row)) for row in probability))
    even = F.array(*[F.lit(1.0)] * k)
    has = F.aggregate("y", F.lit(0), lambda s, v: s + v) > 0
    score = F.when(has, F.transform(even, lambda _, c: F.aggregate(F.zip_with("y", p, lambda v, row: v * F.element_at(row, c + 1)), F.lit(0.0), lambda s, x: s + x))).otherwise(even)
    u = arithmetic_hash(F.col("row_id"), seed) / 4294967296.0
    t = rows.withColumn("score", score).withColumn("whole", F.aggregate("score", F.lit(0.0), lambda s, x: s + x))
    step = F.aggregate("score", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + F.when(s["sum"] + x <= u * F.col("whole"), 1).otherwise(0)).alias("at")))
    return t.withColumn("client", F.least(step["at"], F.lit(k - 1))).drop("score", "whole")


def natural(rows: DataFrame) -> DataFrame:
    """client: the silo's place in the order in which silos first appear (by row id)."""
    first = rows.groupBy("silo").agg(F.min("row_id").alias("f"))
    return rows.join(first.select("silo", (F.row_number().over(W.orderBy("f")) - 1).alias("client")), "silo")


def rebalanced(assigned: DataFrame, k: int, at_least: int) -> DataFrame:
    """Gives clients below the minimum the last rows of the largest: the moves are planned on the k counts, and made by each row's place in its client."""
    counts = {c: 0 for c in range(k)} | {r[0]: r[1] for r in assigned.groupBy("client").count().collect()}
    size, moves = dict(counts), []
    for c in sorted(size):
        while size[c] < at_least:
            donor = max(size, key=lambda x: (size[x], -x))
            if donor == c or size[donor] <= at_least:
                break
            moves.append((donor, size[donor], c))
            size[donor] -= 1
            size[c] += 1
    if not moves:
        return assigned
    plan = assigned.sparkSession.createDataFrame(moves, "client int, place int, to int")
    t = assigned.withColumn("place", F.row_number().over(W.partitionBy("client").orderBy("row_id")))
    return t.join(F.broadcast(plan), ["client", "place"], "left").withColumn("client", F.coalesce("to", "client")).drop("to", "place")


def summary(assigned: DataFrame) -> DataFrame:
    """(client, n, labels): sizes and how many labels occur."""
    l = F.filter(F.transform("y", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())  # noqa: E741
    return assigned.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set(l)))).cast("long").alias("labels"))


def stratified_split(y: np.ndarray, share: float, seed: int = 0) -> np.ndarray:
    """True for the rows of the second part: iterative stratification of multi-label rows. The rarest label left is dealt first, each of its rows to the part that wants that label most. For tables that fit one task."""
    rng = np.random.default_rng(seed)
    n, want = len(y), np.array([1 - share, share])
    room, need = want * n, want[:, None] * y.sum(0)[None, :]
    out, free = np.zeros(n, bool), np.ones(n, bool)
    while free.any():
        left = y[free].sum(0)
        if not left.any():
            for i in rng.permutation(np.flatnonzero(free)):
                part = int(room[1] > room[0])
                out[i], free[i] = bool(part), False
                room[part] -= 1
            break
        label = int(np.where(left > 0, left, n + 1).argmin())
        for i in np.flatnonzero(free & (y[:, label] == 1)):
            part = int((need[1, label], room[1]) > (need[0, label], room[0]))
            out[i], free[i] = bool(part), False
            need[part] -= y[i]
            room[part] -= 1
    return out
