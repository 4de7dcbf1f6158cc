"""Synthetic federations: linear and pairwise signals on a few informative features, labels of a target cardinality, skewed silos."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(rows: int, features: int, labels: int, silos: int, informative: int = 10, cardinality: float = 2.0, alpha: float = 0.5, interaction: float = 0.0, seed: int = 0) -> dict[str, np.ndarray]:
    """x, y, silo, test, informative. For sizes that one process holds."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, features))
    own = np.sort(rng.choice(features, min(informative, features), replace=False))
    linear = x[:, own] @ rng.standard_normal((len(own), labels))
    pairs = x[:, own] * x[:, np.roll(own, 1)] @ rng.standard_normal((len(own), labels))
    z = (1 - interaction) * standard(linear) + interaction * standard(pairs)
    shift = bisect(z, cardinality)
    y = (rng.random((rows, labels)) < 1 / (1 + np.exp(-(3 * z + shift)))).astype(np.int8)
    p = rng.dirichlet(np.full(silos, alpha), labels)
    score = y @ p + np.where(y.any(1), 0, 1.0)[:, None]
    silo = (rng.random(rows)[:, None] * score.sum(1, keepdims=True) > np.cumsum(score, 1)).sum(1).clip(0, silos - 1)
    return {"x": x, "y": y, "silo": silo, "test": rng.random(rows) < 0.25, "informative": own}


def standard(z: np.ndarray) -> np.ndarray:
    return (z - z.mean(0)) / np.where(z.std(0) > 0, z.std(0), 1)


def bisect(z: np.ndarray, cardinality: float) -> float:
    """The shift at which the expected number of labels a row is the target."""
    lo, hi = -30.0, 30.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if (1 / (1 + np.exp(-(3 * z + mid)))).sum(1).mean() < cardinality:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def as_rows(spark: SparkSession, data: dict[str, np.ndarray]) -> DataFrame:
    rows = [(i, int(s), "val" if t else "train", x.tolist(), y.tolist()) for i, (s, t, x, y) in enumerate(zip(data["silo"], data["test"], data["x"], data["y"].astype(int), strict=True))]
    return spark.createDataFrame(rows, "row_id long, silo int, split string, x array<double>, y array<int>")


def scaled_out(spark: SparkSession, rows: int, features: int, labels: int, silos: int, informative: int = 5, seed: int = 0) -> DataFrame:
    """The same kind of rows made on the executors, of any number: every value is a hash of its row and place."""
    w = np.random.default_rng(seed).standard_normal((labels, informative))

    def normal(i) -> F.Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed + k), "id", i), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for k in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])

    t = spark.range(rows).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), normal))
    y = [F.when(sum((F.col("x")[j] * float(v) for j, v in enumerate(row)), F.lit(0.0)) > 1.0, 1).otherwise(0) for row in w]
    return t.select(F.col("id").alias("row_id"), F.pmod(F.xxhash64(F.lit(seed + 7), "id"), F.lit(silos)).cast("int").alias("silo"), F.when(F.pmod(F.xxhash64(F.lit(seed + 8), "id"), F.lit(4)) == 0, "val").otherwise("train").alias("split"), "x", F.array(*y).alias("y"))


def write_prefold(rows: DataFrame, path: str, folds: int) -> None:
    """Folds of a federation: of fold i the rows with hash i are the test, the others are for training and validation. Written as one folder a fold and part."""
    own = F.pmod(F.xxhash64("row_id"), F.lit(folds)).cast("int")
    t = rows.withColumn("own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("part", F.when(F.col("own") == F.col("fold"), "test").otherwise("trainval"))
    t.drop("own").write.mode("overwrite").partitionBy("fold", "part").parquet(path)


def read_prefold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
