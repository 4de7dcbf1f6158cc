"""Sums that hide their terms, noise, and sums that survive bad silos. Counter tables: (silo, pos, v) or (silo, l, tp, fp, fn)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import arithmetic_hash, fixed_point
from siloforge.operators.metrics import macro_f1

RING, BLOCK = "18446744073709551616", 4096


def ring(x: Column) -> Column:
    return F.pmod(x.cast("decimal(38,0)"), F.lit(RING).cast("decimal(38,0)"))


def scrambled(a: np.ndarray) -> np.ndarray:
    """XXH64's last mixing of 64 bits, in place."""
    t = a >> np.uint64(33)
    a ^= t
    a *= np.uint64(0xC2B2AE3D27D4EB4F)
    np.right_shift(a, np.uint64(29), out=t)
    a ^= t
    a *= np.uint64(0x165667B19E3779F9)
    np.right_shift(a, np.uint64(32), out=t)
    a ^= t
    return a


def pair_masks(first: np.ndarray, second: np.ndarray, same: bool, size: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Modulo 2^64: for each of first the sum of its masks with all of second, and for each of second that with all of first, taken off. A pair's mask is its two keys, mixed. same: both are of the same silos, and the pairs are those of an earlier and a later one."""
    plus, minus = np.zeros(len(first), np.uint64), np.zeros(len(second), np.uint64)
    step = max(1, size // max(len(second), 1))
    for i in range(0, len(first), step):
        m = scrambled(first[i : i + step, None] ^ second[None, i * same :])
        if same:
            m[np.tri(*m.shape, dtype=bool)] = 0
        plus[i : i + step] += m.sum(1, dtype=np.uint64)
        minus[i * same :] -= m.sum(0, dtype=np.uint64)
    return plus, minus


def masked(values: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """(silo, pos, v): each silo's values plus a mask for every other silo that has the position, modulo 2^64. A pair's mask comes from both sides' keys, added by the earlier and taken off by the later.

    The masks number as the square of the silos. A position's silos are dealt out in blocks; a task makes the masks of two blocks as arrays and gives each silo's sum of them, so no pairs are joined or shuffled.
    """
    kinds = [values.schema[c].dataType.simpleString() for c in ("silo", "pos")]
    v = values.groupBy("silo", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    blocks = v.groupBy("pos").agg(F.greatest(F.lit(1), F.ceil(F.count("silo") / block)).cast("int").alias("blocks"))
    key = lambda side: F.xxhash64(F.lit(seed), F.lit(side), "silo", "pos")
    own = v.filter("silo IS NOT NULL").join(blocks, "pos").select("silo", "pos", key(0).alias("first"), key(1).alias("second"), F.pmod(F.xxhash64("silo"), "blocks").cast("int").alias("own"), "blocks")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("silo", "pos", "first", "second", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def tile(k: tuple, t: pa.Table) -> pa.Table:
        pos, lo, hi = (x.as_py() for x in k)
        t = t.sort_by([("first", "ascending"), ("second", "ascending")])
        at, first, second = (t.column(c).to_numpy() for c in ("own", "first", "second"))
        a, b = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        sums = np.zeros(len(at), np.uint64)
        plus, minus = pair_masks(first[a].view(np.uint64), second[b].view(np.uint64), lo == hi)
        sums[a] += plus
        sums[b] += minus
        return pa.table([t.column("silo"), t.column("pos"), pa.array(sums.view(np.int64))], names=["silo", "pos", "m"])

    tiles = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = dealt.repartition(tiles, "pos", "lo", "hi").groupBy("pos", "lo", "hi").applyInArrow(tile, f"silo {kinds[0]}, pos {kinds[1]}, m long")
    m = sums.groupBy("silo", "pos").agg(F.sum(F.col("m").cast("decimal(38,0)")).alias("m"))
    return v.join(m, ["silo", "pos"], "left").select("silo", "pos", ring(F.col("v") + F.coalesce("m", F.lit(0).cast("decimal(38,0)"))).alias("v"))


def secure_sum(values: DataFrame, seed: int = 2024) -> DataFrame:
    """(pos, total): the masks cancel; totals above 2^63 are negative."""
    t = masked(values, seed).groupBy("pos").agg(ring(F.sum("v")).alias("s"))
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return t.select("pos", F.when(F.col("s") >= half, F.col("s") - F.lit(RING).cast("decimal(38,0)")).otherwise(F.col("s")).cast("long").alias("total"))


def secure_moments(values: DataFrame, bits: int = 20) -> DataFrame:
    """(mean, std) of one number a silo, from secure sums of it and its square in fixed point. values: (silo, x)."""
    x = F.col("x")
    both = values.select("silo", F.lit(0).alias("pos"), fixed_point(x, bits).alias("v")).unionByName(values.select("silo", F.lit(1).alias("pos"), fixed_point(x * x, bits).alias("v")))
    k = values.agg(F.count("x").alias("k"))
    s = secure_sum(both).groupBy().agg(*(F.sum(F.when(F.col("pos") == p, F.col("total"))).alias(f"s{p}") for p in (0, 1))).crossJoin(k)  # one row each
    m = F.col("s0") / float(1 << bits) / F.col("k")
    return s.select(m.alias("mean"), F.sqrt(F.greatest(F.col("s1") / float(1 << bits) / F.col("k") - m * m, F.lit(0.0))).alias("std"))


def gaussian_sigma(labels: int, epsilon: Column, delta: float) -> Column:
    return F.lit(math.sqrt(labels) * math.sqrt(2 * math.log(1.25 / delta))) / epsilon


def noisy_counters(counters: DataFrame, epsilons: list[float], trials: int, delta: float, seed: int) -> DataFrame:
    """(epsilon, trial, silo, l, tp, fp, fn): counters with Gaussian noise, cut off at 0."""
    labels = counters.select("l").distinct().count()
    t = counters.withColumn("epsilon", F.explode(F.array(*map(F.lit, epsilons)))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    sigma = gaussian_sigma(labels, F.col("epsilon"), delta)

    def normal(k: int) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed + k), F.lit(i), "epsilon", "trial", "silo", "l"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for i in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])

    return t.select("epsilon", "trial", "silo", "l", *(F.greatest(F.col(c) + sigma * normal(k), F.lit(0.0)).alias(c) for k, c in enumerate(("tp", "fp", "fn"))))


def drop_farthest(counters: DataFrame, f: int) -> DataFrame:
    """(l, tp, fp, fn) without the f silos whose total is farthest from the median total; what is left is not scaled up."""
    mass = counters.groupBy("silo").agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn")).alias("mass"))
    mid = mass.agg(F.median("mass").alias("mid"))
    r = F.row_number().over(W.orderBy(F.abs(F.col("mass") - F.col("mid")), "silo"))
    ok = mass.crossJoin(mid).withColumn("r", r).withColumn("k", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).filter(F.col("r") <= F.col("k") - f)  # mid: one row
    return counters.join(ok.select("silo"), "silo", "left_semi").groupBy("l").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def flooded(counters: DataFrame, victims: list[int]) -> DataFrame:
    """Corrupts some silos: no hits, and false counts of a label's share of the silo's total each."""
    mass = F.sum(F.col("tp") + F.col("fp") + F.col("fn")).over(W.partitionBy("silo"))
    share = F.greatest(F.lit(1), F.call_function("div", mass, F.count(F.lit(1)).over(W.partitionBy("silo"))))
    bad = F.col("silo").isin(victims)
    t = counters.withColumn("share", share)
    return t.select("silo", "l", F.when(bad, 0).otherwise(F.col("tp")).cast("long").alias("tp"), *(F.when(bad, F.col("share")).otherwise(F.col(c)).cast("long").alias(c) for c in ("fp", "fn")))


def alarms(counters: DataFrame, known: DataFrame) -> DataFrame:
    """(silo, alarm): whether tp + fn contradicts the known positives of a label, or tp + fp exceeds the rows. known: (silo, l, p, n)."""
    j = counters.join(known, ["silo", "l"])
    return j.groupBy("silo").agg(F.bool_or((F.col("tp") + F.col("fn") != F.col("p")) | (F.col("tp") + F.col("fp") > F.col("n"))).alias("alarm"))


def groupwise(counters: DataFrame, groups: int, f: int) -> DataFrame:
    """(l, tp, fp, fn): silos are summed in groups, the f groups whose total for each member is farthest from the median are dropped; null with fewer than 2 f + 1 groups."""
    pos = counters.select("silo").distinct().withColumn("g", (F.row_number().over(W.orderBy(arithmetic_hash(F.col("silo")), "silo")) - 1) % groups)
    c = counters.join(pos, "silo")
    mass = c.groupBy("g").agg((F.sum(F.col("tp") + F.col("fp") + F.col("fn")) / F.countDistinct("silo")).alias("mass"))
    mid = mass.agg(F.median("mass").alias("mid"), F.count(F.lit(1)).alias("k"))
    ok = mass.crossJoin(mid).withColumn("r", F.row_number().over(W.orderBy(F.abs(F.col("mass") - F.col("mid")), "g"))).filter(F.col("r") <= F.col("k") - f)  # mid: one row
    t = c.join(ok.select("g", "k"), "g").groupBy("l", "k").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    return t.select("l", *(F.when(F.col("k") >= 2 * f + 1, F.col(x)).alias(x) for x in ("tp", "fp", "fn")))


def payload(population: int, labels: int, silos: int) -> dict[str, int]:
    """Bytes of a generation's masked counters from one silo, and of one silo's set-up messages."""
    return {"payload": population * 3 * labels * 8, "setup": (silos - 1) * 32}


def release_error(counters: DataFrame, epsilons: list[float], trials: int, delta: float, seed: int) -> DataFrame:
    """(epsilon, error): mean absolute difference of macro-F1 from noisy and from true counters, over the trials."""
    true = macro_f1(counters).select(F.col("macro_f1").alias("true"))
    noisy = macro_f1(noisy_counters(counters, epsilons, trials, delta, seed), ["epsilon", "trial"])
    return noisy.join(F.broadcast(true), F.lit(True)).groupBy("epsilon").agg(F.avg(F.abs(F.col("macro_f1") - F.col("true"))).alias("error"))
