"""Which silos a round waits for: quorum, deadline, tiers, replay and measured rounds. Tables of silos: (round, silo, size, latency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import arithmetic_hash, f1


def tiers(silos: DataFrame, names: list[str]) -> DataFrame:
    """Tiers in turn, by silo."""
    n = F.row_number().over(W.orderBy("silo")) - 1
    return silos.withColumn("tier", F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int")))


def latency(size: Column, tier: Column, factors: dict[str, float], per_row: float, comm: float) -> Column:
    speed = F.create_map(*(F.lit(x) for kv in factors.items() for x in kv))
    return F.element_at(speed, tier) * per_row * size + comm


def quorum(silos: DataFrame, share: float, order: str = "resource") -> DataFrame:
    """Silos in the order of latency for their size (resource), latency (fast) or a hash (uniform) until their sizes reach the share; the one that crosses it counts."""
    key = {"resource": F.round(F.col("latency") / F.col("size"), 9), "fast": F.col("latency"), "uniform": arithmetic_hash(F.col("silo") * 31 + F.col("round"))}[order]
    w = W.partitionBy("round")
    before = F.coalesce(F.sum("size").over(w.orderBy(key, "silo").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return silos.withColumn("before", before).withColumn("all", F.sum("size").over(w)).filter(F.col("before") < share * F.col("all")).drop("before", "all")


def deadline(silos: DataFrame, quantile: float) -> DataFrame:
    """Silos no slower than the quantile of all latencies of the round; all if that leaves none."""
    limit = silos.groupBy("round").agg(F.percentile("latency", quantile).alias("limit"))
    j = silos.join(limit, "round").withColumn("ok", (F.col("latency") <= F.col("limit")).cast("int"))
    return j.withColumn("some", F.max("ok").over(W.partitionBy("round"))).filter("ok = 1 OR some = 0").drop("limit", "ok", "some")


def subset_f1(counters: DataFrame, responders: DataFrame) -> DataFrame:
    """(round, macro, micro) of the responders' counters. counters: (round, silo, l, tp, fp, fn)."""
    c = counters.join(responders.select("round", "silo"), ["round", "silo"], "left_semi")
    t = c.groupBy("round", "l").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    one = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    all_ = f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return t.groupBy("round").agg(F.avg(one).alias("macro"), all_.alias("micro"))


def replay(counters: DataFrame, silos: DataFrame, policies: dict[str, DataFrame]) -> DataFrame:
    """(policy, mae, participation, critical_path): each policy's responders against all silos, over the rounds."""
    whole = subset_f1(counters, silos).select("round", F.col("macro").alias("full"))
    n = silos.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for name, chosen in policies.items():
        s = chosen.groupBy("round").agg(F.max("latency").alias("slowest"), F.count(F.lit(1)).alias("m")).join(n, "round").join(whole, "round").join(subset_f1(counters, chosen), "round")
        row = s.agg(F.avg(F.abs(F.col("macro") - F.col("full"))).alias("mae"), F.avg(F.col("m") / F.col("n")).alias("participation"), F.sum("slowest").alias("critical_path")).select(F.lit(name).alias("policy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def measured_rounds(replies: DataFrame, silos: int, needed: int) -> DataFrame:
    """(mean_quorum, sd_quorum, mean_full, speedup) of rounds with all replies: a round ends with the needed-th fastest. replies: (round, silo, took in seconds, or null)."""
    w = W.partitionBy("round")
    t = replies.withColumn("r", F.row_number().over(w.orderBy("took", "silo"))).groupBy("round").agg(
        F.count("took").alias("n"), F.max(F.when(F.col("r") == needed, F.col("took"))).alias("q"), F.max("took").alias("f"))
    t = t.filter(F.col("n") == silos)
    return t.agg(F.avg("q").alias("mean_quorum"), F.stddev_samp("q").alias("sd_quorum"), F.avg("f").alias("mean_full"), F.avg(F.col("f") / F.col("q")).alias("speedup"))
