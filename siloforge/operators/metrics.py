"""Federation-level metrics from counters, objectives, and row-level multi-label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import divide, f1, geometric_mean, harmonic_mean

def counted_f1() -> Column:
    return f1(F.col("tp"), F.col("fp"), F.col("fn"))


def totals(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the counters over the silos, per label."""
    return counters.groupBy(*(by or []), "l").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def micro_f1(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    t = counters.groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return t.select(*(by or []), counted_f1().alias("micro_f1"))


def label_f1(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    return totals(counters, by).withColumn("f1", counted_f1())


def macro_f1(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over all labels; labels that never occur count 0."""
    return label_f1(counters, by).groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"))


def client_f1(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(silo, micro_f1, macro_f1, local_macro_f1): the last over the labels that the silo has at all, 0 without any."""
    own = counters.withColumn("f1", counted_f1())
    t = own.groupBy(*(by or []), "silo").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))).alias("m"))
    return t.select(*(by or []), "silo", counted_f1().alias("micro_f1"), "macro_f1", F.coalesce("m", F.lit(0.0)).alias("local_macro_f1"))


def dispersion(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Over the silos: mean, population deviation and worst of macro-F1, and the same and the tenth percentile of local-support macro-F1."""
    c = client_f1(counters, by)
    return c.groupBy(*(by or [])).agg(
        F.avg("macro_f1").alias("mean_macro"), F.stddev_pop("macro_f1").alias("std_macro"), F.min("macro_f1").alias("worst_macro"), F.avg("local_macro_f1").alias("mean_local"),
        F.stddev_pop("local_macro_f1").alias("std_local"), F.min("local_macro_f1").alias("worst_local"), F.percentile("local_macro_f1", 0.1).alias("p10_local"))


def hamming(counters: DataFrame, n_val: int | Column) -> DataFrame:
    n = n_val if isinstance(n_val, Column) else F.lit(n_val)
    return counters.groupBy().agg((F.sum(F.col("fp") + F.col("fn")) / (n * F.countDistinct("l"))).alias("hamming"))


def objectives(counters: DataFrame, n_selected: int, n_features: int, n_val: int, mode: str = "global") -> DataFrame:
    """All minimised: 1 - macro, 1 - micro, share of features, Hamming loss, 1 - geometric and 1 - harmonic mean. mode local_avg averages the silos' own F1 instead. An empty mask gives 1, 1, 0."""
    if mode == "local_avg":
        m = client_f1(counters).agg(F.avg("macro_f1").alias("macro"), F.avg("micro_f1").alias("micro"))
    else:
        m = macro_f1(counters).crossJoin(micro_f1(counters)).select(F.col("macro_f1").alias("macro"), F.col("micro_f1").alias("micro"))  # one row each
    m = m.crossJoin(hamming(counters, n_val))
    return m.select(
        (1 - F.col("macro")).alias("o_macro"), (1 - F.col("micro")).alias("o_micro"), F.lit(n_selected / n_features).alias("o_ratio"), F.col("hamming").alias("o_hamming"),
        (1 - geometric_mean(F.col("macro"), F.col("micro"))).alias("o_gmean"), (1 - harmonic_mean(F.col("macro"), F.col("micro"))).alias("o_hmean"))


def hamming_loss(scored: DataFrame) -> DataFrame:
    """scored: (row_id, l, v, p, pred)."""
    return scored.agg(F.avg((F.col("pred") != F.col("v")).cast("double")).alias("hamming_loss"))


def subset_loss(scored: DataFrame) -> DataFrame:
    wrong = scored.groupBy("row_id").agg(F.max((F.col("pred") != F.col("v")).cast("int")).alias("w"))
    return wrong.agg(F.avg("w").alias("zero_one_loss"))


def one_error(scored: DataFrame) -> DataFrame:
    """Share of rows whose most probable label is wrong; the first of equals counts."""
    top = scored.withColumn("r", F.row_number().over(W.partitionBy("row_id").orderBy(F.col("p").desc(), "l"))).filter("r = 1")
    return top.agg(F.coalesce(F.avg(1 - F.col("v")), F.lit(0.0)).alias("one_error"))


def ranking_loss(scored: DataFrame) -> DataFrame:
    """Mean share of (present, absent) label pairs in the wrong order; rows without such pairs count 0. Counted by window, without pairs."""
    w = W.partitionBy("row_id").orderBy(F.col("p").desc()).rangeBetween(W.unboundedPreceding, 0)
    t = scored.withColumn("above", F.sum(1 - F.col("v")).over(w))  # absent labels that score at least as high
    r = t.groupBy("row_id").agg(F.sum(F.when(F.col("v") == 1, F.col("above")).otherwise(0)).alias("bad"), F.sum("v").alias("pos"), F.sum(1 - F.col("v")).alias("neg"))
    return r.agg(F.avg(divide(F.col("bad").cast("double"), F.col("pos") * F.col("neg"))).alias("ranking_loss"))


def label_ranking_precision(scored: DataFrame) -> DataFrame:
    """Mean over rows of the mean, over present labels, of the share of present ones among those that score at least as high; 1 for rows with all labels or none."""
    w = W.partitionBy("row_id").orderBy(F.col("p").desc()).rangeBetween(W.unboundedPreceding, 0)
    t = scored.withColumn("hits", F.sum("v").over(w)).withColumn("all", F.count(F.lit(1)).over(w))
    r = t.groupBy("row_id").agg(F.avg(F.when(F.col("v") == 1, F.col("hits") / F.col("all"))).alias("ap"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return r.agg(F.avg(F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("ap"))).alias("avg_precision"))


def message_bytes(rounds: DataFrame) -> DataFrame:
    """rounds: (clients, n_selected, n_features, n_labels). Adds bytes down (the shorter of a bit set and an index list), up (three counters a label) and messages."""
    down = F.least(F.ceil(F.col("n_features") / 8), 4 * F.col("n_selected")) * F.col("clients")
    return rounds.select("*", down.cast("long").alias("down"), (12 * F.col("n_labels") * F.col("clients")).cast("long").alias("up"), (2 * F.col("clients")).cast("long").alias("messages"))


def calibrated(scored: DataFrame, grid: list[float]) -> DataFrame:
    """(l, threshold, f1): for each label the threshold of the grid with the best F1, the smallest of equals; 0.5 for labels that never occur."""
    g = scored.select("l", "v", "p", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    s = F.col("p") >= F.col("t")
    c = g.groupBy("l", "t").agg(F.count_if(s & (F.col("v") == 1)).alias("tp"), F.count_if(s & (F.col("v") == 0)).alias("fp"), F.count_if(~s & (F.col("v") == 1)).alias("fn"))
    c = c.withColumn("f1", counted_f1()).withColumn("r", F.row_number().over(W.partitionBy("l").orderBy(F.round("f1", 9).desc(), "t"))).filter("r = 1")
    none = F.col("tp") + F.col("fn") == 0
    return c.select("l", F.when(none, 0.5).otherwise(F.col("t")).alias("threshold"), "f1")
