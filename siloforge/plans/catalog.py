"""The registered queries of the engine, each beside the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions import columns as C
from siloforge.operators import knn, metrics, pareto, partition, relevance, scheduling, secure, stats
from siloforge.plans import fixtures as fx
from siloforge.plans.knn_sql import knn_sql
from siloforge.plans.literals import literal, literal_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEL16 = list(range(16))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


def a1(s: SparkSession, d: str) -> DataFrame:
    return knn.projected(fx.vectors_single(s, d), SEL16)


def a2(s: SparkSession, d: str) -> DataFrame:
    return knn.projected(fx.vectors_multi(s, d), SEL16)


A2, A1 = knn_sql("a2", SEL16), knn_sql("a1", SEL16)


def scored(rows: DataFrame) -> DataFrame:
    """(silo, row_id, l, v, p, pred) of the validation rows."""
    y = rows.filter("split = 'val'").select("silo", "row_id", F.posexplode("y").alias("l", "v"))
    return y.join(knn.predictions(rows), ["silo", "row_id", "l"], "left").fillna(0, ["pred"])


def a2_counters(s: SparkSession, d: str) -> DataFrame:
    rows = a2(s, d)
    return knn.counters(rows, knn.predictions(rows))


# --- sources and splits


@query("s01_sum_duplicates", f"WITH {literal_sql('duplicates')} SELECT row_id, j, sum(x) x FROM duplicates GROUP BY row_id, j")
def s01(s, d):
    return literal(s, "duplicates", d).groupBy("row_id", "j").agg(F.sum("x").alias("x"))


HASH = "((row_id % 1000003) * 2654435761 + 12345) % 4294967296"


@query("s05_natural_val_split", f"WITH {fx.FIXTURE_SQL['b']}, k AS (SELECT row_id, row_number() OVER (ORDER BY {HASH}, row_id) r, count(*) OVER () n FROM b) SELECT row_id, CASE WHEN r <= floor(n * 0.25) THEN 'val' ELSE 'train' END split FROM k")
def s05(s, d):
    return partition.natural_val_split(fx.orders_by_nation(s, d).drop("split"), 0.25).select("row_id", "split")


SPLIT = f"k AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY {HASH}, row_id) r, count(*) OVER (PARTITION BY silo) n FROM b)"


@query("s08_manifest", f"WITH {fx.FIXTURE_SQL['b']}, {SPLIT} SELECT silo, count(*) FILTER (WHERE r > greatest(1, floor(n * 0.25))) n_train, count(*) FILTER (WHERE r <= greatest(1, floor(n * 0.25))) n_val FROM k GROUP BY silo HAVING n_train > 0")
def s08(s, d):
    return partition.manifest(partition.silo_val_split(fx.orders_by_nation(s, d).drop("split"), 0.25))


@query("s09_json_counters", """SELECT 0 silo, CAST(l AS INT) l, tp FROM (SELECT unnest(range(0, 3)) l, unnest([3, 0, 7]) tp) UNION ALL SELECT 1, CAST(l AS INT), tp FROM (SELECT unnest(range(0, 3)) l, unnest([1, 2, 5]) tp)""")
def s09(s, d):
    t = s.createDataFrame([('{"client_id": 0, "tp": [3, 0, 7]}',), ('{"client_id": 1, "tp": [1, 2, 5]}',)], "js string")
    t = t.select(F.from_json("js", "client_id int, tp array<int>").alias("c"))
    return t.select(F.col("c.client_id").alias("silo"), F.posexplode("c.tp").alias("l", "tp"))


@query("s12_unpack_bits", f"WITH {literal_sql('packed')}, j AS (SELECT *, unnest(range(0, n_features)) j FROM packed) SELECT i, CAST(j AS INT) j FROM j WHERE (bytes[CAST(j // 8 + 1 AS INT)] >> CAST(7 - j % 8 AS INT)) & 1 = 1")
def s12(s, d):
    t = literal(s, "packed", d).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_features") - 1)))
    return t.filter(C.packed_bit(F.col("bytes"), F.col("j")) == 1).select("i", "j")


@query("s17_heldout_silos", f"WITH {fx.FIXTURE_SQL['b']}, s AS (SELECT DISTINCT silo FROM b) SELECT silo, row_number() OVER (ORDER BY silo DESC) <= greatest(1, round_even((SELECT count(*) FROM s) * 0.25, 0)) held_out FROM s")
def s17(s, d):
    return partition.held_out_silos(fx.orders_by_nation(s, d))


@query("s18_resplit", f"WITH {fx.FIXTURE_SQL['b']}, {SPLIT} SELECT row_id, silo, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'val' ELSE 'train' END split FROM k")
def s18(s, d):
    b = fx.orders_by_nation(s, d)
    pooled = b.filter("split = 'train'").unionByName(b.filter("split = 'val'")).drop("split")
    return partition.silo_val_split(pooled, 0.25).select("row_id", "silo", "split")


# --- projections and filters


@query("p01_mask_projection", f"WITH {fx.FIXTURE_SQL['a2']} SELECT row_id, round(x[1], 6) f0, round(x[4], 6) f3, round(x[8], 6) f7 FROM a2")
def p01(s, d):
    t = knn.projected(fx.vectors_multi(s, d), [0, 3, 7])
    return t.select("row_id", *(F.round(F.col("x")[i], 6).alias(f"f{j}") for i, j in enumerate((0, 3, 7))))


@query("p03_zero_prediction", f"WITH {fx.rows_sql('b')} SELECT silo, CAST(l AS INT) l, CAST(0 AS BIGINT) tp, CAST(0 AS BIGINT) fp, CAST(sum(v) AS BIGINT) fn FROM yl WHERE split = 'val' GROUP BY silo, l")
def p03(s, d):
    return knn.nothing_predicted(fx.orders_by_nation(s, d))


@query("p04_mask_repair", f"WITH {literal_sql('masks')} SELECT mask_id, CASE WHEN sel = '' THEN '0' ELSE sel END sel FROM masks")
def p04(s, d):
    sel = C.mask_list(F.col("sel"))
    return literal(s, "masks", d).select("mask_id", C.mask_string(F.when(F.size(sel) == 0, F.array(F.lit(0))).otherwise(sel)).alias("sel"))


@query("p06_usable_silos", f"WITH {fx.FIXTURE_SQL['c']}, ok AS (SELECT silo FROM c GROUP BY silo HAVING count(*) FILTER (WHERE split = 'train') >= 6 AND count(*) FILTER (WHERE split = 'val') >= 1) SELECT row_id, silo, split FROM c WHERE silo IN (SELECT silo FROM ok)")
def p06(s, d):
    return knn.usable_silos(fx.documents_by_source(s, d), 6, 1).select("row_id", "silo", "split")


@query("p09_single_label", A1 + "SELECT silo, row_id, CAST(l AS INT) l, pred FROM pred")
def p09(s, d):
    return knn.predictions(a1(s, d)).select("silo", "row_id", "l", "pred")


@query("p10_constant_labels", f"WITH {fx.rows_sql('b')} SELECT silo, CAST(l AS INT) l, CAST(sum(v) AS BIGINT) pos, count(*) n FROM yl WHERE split = 'train' GROUP BY silo, l HAVING sum(v) > 0 AND sum(v) < count(*)")
def p10(s, d):
    return knn.priors(fx.orders_by_nation(s, d)).filter("pos > 0 AND pos < n").select("silo", "l", "pos", "n")


CAPPED = f"WITH {literal_sql('solutions')}, f AS (SELECT * FROM solutions b WHERE NOT EXISTS (SELECT 1 FROM solutions a WHERE a.o0 <= b.o0 AND a.o1 <= b.o1 AND (a.o0 < b.o0 OR a.o1 < b.o1))), k AS (SELECT * FROM f WHERE selected <= 6 OR NOT EXISTS (SELECT 1 FROM f WHERE selected <= 6))"


@query("p11_capped_front", CAPPED + " SELECT i, o0, o1, selected FROM k")
def p11(s, d):
    f = pareto.front(literal(s, "solutions", d), ["o0", "o1"])
    return pareto.capped_front(f, 6).select("i", "o0", "o1", "selected")


@query("p12_docfreq_topk", f"WITH {fx.rows_sql('c')} SELECT CAST(j AS INT) j, CAST(sum(CAST(v > 0 AS INT)) AS BIGINT) df FROM xl GROUP BY j ORDER BY df DESC, j LIMIT 8")
def p12(s, d):
    return relevance.document_frequency(fx.documents_by_source(s, d), 0.3, 26)


@query("p15_min_size_clients", f"WITH {fx.FIXTURE_SQL['c']} SELECT silo FROM c GROUP BY silo HAVING count(*) FILTER (WHERE split = 'train') >= 11 AND count(*) FILTER (WHERE split = 'val') >= 1")
def p15(s, d):
    return knn.usable_silos(fx.documents_by_source(s, d), 11, 1).select("silo").distinct()


# --- joins


@query("j01_row_join", "SELECT source, CAST(sum(quality) AS BIGINT) good, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def j01(s, d):
    j = fx.table(s, d, "documents").select("doc_id", "source").join(fx.table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    return j.groupBy("source").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))


@query("j02_knn_train", A2 + "SELECT silo, row_id, nbr_id, CAST(rank AS INT) rank FROM near WHERE sp = 'train'")
def j02(s, d):
    return knn.neighbours(a2(s, d)).select("silo", "row_id", "nbr_id", "rank")


@query("j03_knn_query", A2 + "SELECT silo, row_id, nbr_id, CAST(rank AS INT) rank FROM near WHERE sp = 'val'")
def j03(s, d):
    return knn.neighbours(a2(s, d), of="val").select("silo", "row_id", "nbr_id", "rank")


@query("j04_knn_euclidean", f"""WITH {fx.FIXTURE_SQL['a2']}, p AS (SELECT row_id, silo, split, list_transform(range(1, 17), lambda j: x[j]) x FROM a2),
n AS (SELECT a.silo, a.row_id, b.row_id nbr_id, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.x, b.x) * list_distance(a.x, b.x), 9), b.row_id) rank
FROM p a JOIN p b ON a.silo = b.silo AND a.row_id <> b.row_id AND a.split = 'val' AND b.split = 'train') SELECT silo, row_id, nbr_id, CAST(rank AS INT) rank FROM n WHERE rank <= 5""")
def j04(s, d):
    return knn.neighbours(a2(s, d), of="val", metric="euclidean").select("silo", "row_id", "nbr_id", "rank")


@query("j06_ytx", f"WITH {fx.rows_sql('b')} SELECT CAST(yl.l AS INT) l, CAST(xl.j AS INT) j, round(sum(xl.v), 4) s FROM xl JOIN yl ON xl.row_id = yl.row_id WHERE yl.v = 1 AND xl.split = 'train' GROUP BY yl.l, xl.j")
def j06(s, d):
    return relevance.class_moments(fx.orders_by_nation(s, d), []).select("l", "j", F.round("s1", 4).alias("s"))


@query("j08_mask_broadcast", f"WITH {literal_sql('masks')} SELECT DISTINCT mask_id, CAST(vec_id % 8 AS INT) silo FROM masks, embeddings")
def j08(s, d):
    silos = fx.vectors_multi(s, d).select("silo").distinct()
    return silos.join(F.broadcast(literal(s, "masks", d).select("mask_id")), F.lit(True))


@query("j09_pareto", f"WITH {literal_sql('solutions')} SELECT i FROM solutions b WHERE NOT EXISTS (SELECT 1 FROM solutions a WHERE a.o0 <= b.o0 AND a.o1 <= b.o1 AND a.o2 <= b.o2 AND (a.o0 < b.o0 OR a.o1 < b.o1 OR a.o2 < b.o2))")
def j09(s, d):
    return pareto.front(literal(s, "solutions", d), ["o0", "o1", "o2"]).select("i")


BUDGET = f"WITH {literal_sql('solutions')}, {literal_sql('budgets')}, j AS (SELECT budget, i, o0, selected, row_number() OVER (PARTITION BY budget ORDER BY o0, selected, i) r FROM budgets JOIN solutions ON selected <= budget)"


@query("j10_budget_join", BUDGET + " SELECT budget, count(*) n FROM j GROUP BY budget")
def j10(s, d):
    return literal(s, "budgets", d).join(literal(s, "solutions", d), F.col("selected") <= F.col("budget")).groupBy("budget").agg(F.count(F.lit(1)).alias("n"))


@query("j11_zip_join", "SELECT CAST(i AS INT) pos, CAST(i AS INT) client, 'shard_' || i shard FROM (SELECT unnest(range(0, 4)) i)")
def j11(s, d):
    t = s.range(1).select(F.arrays_zip(F.array(*map(F.lit, range(4))).alias("client"), F.array(*(F.lit(f"shard_{i}") for i in range(4))).alias("shard")).alias("z"))
    return t.select(F.posexplode("z").alias("pos", "z")).select("pos", "z.client", "z.shard")


@query("j12_shared_silos", f"WITH {fx.FIXTURE_SQL['c']} SELECT silo, count(*) FILTER (WHERE split = 'train') n_train, count(*) FILTER (WHERE split = 'val') n_val, row_number() OVER (ORDER BY min(row_id)) - 1 client FROM c GROUP BY silo")
def j12(s, d):
    c = fx.documents_by_source(s, d)
    t, v = (c.filter(F.col("split") == k).groupBy("silo").agg(F.count(F.lit(1)).alias(f"n_{k}"), F.min("row_id").alias(f"f_{k}")) for k in ("train", "val"))
    j = t.join(v, "silo", "full").fillna(0, ["n_train", "n_val"])
    return j.select("silo", "n_train", "n_val", (F.row_number().over(W.orderBy(F.least("f_train", "f_val"))) - 1).cast("long").alias("client"))


@query("j13_paired_runs", f"WITH {literal_sql('runs')} SELECT a.dataset, a.seed, round(a.value - b.value, 6) d FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed WHERE a.method = 'aware' AND b.method = 'base'")
def j13(s, d):
    return stats.paired(literal(s, "runs", d), "aware", "base").select("dataset", "seed", r6("d"))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]
GRID_SQL = "[" + ", ".join(map(str, GRID)) + "]::DOUBLE[]"


@query("j15_threshold_grid", A2 + f"SELECT CAST(l AS INT) l, t, count(*) FILTER (WHERE round(p, 9) >= t AND v = 1) tp, count(*) FILTER (WHERE round(p, 9) >= t AND v = 0) fp FROM (SELECT l, v, p, unnest({GRID_SQL}) t FROM sco) GROUP BY l, t")
def j15(s, d):
    t = scored(a2(s, d)).select("l", "v", F.round("p", 9).alias("p"), F.explode(F.array(*map(F.lit, GRID))).alias("t"))
    hit = F.col("p") >= F.col("t")
    return t.groupBy("l", "t").agg(F.count_if(hit & (F.col("v") == 1)).alias("tp"), F.count_if(hit & (F.col("v") == 0)).alias("fp"))


@query("j16_redundancy", f"""WITH {fx.rows_sql('b')}, m AS (SELECT a.j i, b.j j, count(*) n, sum(a.v) sa, sum(b.v) sb, sum(a.v * a.v) qa, sum(b.v * b.v) qb, sum(a.v * b.v) ab FROM xl a JOIN xl b ON a.row_id = b.row_id AND a.j < b.j WHERE a.split = 'train' GROUP BY a.j, b.j)
SELECT CAST(i AS INT) i, CAST(j AS INT) j, round(CASE WHEN n * qa - sa * sa > 1e-9 AND n * qb - sb * sb > 1e-9 THEN abs((n * ab - sa * sb) / sqrt((n * qa - sa * sa) * (n * qb - sb * sb))) ELSE 0 END, 6) r FROM m""")
def j16(s, d):
    return relevance.redundancy(fx.orders_by_nation(s, d)).select("i", "j", r6("r"))


# --- counters and metrics


@query("a01_client_counters", A2 + "SELECT silo, CAST(l AS INT) l, tp, fp, fn FROM ctr")
def a01(s, d):
    return a2_counters(s, d).select("silo", "l", "tp", "fp", "fn")


@query("a01_single_label_counters", A1 + "SELECT silo, CAST(l AS INT) l, tp, fp, fn FROM ctr")
def a01b(s, d):
    rows = a1(s, d)
    return knn.counters(rows, knn.predictions(rows)).select("silo", "l", "tp", "fp", "fn")


@query("a02_global_counters", A2 + "SELECT CAST(l AS INT) l, tp, fp, fn FROM tot")
def a02(s, d):
    return metrics.totals(a2_counters(s, d))


@query("a03_micro_f1", A2 + "SELECT round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) micro_f1 FROM tot")
def a03(s, d):
    return metrics.micro_f1(a2_counters(s, d)).select(r6("micro_f1"))


@query("a04_macro_f1", A2 + "SELECT round(avg(f1), 6) macro_f1 FROM lf")
def a04(s, d):
    return metrics.macro_f1(a2_counters(s, d)).select(r6("macro_f1"))


@query("a05_label_f1", A2 + "SELECT CAST(l AS INT) l, round(f1, 6) f1 FROM lf")
def a05(s, d):
    return metrics.label_f1(a2_counters(s, d)).select("l", r6("f1"))


@query("a06_client_dispersion", A2 + "SELECT round(avg(macro_f1), 6) mean_macro, round(stddev_pop(macro_f1), 6) std_macro, round(min(macro_f1), 6) worst_macro FROM cli")
def a06(s, d):
    return metrics.dispersion(a2_counters(s, d)).select(r6("mean_macro"), r6("std_macro"), r6("worst_macro"))


@query("a07_local_support", A2 + "SELECT round(avg(local_macro_f1), 6) mean_local, round(stddev_pop(local_macro_f1), 6) std_local, round(min(local_macro_f1), 6) worst_local, round(quantile_cont(local_macro_f1, 0.1), 6) p10_local FROM cli")
def a07(s, d):
    return metrics.dispersion(a2_counters(s, d)).select(r6("mean_local"), r6("std_local"), r6("worst_local"), r6("p10_local"))


@query("a08_local_bias", A2 + "SELECT round((SELECT avg(f1) FROM lf) - avg(local_macro_f1), 6) bias FROM cli")
def a08(s, d):
    c = a2_counters(s, d)
    one = metrics.macro_f1(c).join(metrics.dispersion(c).select("mean_local"), F.lit(True))
    return one.select(F.round(F.col("macro_f1") - F.col("mean_local"), 6).alias("bias"))


OBJ = "SELECT round(1 - ma, 6) o_macro, round(1 - mi, 6) o_micro, round(16 / 59.0, 6) o_ratio, round(h, 6) o_hamming, round(1 - sqrt(ma * mi), 6) o_gmean, round(1 - CASE WHEN ma + mi > 0 THEN 2 * ma * mi / (ma + mi) ELSE 0 END, 6) o_hmean FROM "
HAM = "(SELECT CAST(sum(fp + fn) AS DOUBLE) / ((SELECT count(*) FROM r WHERE split = 'val') * count(DISTINCT l)) h FROM ctr)"


def n_val(s: SparkSession, d: str) -> int:
    return fx.vectors_multi(s, d).filter("split = 'val'").count()


@query("a09_objectives", A2 + OBJ + f"(SELECT (SELECT avg(f1) FROM lf) ma, (SELECT 2.0 * sum(tp) / sum(2 * tp + fp + fn) FROM tot) mi, {HAM} h)")
def a09(s, d):
    t = metrics.objectives(a2_counters(s, d), 16, 59, n_val(s, d))
    return t.select(*(r6(c) for c in t.columns))


@query("a09_objectives_local", A2 + OBJ + f"(SELECT (SELECT avg(macro_f1) FROM cli) ma, (SELECT avg(micro_f1) FROM cli) mi, {HAM} h)")
def a09b(s, d):
    t = metrics.objectives(a2_counters(s, d), 16, 59, n_val(s, d), "local_avg")
    return t.select(*(r6(c) for c in t.columns))


@query("a11_hamming", A2 + f"SELECT round({HAM}, 6) hamming")
def a11(s, d):
    return metrics.hamming(a2_counters(s, d), n_val(s, d)).select(r6("hamming"))


@query("a12_hamming_loss", A2 + "SELECT round(avg(CAST(pred <> v AS DOUBLE)), 6) hamming_loss FROM sco")
def a12(s, d):
    return metrics.hamming_loss(scored(a2(s, d))).select(r6("hamming_loss"))


@query("a13_ranking_loss", A2 + """, w AS (SELECT a.row_id, avg(CAST(round(b.p, 9) >= round(a.p, 9) AS DOUBLE)) x FROM sco a JOIN sco b ON a.row_id = b.row_id AND a.v = 1 AND b.v = 0 GROUP BY a.row_id)
SELECT round(coalesce(sum(x), 0) / (SELECT count(DISTINCT row_id) FROM sco), 6) ranking_loss FROM w""")
def a13(s, d):
    return metrics.ranking_loss(scored(a2(s, d)).withColumn("p", F.round("p", 9))).select(r6("ranking_loss"))


@query("a14_lrap", A2 + """, g AS (SELECT row_id, v, sum(v) OVER w hits, count(*) OVER w n FROM (SELECT row_id, l, v, round(p, 9) p FROM sco) WINDOW w AS (PARTITION BY row_id ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT row_id, avg(hits / n) FILTER (WHERE v = 1) ap, min(v) lo, max(v) hi FROM g GROUP BY row_id) SELECT round(avg(CASE WHEN lo = hi THEN 1 ELSE ap END), 6) avg_precision FROM h""")
def a14(s, d):
    return metrics.label_ranking_precision(scored(a2(s, d)).withColumn("p", F.round("p", 9))).select(r6("avg_precision"))


@query("a16_one_error", A2 + "SELECT round(avg(1 - v), 6) one_error FROM (SELECT v, row_number() OVER (PARTITION BY row_id ORDER BY round(p, 9) DESC, l) k FROM sco) WHERE k = 1")
def a16(s, d):
    return metrics.one_error(scored(a2(s, d)).withColumn("p", F.round("p", 9))).select(r6("one_error"))


@query("a17_subset_loss", A2 + "SELECT round(avg(w), 6) zero_one_loss FROM (SELECT row_id, max(CAST(pred <> v AS INT)) w FROM sco GROUP BY row_id)")
def a17(s, d):
    return metrics.subset_loss(scored(a2(s, d))).select(r6("zero_one_loss"))


@query("a18_label_counts", A2 + "SELECT silo, row_id, CAST(l AS INT) l, c FROM cnt WHERE sp = 'train'")
def a18(s, d):
    return knn.label_counts(knn.neighbours(a2(s, d)))


@query("a19_priors", A2 + "SELECT silo, CAST(l AS INT) l, n, pos, round(prior, 6) prior FROM pri")
def a19(s, d):
    return knn.priors(a2(s, d)).select("silo", "l", "n", "pos", r6("prior"))


@query("a20_mlknn_cond", A2 + "SELECT silo, CAST(l AS INT) l, CAST(c AS BIGINT) c, round(pt, 6) pt, round(pf, 6) pf FROM cond")
def a20(s, d):
    return knn.conditionals(a2(s, d)).select("silo", "l", F.col("c").cast("long").alias("c"), r6("pt"), r6("pf"))


@query("a21_posterior", A2 + "SELECT silo, row_id, CAST(l AS INT) l, round(p, 6) p FROM post")
def a21(s, d):
    return knn.posteriors(a2(s, d)).select("silo", "row_id", "l", r6("p"))


def folded(rows: DataFrame, folds: int = 3) -> DataFrame:
    """Each fold's rows as the validation rows of a copy of the silo: the silo's key becomes (silo, fold)."""
    f = knn.fold_of(rows.drop("split"), folds)
    every = f.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("folds").cast("int") - 1)))
    return every.withColumn("split", F.when(F.col("fold") == F.col("turn"), "val").otherwise("train")).withColumn("silo", (F.col("silo") * 1000 + F.col("turn")).cast("int")).select("row_id", "silo", "split", "x", "y")


@query("a23_client_cv", A2.replace("r AS (SELECT * FROM a2)", f"""h AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY {HASH}, row_id) - 1 i, count(*) OVER (PARTITION BY silo) n FROM a2),
u AS (SELECT *, unnest(range(0, 3)) turn FROM h), r AS (SELECT row_id, CAST(silo * 1000 + turn AS INT) silo, CASE WHEN ((i + 1) * 3 - 1) // n = turn THEN 'val' ELSE 'train' END split, x, y FROM u)""").replace("ON c.row_id = yl.row_id AND c.l = yl.l", "ON c.row_id = yl.row_id AND c.l = yl.l AND c.silo = yl.silo") + "SELECT CAST(silo // 1000 AS INT) silo, CAST(l AS INT) l, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM ctr GROUP BY silo // 1000, l")
def a23(s, d):
    rows = folded(a2(s, d))
    near = knn.counters(rows, knn.predictions(rows))
    return near.groupBy(F.call_function("div", F.col("silo"), F.lit(1000)).cast("int").alias("silo"), "l").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


# --- relevance

MOM = """m AS (SELECT x.silo, y.l, x.j, count(*) n, sum(y.v) pos, sum(x.v) s, sum(x.v * x.v) q, sum(x.v * y.v) s1 FROM xl x JOIN yl y ON x.row_id = y.row_id WHERE x.split = 'train' GROUP BY x.silo, y.l, x.j)"""
SKETCH = f"""WITH {fx.rows_sql('b')}, {MOM}, t AS (SELECT l, j, sum(n) n, sum(pos) pos, sum(s) s, sum(q) q, sum(s1) s1 FROM m GROUP BY l, j),
sk AS (SELECT l, j, abs(s1 / greatest(pos, 1) - (s - s1) / greatest(n - pos, 1)) / sqrt(greatest(q / n - (s / n) * (s / n), 1e-9)) r FROM t)"""


@query("a24_sketch", SKETCH + " SELECT CAST(l AS INT) l, CAST(j AS INT) j, round(r, 6) r FROM sk")
def a24(s, d):
    return relevance.sketch(fx.orders_by_nation(s, d)).select("l", "j", r6("r"))


@query("a24_global_relevance", SKETCH + " SELECT CAST(j AS INT) j, round(avg(r), 6) r FROM sk GROUP BY j")
def a24b(s, d):
    return relevance.global_relevance(relevance.sketch(fx.orders_by_nation(s, d))).select("j", r6("r"))


ANOVA = f"""WITH {fx.rows_sql('b')}, {MOM}, v AS (SELECT *, s1 * s1 / pos + (s - s1) * (s - s1) / (n - pos) - s * s / n ssb FROM m WHERE pos > 0 AND pos < n),
f AS (SELECT silo, j, sum(CASE WHEN q - s * s / n - ssb > 1e-12 AND n > 2 THEN ssb / ((q - s * s / n - ssb) / (n - 2)) ELSE 0 END) rel FROM v GROUP BY silo, j)"""


@query("a25_anova", ANOVA + " SELECT silo, CAST(j AS INT) j, round(rel, 4) rel FROM f")
def a25(s, d):
    return relevance.anova(fx.orders_by_nation(s, d)).select("silo", "j", F.round("rel", 4).alias("rel"))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.filter("split = 'train'").groupBy("silo").agg(F.count(F.lit(1)).alias("n"))


RANKED = ANOVA + ", z AS (SELECT silo, count(*) n FROM r WHERE split = 'train' GROUP BY silo), fr AS (SELECT j, sum(n * rel) / sum(n) rel FROM f JOIN z USING (silo) GROUP BY j)"


@query("a26_fed_rank", RANKED + " SELECT CAST(j AS INT) j, round(rel, 4) rel FROM fr")
def a26(s, d):
    b = fx.orders_by_nation(s, d)
    return relevance.federated_rank(relevance.anova(b), sizes(b)).select("j", F.round("rel", 4).alias("rel"))


@query("a27_histogram_mi", f"""WITH {fx.rows_sql('b')}, sp AS (SELECT j, min(v) lo, max(v) hi FROM xl WHERE split = 'train' GROUP BY j),
b8 AS (SELECT row_id, xl.j, CASE WHEN hi > lo THEN least(7, floor((v - lo) / (hi - lo) * 8)) ELSE 0 END b FROM xl JOIN sp USING (j) WHERE split = 'train'),
c AS (SELECT y.l, b8.j, b8.b, y.v w, CAST(count(*) AS DOUBLE) c FROM b8 JOIN yl y USING (row_id) GROUP BY ALL),
p AS (SELECT l, j, c, sum(c) OVER (PARTITION BY l, j) n, sum(c) OVER (PARTITION BY l, j, b) nb, sum(c) OVER (PARTITION BY l, j, w) nw FROM c)
SELECT CAST(l AS INT) l, CAST(j AS INT) j, round(sum(c / n * ln(c * n / (nb * nw))), 6) mi FROM p GROUP BY l, j""")
def a27(s, d):
    return relevance.histogram_information(fx.orders_by_nation(s, d)).select("l", "j", r6("mi"))


@query("a31_partition_summary", f"WITH {fx.rows_sql('b')} SELECT silo client, count(DISTINCT row_id) n, count(DISTINCT l) FILTER (WHERE v = 1) labels FROM yl GROUP BY silo")
def a31(s, d):
    return partition.summary(fx.orders_by_nation(s, d).withColumnRenamed("silo", "client"))


@query("a32_comm_bytes", f"WITH {literal_sql('rounds')} SELECT *, CAST(least(ceil(n_features / 8), 4 * n_selected) * clients AS BIGINT) down, CAST(12 * n_labels * clients AS BIGINT) up, CAST(2 * clients AS BIGINT) messages FROM rounds")
def a32(s, d):
    return metrics.message_bytes(literal(s, "rounds", d))


SUBSET = f"WITH {literal_sql('silos')}, {literal_sql('parts')}, rp AS (SELECT silo, l, tp, fp, fn, round FROM parts JOIN (SELECT DISTINCT round FROM silos) ON true)"
QUORUM = "qu AS (SELECT round, silo, size, latency FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY round ORDER BY round(latency / size, 9), silo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(size) OVER (PARTITION BY round) a FROM silos) WHERE b < 0.5 * a)"
F1SQL = "SELECT round, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END) macro, 2.0 * sum(tp) / sum(2 * tp + fp + fn) micro FROM (SELECT round, l, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM rp {join} GROUP BY round, l) GROUP BY round"


def round_counters(s: SparkSession, d: str) -> DataFrame:
    p = literal(s, "parts", d)
    silos = literal(s, "silos", d).select("round", "silo")
    rounds = silos.select("round").distinct()
    return p.join(F.broadcast(rounds), F.lit(True))


@query("a34_subset_f1", SUBSET + ", " + QUORUM + " SELECT round, round(macro, 6) macro, round(micro, 6) micro FROM (" + F1SQL.format(join="SEMI JOIN qu USING (round, silo)") + ")")
def a34(s, d):
    return scheduling.subset_f1(round_counters(s, d), scheduling.quorum(literal(s, "silos", d), 0.5)).select("round", r6("macro"), r6("micro"))


@query("a36_secure_sum", f"WITH {literal_sql('parts')} SELECT l pos, CAST(sum(tp) AS BIGINT) total FROM parts GROUP BY l")
def a36(s, d):
    return secure.secure_sum(literal(s, "parts", d).select("silo", F.col("l").alias("pos"), F.col("tp").alias("v")))


@query("a37_fixed_point", f"WITH {literal_sql('numbers')} SELECT silo, CAST(round_even(x * 1048576, 0) AS BIGINT) v FROM numbers")
def a37(s, d):
    return literal(s, "numbers", d).select("silo", C.fixed_point(F.col("x"), 20).alias("v"))


@query("a37_secure_moments", f"WITH {literal_sql('numbers')}, e AS (SELECT round_even(x * 1048576, 0) / 1048576 a, round_even(x * x * 1048576, 0) / 1048576 b FROM numbers) SELECT round(avg(a), 6) mean, round(sqrt(greatest(avg(b) - avg(a) * avg(a), 0)), 6) std FROM e")
def a37b(s, d):
    return secure.secure_moments(literal(s, "numbers", d)).select(r6("mean"), r6("std"))


@query("a38_dp_sigma", "SELECT epsilon, round(sqrt(5.0) * sqrt(2 * ln(1.25 / 1e-5)) / epsilon, 6) sigma FROM (SELECT unnest([0.5, 1.0, 2.0, 8.0]::DOUBLE[]) epsilon)")
def a38(s, d):
    t = s.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 8.0)], "epsilon double")
    return t.select("epsilon", F.round(secure.gaussian_sigma(5, F.col("epsilon"), 1e-5), 6).alias("sigma"))


@query("a38_dp_release")
def a38b(s, d):
    return secure.noisy_counters(literal(s, "parts", d), [1.0, 8.0], 5, 1e-5, 11)


FLOOD = f"WITH {literal_sql('parts')}, m AS (SELECT *, greatest(1, CAST(sum(tp + fp + fn) OVER (PARTITION BY silo) AS BIGINT) // count(*) OVER (PARTITION BY silo)) sh FROM parts), fl AS (SELECT silo, l, CASE WHEN silo IN (1, 3) THEN 0 ELSE tp END tp, CASE WHEN silo IN (1, 3) THEN sh * 9 ELSE fp END fp, CASE WHEN silo IN (1, 3) THEN sh * 9 ELSE fn END fn FROM m)"


def bad_counters(s: SparkSession, d: str) -> DataFrame:
    f = secure.flooded(literal(s, "parts", d), [1, 3])
    k = F.when(F.col("silo").isin(1, 3), 9).otherwise(1)
    return f.withColumn("fp", F.col("fp") * k).withColumn("fn", F.col("fn") * k)


@query("a39_drop_f", FLOOD + ", ms AS (SELECT silo, sum(tp + fp + fn) mass FROM fl GROUP BY silo), rk AS (SELECT silo, row_number() OVER (ORDER BY abs(mass - (SELECT median(mass) FROM ms)), silo) r, count(*) OVER () k FROM ms) SELECT l, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM fl JOIN rk USING (silo) WHERE r <= k - 2 GROUP BY l")
def a39(s, d):
    return secure.drop_farthest(bad_counters(s, d), 2)


@query("a40_flooding", f"WITH {literal_sql('parts')}, m AS (SELECT *, greatest(1, CAST(sum(tp + fp + fn) OVER (PARTITION BY silo) AS BIGINT) // count(*) OVER (PARTITION BY silo)) sh FROM parts) SELECT silo, l, CAST(CASE WHEN silo IN (1, 3) THEN 0 ELSE tp END AS BIGINT) tp, CAST(CASE WHEN silo IN (1, 3) THEN sh ELSE fp END AS BIGINT) fp, CAST(CASE WHEN silo IN (1, 3) THEN sh ELSE fn END AS BIGINT) fn FROM m")
def a40(s, d):
    return secure.flooded(literal(s, "parts", d), [1, 3])


@query("a41_alarm", FLOOD + " SELECT f.silo, bool_or(f.tp + f.fn <> p.tp + p.fn OR f.tp + f.fp > 40) alarm FROM fl f JOIN parts p ON f.silo = p.silo AND f.l = p.l GROUP BY f.silo")
def a41(s, d):
    known = literal(s, "parts", d).select("silo", "l", (F.col("tp") + F.col("fn")).alias("p"), F.lit(40).alias("n"))
    return secure.alarms(bad_counters(s, d), known)


@query("a42_groupwise", FLOOD + """, g AS (SELECT silo, (row_number() OVER (ORDER BY ((silo % 1000003) * 2654435761 + 12345) % 4294967296, silo) - 1) % 3 g FROM (SELECT DISTINCT silo FROM fl)),
c AS (SELECT * FROM fl JOIN g USING (silo)), ms AS (SELECT g, sum(tp + fp + fn) / count(DISTINCT silo) mass FROM c GROUP BY g), rk AS (SELECT g, row_number() OVER (ORDER BY abs(mass - (SELECT median(mass) FROM ms)), g) r FROM ms)
SELECT l, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM c JOIN rk USING (g) WHERE r <= 2 GROUP BY l""")
def a42(s, d):
    return secure.groupwise(bad_counters(s, d), 3, 1)
