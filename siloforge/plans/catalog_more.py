"""Registered queries: the smaller operators of the inventory."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions import columns as C
from siloforge.operators import knn, metrics, pareto, partition, relevance, scheduling, secure, stats
from siloforge.plans import fixtures as fx
from siloforge.plans import runner, search
from siloforge.plans.catalog import A2, HAM, HASH, RANKED, SEL16, a2, a2_counters, bad_counters, folded, n_val, query, r6, scored
from siloforge.plans.config import Settings
from siloforge.plans.literals import literal, literal_sql
from siloforge.session import fresh_path
from siloforge.sources import arrays, synthetic


@query("s03_prefold_scan", f"WITH {fx.FIXTURE_SQL['b']} SELECT CAST(row_id % 5 AS INT) fold, split, count(*) n, count(DISTINCT silo) silos FROM b GROUP BY ALL")
def s03(s, d):
    path = fresh_path(s, "folds")
    fx.orders_by_nation(s, d).withColumn("fold", (F.col("row_id") % 5).cast("int")).write.partitionBy("fold").parquet(path)
    return s.read.parquet(path).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("silo").alias("silos"))


@query("s07_shards", f"WITH {fx.FIXTURE_SQL['a2']} SELECT silo, split, count(*) n FROM a2 GROUP BY silo, split")
def s07(s, d):
    path = fresh_path(s, "shards")
    arrays.write_shards(fx.vectors_multi(s, d), path)
    return arrays.read_shards(s, path).groupBy("silo", "split").agg(F.count(F.lit(1)).alias("n"))


@query("s09_counters_round_trip", f"WITH {literal_sql('parts')} SELECT silo, l, tp, fp, fn FROM parts")
def s09(s, d):
    path = fresh_path(s, "counters")
    arrays.write_counters(literal(s, "parts", d), path)
    return arrays.read_counters(s, path)


@query("s12_pack_bits", f"WITH {literal_sql('packed')} SELECT i, array_to_string(bytes, ',') bytes FROM packed WHERE i < 2")
def s12(s, d):
    masks = s.createDataFrame([(0, [0, 2, 15], 16), (1, [0, 1, 2, 3, 4, 5, 6, 7, 8], 9)], "i int, sel array<int>, n int")
    return arrays.packed(masks, 16).select("i", F.array_join("bytes", ",").alias("bytes"))


@query("p02_empty_mask", "SELECT 1.0::DOUBLE o_macro, 1.0::DOUBLE o_micro, 0.0::DOUBLE o_ratio")
def p02(s, d):
    t = metrics.objectives(knn.nothing_predicted(a2(s, d)), 0, 59, n_val(s, d))
    return t.select("o_macro", "o_micro", "o_ratio")


@query("p05_silo_filter", f"WITH {fx.FIXTURE_SQL['b']} SELECT row_id, silo FROM b WHERE silo IN (3, 7, 24)")
def p05(s, d):
    return fx.orders_by_nation(s, d).filter(F.col("silo").isin(3, 7, 24)).select("row_id", "silo")


@query("p07_binarised_labels", f"WITH {fx.rows_sql('a2')} SELECT row_id, CAST(l AS INT) l FROM yl WHERE v > 0")
def p07(s, d):
    return fx.long_y(fx.vectors_multi(s, d)).filter("v > 0").select("row_id", "l")


@query("p08_threshold", A2 + "SELECT row_id, CAST(l AS INT) l FROM post WHERE round(p, 9) >= 0.4")
def p08(s, d):
    return knn.posteriors(a2(s, d)).filter(F.round("p", 9) >= 0.4).select("row_id", "l")


@query("j14_exactness", "SELECT CAST(0 AS BIGINT) max_difference")
def j14(s, d):
    a = a2_counters(s, d)
    b = knn.batch_counters(fx.vectors_multi(s, d), [SEL16]).select("silo", "l", *(F.col(c).alias(f"b_{c}") for c in ("tp", "fp", "fn")))
    gap = F.greatest(*(F.abs(F.coalesce(c, F.lit(-1)) - F.coalesce(f"b_{c}", F.lit(-1))) for c in ("tp", "fp", "fn")))
    return a.join(b, ["silo", "l"], "full").agg(F.max(gap).cast("long").alias("max_difference"))


@query("a10_central_objectives", A2.replace("CAST(vec_id % 8 AS INT) silo", "0 silo") + """, k AS (SELECT row_id, l, v, round(p, 9) p, pred FROM sco), rl AS (SELECT coalesce(sum(x), 0) / (SELECT count(DISTINCT row_id) FROM k) v FROM (SELECT avg(CAST(b.p >= a.p AS DOUBLE)) x FROM k a JOIN k b ON a.row_id = b.row_id AND a.v = 1 AND b.v = 0 GROUP BY a.row_id))
SELECT round(1 - (SELECT avg(f1) FROM lf), 6) o_macro, round((SELECT avg(CAST(pred <> v AS DOUBLE)) FROM k), 6) o_hamming, round((SELECT v FROM rl), 6) o_ranking""")
def a10(s, d):
    rows = a2(s, d).withColumn("silo", F.lit(0))
    t = scored(rows).withColumn("p", F.round("p", 9)).persist()
    c = t.groupBy("silo", "l").agg(F.sum(F.col("pred") * F.col("v")).alias("tp"), F.sum(F.col("pred") * (1 - F.col("v"))).alias("fp"), F.sum((1 - F.col("pred")) * F.col("v")).alias("fn"))
    one = F.lit(True)
    j = metrics.macro_f1(c).join(metrics.hamming_loss(t), one).join(metrics.ranking_loss(t), one)
    return j.select(F.round(1 - F.col("macro_f1"), 6).alias("o_macro"), F.round("hamming_loss", 6).alias("o_hamming"), F.round("ranking_loss", 6).alias("o_ranking"))


@query("a22_inner_cv", A2.replace("r AS (SELECT * FROM a2)", f"""h AS (SELECT *, row_number() OVER (ORDER BY {HASH}, row_id) - 1 i, count(*) OVER () n FROM a2),
u AS (SELECT *, unnest(range(0, 3)) turn FROM h), r AS (SELECT row_id, CAST(turn AS INT) silo, CASE WHEN ((i + 1) * 3 - 1) // n = turn THEN 'val' ELSE 'train' END split, x, y FROM u)""").replace("ON c.row_id = yl.row_id AND c.l = yl.l", "ON c.row_id = yl.row_id AND c.l = yl.l AND c.silo = yl.silo") + "SELECT round(avg(f1), 6) pooled, round((SELECT avg(macro_f1) FROM cli), 6) mean FROM lf")
def a22(s, d):
    rows = folded(a2(s, d).withColumn("silo", F.lit(0)))
    c = knn.counters(rows, knn.predictions(rows))
    return metrics.macro_f1(c).join(metrics.client_f1(c).agg(F.avg("macro_f1").alias("mean")), F.lit(True)).select(r6("macro_f1", "pooled"), r6("mean"))


@query("a30_run_statistics", f"WITH {literal_sql('runs')} SELECT dataset, method, min(value) least, round(median(value), 6) median, max(value) largest, round(stddev_pop(value), 6) std FROM runs GROUP BY dataset, method")
def a30(s, d):
    return stats.summary(literal(s, "runs", d)).select("dataset", "method", "least", r6("median"), "largest", r6("std"))


@query("a29_dominance_counts", f"WITH {literal_sql('solutions')} SELECT b.i, count(a.i) dominated_by FROM solutions b LEFT JOIN solutions a ON a.o0 <= b.o0 AND a.o1 <= b.o1 AND (a.o0 < b.o0 OR a.o1 < b.o1) GROUP BY b.i")
def a29(s, d):
    return pareto.dominance_counts(literal(s, "solutions", d), ["o0", "o1"])


@query("a33_counter_step", f"WITH {literal_sql('parts')} SELECT l, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn FROM parts GROUP BY l")
def a33(s, d):
    js = literal(s, "parts", d).groupBy("silo").agg(F.to_json(F.struct(*(F.array_sort(F.collect_list(F.struct("l", F.col(c).alias("v")))).alias(c) for c in ("tp", "fp", "fn")))).alias("js"))
    kind = "tp array<struct<l:int,v:long>>, fp array<struct<l:int,v:long>>, fn array<struct<l:int,v:long>>"
    z = js.select(F.from_json("js", kind).alias("c")).select(F.explode(F.arrays_zip("c.tp", "c.fp", "c.fn")).alias("z"))
    return z.groupBy(F.col("z.tp.l").alias("l")).agg(*(F.sum(f"z.{c}.v").alias(c) for c in ("tp", "fp", "fn")))


@query("a35_critical_path", f"WITH {literal_sql('silos')} SELECT round, max(latency) slowest FROM silos GROUP BY round")
def a35(s, d):
    return literal(s, "silos", d).groupBy("round").agg(F.max("latency").alias("slowest"))


@query("a39_robust_macro")
def a39(s, d):
    return metrics.macro_f1(secure.drop_farthest(bad_counters(s, d), 2).withColumn("silo", F.lit(0)))


@query("w18_greedy_order")
def w18(s, d):
    return s.createDataFrame([(p, j) for p, j in enumerate(relevance.greedy_selection([0.9, 0.8, 0.7, 0.1], [[0, 0.9, 0, 0], [0.9, 0, 0.2, 0], [0, 0.2, 0, 0], [0, 0, 0, 0]], 3))], "place int, j int")


@query("t06_best_test_mask", f"WITH {literal_sql('solutions')} SELECT arg_min(selected, o0) selected, min(o0) o0 FROM solutions")
def t06(s, d):
    # arg_min keeps the first of equals in the table's order, which is that of i; min_by would keep the last
    first = F.when(F.col("o0").isNotNull() & F.col("selected").isNotNull(), F.struct("o0", "i"))
    return literal(s, "solutions", d).agg(F.min_by("selected", first).alias("selected"), F.min("o0").alias("o0"))


@query("t10_filter_seeds", RANKED + ", n AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]::DOUBLE[]) ratio), k AS (SELECT j, row_number() OVER (ORDER BY round(rel, 9) DESC, j) k FROM fr) SELECT ratio, array_to_string(list_sort(list(j)), ',') sel FROM n JOIN k ON k <= greatest(1, round_even(ratio * 7, 0)) GROUP BY ratio")
def t10(s, d):
    b = fx.orders_by_nation(s, d)
    n = b.filter("split = 'train'").groupBy("silo").agg(F.count(F.lit(1)).alias("n"))
    ranked = relevance.federated_rank(relevance.anova(b), n).withColumn("k", F.row_number().over(W.orderBy(F.round("rel", 9).desc(), "j")))
    ratios = F.broadcast(s.createDataFrame([(r, max(1, round(r * 7))) for r in (0.05, 0.1, 0.2, 0.3)], "ratio double, m int"))
    return ranked.join(ratios, F.col("k") <= F.col("m")).groupBy("ratio").agg(C.mask_string(F.array_sort(F.collect_list("j"))).alias("sel"))


@query("u05_population_union", f"WITH {literal_sql('solutions')} SELECT count(*) n FROM (SELECT * FROM solutions UNION ALL SELECT * FROM solutions WHERE selected > 4)")
def u05(s, d):
    p = literal(s, "solutions", d)
    return p.unionAll(p.filter("selected > 4")).agg(F.count(F.lit(1)).alias("n"))


@query("f01_cosine", f"WITH {fx.FIXTURE_SQL['a2']}, c AS (SELECT silo, list_transform(range(1, 60), lambda j: avg_x[j]) m FROM (SELECT silo, [{', '.join(f'avg(x[{j}])' for j in range(1, 60))}] avg_x FROM a2 GROUP BY silo)) SELECT row_id, round(list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m))), 6) sim FROM a2 JOIN c USING (silo)")
def f01(s, d):
    rows = fx.vectors_multi(s, d)
    centre = rows.groupBy("silo").agg(F.array(*(F.avg(F.col("x")[j]) for j in range(59))).alias("m"))
    return rows.join(centre, "silo").select("row_id", F.round(C.cosine(F.col("x"), F.col("m")), 6).alias("sim"))


@query("f05_guards", "SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0::DOUBLE, 2.0::DOUBLE), (2, 0.0::DOUBLE, 0.5::DOUBLE)) t(i, clipped, guarded)")
def f05(s, d):
    t = s.createDataFrame([(0, float("nan"), 1.0, 0.0), (1, 5.0, 4.0, 2.0), (2, -3.0, 1.0, 2.0)], "i int, x double, a double, b double")
    return t.select("i", C.clip(C.finite(F.col("x")), 0.0, 1.0).alias("clipped"), C.divide(F.col("a"), F.col("b")).alias("guarded"))


@query("f08_mask_sizes", f"WITH {literal_sql('packed')} SELECT i, CAST(bit_count(CAST(bytes[1] AS INT)) + bit_count(CAST(bytes[2] AS INT)) AS INT) selected FROM packed")
def f08(s, d):
    return literal(s, "packed", d).select("i", F.aggregate("bytes", F.lit(0), lambda n, b: n + F.bit_count(b)).alias("selected"))


@query("f09_mask_strings", f"WITH {literal_sql('masks')} SELECT mask_id, CASE WHEN sel = '' THEN 0 ELSE len(string_split(sel, ',')) END n, sel FROM masks")
def f09(s, d):
    sel = C.mask_list(F.col("sel"))
    return literal(s, "masks", d).select("mask_id", F.size(sel).cast("long").alias("n"), C.mask_string(sel).alias("sel"))


@query("f16_method_digits", "SELECT * FROM (VALUES ('warm30', 30), ('aware25', 25), ('base', NULL)) t(name, share)")
def f16(s, d):
    t = s.createDataFrame([("warm30",), ("aware25",), ("base",)], "name string")
    return t.select("name", F.expr("try_cast(regexp_extract(name, '[0-9]+', 0) as int)").alias("share"))


@query("f17_report_rows", f"WITH {literal_sql('runs')} SELECT dataset, method || ' & ' || printf('%.3f', avg(value)) AS row FROM runs GROUP BY dataset, method")
def f17(s, d):
    return literal(s, "runs", d).groupBy("dataset", "method").agg(F.avg("value").alias("m")).select("dataset", F.format_string("%s & %.3f", "method", "m").alias("row"))


@query("g14_partition_summary", f"WITH {fx.FIXTURE_SQL['b']}, k AS (SELECT ntile(5) OVER (ORDER BY {HASH}, row_id) - 1 client FROM b) SELECT CAST(client AS INT) client, count(*) n FROM k GROUP BY client")
def g14(s, d):
    return partition.iid(fx.orders_by_nation(s, d), 5).groupBy("client").agg(F.count(F.lit(1)).alias("n"))


@query("g34_payload", "SELECT CAST(50 * 3 * 20 * 8 AS BIGINT) payload, CAST(11 * 32 AS BIGINT) setup")
def g34(s, d):
    p = secure.payload(50, 20, 12)
    return s.createDataFrame([(p["payload"], p["setup"])], "payload long, setup long")


@query("g36_variant_comparison", f"WITH {literal_sql('runs')}, a AS (SELECT dataset, method, avg(value) m, stddev_pop(value) sd FROM runs GROUP BY dataset, method) SELECT dataset, method, round(m, 6) mean, round(sd, 6) std, round(m - max(m) FILTER (WHERE method = 'base') OVER (PARTITION BY dataset), 6) gain FROM a")
def g36(s, d):
    t = stats.summary(literal(s, "runs", d))
    base = F.max(F.when(F.col("method") == "base", F.col("mean"))).over(W.partitionBy("dataset"))
    return t.withColumn("gain", F.col("mean") - base).select("dataset", "method", r6("mean"), r6("std"), r6("gain"))


@query("g37_central_hamming", A2 + f"SELECT round({HAM}, 6) hamming")
def g37(s, d):
    return metrics.hamming_loss(scored(a2(s, d))).select(r6("hamming_loss", "hamming"))


@query("g39_experiment")
def g39(s, d):
    rows = fx.vectors_multi(s, d)
    test = F.col("row_id") % 5 == 4
    out = runner.run(lambda: (rows.filter(~test), rows.filter(test), 59), Settings({"method": "aware", "seed": 3}), fresh_path(s, "experiment"))
    return s.createDataFrame([(out["method"], out["front"], out["evaluated"], float(out["best_objective"]), max(out["test_macro"].values()))], "method string, front int, evaluated int, best double, best_test double")


@query("a27_neighbour_mi")
def a27_neighbours(s, d):
    return relevance.neighbour_information(fx.orders_by_nation(s, d)).select("silo", "l", "j", r6("mi"))


@query("g35_head_to_head")
def g35(s, d):
    rows = fx.vectors_multi(s, d)
    test = F.col("row_id") % 5 == 4
    return runner.compared(rows.filter(~test), rows.filter(test), 59, ["base", "stable", "aware"], [1, 2], Settings({"search": {"population": 12, "generations": 4}}))


@query("g32_scaling")
def g32(s, d):
    return runner.scaling(fx.vectors_multi(s, d).drop("silo"), [2, 4, 8], [SEL16]).drop("seconds")


@query("s20_jobs", f"WITH {fx.FIXTURE_SQL['b']} SELECT silo client_id, 'silo=' || silo shard, 'counters_' || silo || '.json' AS out FROM b GROUP BY silo HAVING count(*) FILTER (WHERE split = 'train') > 0")
def s20(s, d):
    return runner.jobs(partition.manifest(fx.orders_by_nation(s, d)), fresh_path(s, "jobs"))


@query("s16_synthetic_prefold")
def s16(s, d):
    path = fresh_path(s, "prefold")
    synthetic.write_prefold(synthetic.scaled_out(s, rows=3000, features=12, labels=3, silos=4, seed=5), path, 3)
    return synthetic.read_prefold(s, path).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("s04_npz_split", f"WITH {fx.FIXTURE_SQL['b']}, k AS (SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY {HASH}, row_id) r, count(*) OVER (PARTITION BY split) n FROM b) SELECT row_id, CASE WHEN split = 'val' THEN 'test' WHEN r <= floor(n * 0.25) THEN 'val' ELSE 'train' END split FROM k")
def s04(s, d):
    b = fx.orders_by_nation(s, d)
    return partition.train_val_test(b.filter("split = 'train'").drop("split"), b.filter("split = 'val'").drop("split")).select("row_id", "split")


@query("g19_stratified_folds", f"""WITH {fx.FIXTURE_SQL['a2']}, c AS (SELECT l, sum(v) n FROM (SELECT unnest(range(0, len(y))) l, unnest(y) v FROM a2) GROUP BY l),
o AS (SELECT row_id, min(n * 1000 + c.l) k FROM (SELECT row_id, unnest(range(0, len(y))) l, unnest(y) v FROM a2) t JOIN c ON c.l = t.l WHERE v > 0 GROUP BY row_id),
g AS (SELECT row_id, coalesce(CAST(k % 1000 AS INT), -1) stratum FROM a2 LEFT JOIN o USING (row_id)) SELECT row_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY {HASH}, row_id) - 1) % 5 AS INT) fold FROM g""")
def g19(s, d):
    return partition.stratified_folds(fx.vectors_multi(s, d), 5).select("row_id", "stratum", "fold")


@query("g41_batch_summary", A2 + "SELECT m.mask_id, silo, CAST(sum(tp + fn) AS BIGINT) positives FROM ctr, (SELECT unnest([0, 1, 2]) mask_id) m GROUP BY ALL")
def g41(s, d):
    c = knn.batch_counters(fx.vectors_multi(s, d), [SEL16, [1, 2], []])
    return c.groupBy("mask_id", "silo").agg(F.sum(F.col("tp") + F.col("fn")).alias("positives"))


@query("r04_sliding_volume", f"WITH {literal_sql('history')} SELECT gen, round(avg(hv) OVER (ORDER BY gen ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) mean_hv FROM history")
def r04(s, d):
    return literal(s, "history", d).select("gen", F.round(F.avg("hv").over(W.orderBy("gen").rowsBetween(-4, 0)), 6).alias("mean_hv"))


@query("r05_history_append", f"WITH {literal_sql('history')} SELECT gen, hv FROM history WHERE gen < 6")
def r05(s, d):
    path = fresh_path(s, "history")
    for a in (0, 3):
        arrays.append_history(s, path, [{"gen": g, "hv": hv, "n_nd": 1, "evals": 8, "stagnant": 0} for g, hv in literal(s, "history", d).filter(f"gen >= {a} AND gen < {a + 3}").collect()])
    return s.read.schema("gen int, hv double, n_nd int, evals int, stagnant int").json(path).select("gen", "hv")


@query("g24_deadline_replay", f"WITH {literal_sql('silos')}, q AS (SELECT round, quantile_cont(latency, 0.6) m FROM silos GROUP BY round) SELECT round, max(latency) critical_path, count(*) n FROM silos JOIN q USING (round) WHERE latency <= m GROUP BY round")
def g24(s, d):
    return scheduling.deadline(literal(s, "silos", d), 0.6).groupBy("round").agg(F.max("latency").alias("critical_path"), F.count(F.lit(1)).alias("n"))


@query("a38_release_error")
def a38_error(s, d):
    return secure.release_error(literal(s, "parts", d), [0.5, 8.0, 1000.0], 20, 1e-5, 3)


@query("g29_classifiers", A2 + "SELECT 'knn' classifier, round(avg(f1), 6) macro FROM lf")
def g29(s, d):
    return metrics.macro_f1(a2_counters(s, d)).select(F.lit("knn").alias("classifier"), F.round("macro_f1", 6).alias("macro"))


@query("g29_classifier_matched")
def g29_matched(s, d):
    rows = fx.vectors_multi(s, d)
    by = {"knn": knn.batch_counters(rows, [SEL16]).drop("mask_id", "n_val"), "logistic": search.logistic_counters(rows, SEL16)}
    out = [metrics.macro_f1(c).select(F.lit(n).alias("classifier"), "macro_f1") for n, c in by.items()]
    return out[0].unionByName(out[1])


@query("g40_silo_times")
def g40(s, d):
    t = knn.silo_times(fx.vectors_multi(s, d), [SEL16])
    silos = t.select(F.lit(0).alias("round"), "silo", "size", F.col("seconds").alias("latency"))
    return scheduling.quorum(silos, 0.5).select("silo", "size")


@query("g28_participation_sweep")
def g28(s, d):
    rows = fx.vectors_multi(s, d)
    points = runner.sweep([{"share": x} for x in (0.25, 1.0)], lambda p: {"objective": search.Evaluator(rows, 59, participation=p["share"], seed=1)([tuple(SEL16)])[0][0]})
    return s.createDataFrame([(p["share"], float(p["objective"])) for p in points], "share double, objective double")


@query("g43_interaction")
def g43(s, d):
    data = synthetic.generate(1200, 24, 4, 3, informative=6, interaction=0.5, seed=2)
    rows = synthetic.as_rows(s, data).withColumn("test", F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0)
    return runner.interaction_check(rows.filter("NOT test").drop("test"), rows.filter("test").drop("test"), 24, list(map(int, data["informative"])), Settings({"search": {"population": 12, "generations": 4}}))


@query("g28_ablation")
def g28_arms(s, d):
    """The arms of the search, and silos by label skew of two strengths."""
    out = None
    for alpha in (0.1, 10.0):
        data = synthetic.generate(900, 20, 4, 4, informative=5, alpha=alpha, seed=4)
        rows = synthetic.as_rows(s, data).withColumn("test", F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0)
        t = runner.compared(rows.filter("NOT test").drop("test"), rows.filter("test").drop("test"), 20, ["base", "stable", "portfolio"], [1], Settings({"search": {"population": 8, "generations": 3}}))
        t = t.withColumn("alpha", F.lit(alpha))
        out = t if out is None else out.unionByName(t)
    return out
