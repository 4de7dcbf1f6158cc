"""Registered queries: rankings, sets, partitioners, replay, statistics, streams and search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions import columns as C
from siloforge.operators import knn, metrics, pareto, partition, relevance, scheduling, stats
from siloforge.plans import fixtures as fx
from siloforge.plans import search
from siloforge.plans.catalog import A2, ANOVA, BUDGET, CAPPED, F1SQL, HASH, QUORUM, RANKED, SEL16, SKETCH, SUBSET, a2, a2_counters, query, r6, round_counters, scored
from siloforge.plans.literals import literal, literal_sql
from siloforge.sources import synthetic
from siloforge.streaming import rounds

# --- windows and rankings


@query("w01_label_ranks", SKETCH + " SELECT CAST(l AS INT) l, CAST(j AS INT) j, CAST(row_number() OVER (PARTITION BY l ORDER BY round(r, 9) DESC, j) AS INT) rank FROM sk")
def w01(s, d):
    return relevance.label_ranks(relevance.sketch(fx.orders_by_nation(s, d)))


@query("w02_crowding", f"""WITH {literal_sql('solutions')}, g AS (SELECT i, {', '.join(f"max({o}) OVER () - min({o}) OVER () s{o}, lead({o}) OVER (ORDER BY {o}, i) - lag({o}) OVER (ORDER BY {o}, i) g{o}" for o in ('o0', 'o1', 'o2'))} FROM solutions)
SELECT i, round(go0 / so0 + go1 / so1 + go2 / so2, 6) distance FROM g""")
def w02(s, d):
    return pareto.crowding(literal(s, "solutions", d), ["o0", "o1", "o2"]).select("i", r6("distance"))


@query("w03_front_rank", f"""WITH RECURSIVE {literal_sql('solutions')}, e AS (SELECT a.i a, b.i b FROM solutions a JOIN solutions b ON a.o0 <= b.o0 AND a.o1 <= b.o1 AND (a.o0 < b.o0 OR a.o1 < b.o1)),
p AS (SELECT i, 0 depth FROM solutions UNION SELECT e.b, depth + 1 FROM p JOIN e ON p.i = e.a) SELECT i, CAST(max(depth) AS INT) rank FROM p GROUP BY i""")
def w03(s, d):
    return pareto.front_ranks(literal(s, "solutions", d), ["o0", "o1"])


@query("w04_blended_order", f"""WITH {literal_sql('solutions')}, {literal_sql('risks')}, g AS (SELECT i, {', '.join(f"max({o}) OVER () - min({o}) OVER () s{o}, lead({o}) OVER (ORDER BY {o}, i) - lag({o}) OVER (ORDER BY {o}, i) g{o}" for o in ('o0', 'o1', 'o2'))} FROM solutions),
c AS (SELECT i, go0 / so0 + go1 / so1 + go2 / so2 distance, risk FROM g JOIN risks USING (i)), m AS (SELECT max(distance) - min(distance) span, avg(risk) mean, stddev_pop(risk) sd FROM c),
k AS (SELECT i, distance, round(distance - 0.3::DOUBLE * span * (risk - mean) / sd, 9) key FROM c, m) SELECT i, CAST(row_number() OVER (ORDER BY distance IS NOT NULL, key DESC NULLS LAST, i) AS INT) place FROM k""")
def w04(s, d):
    sol = literal(s, "solutions", d)
    return pareto.blended_order(pareto.crowding(sol, ["o0", "o1", "o2"]), literal(s, "risks", d), 0.3)


@query("w05_quorum", f"WITH {literal_sql('silos')}, {QUORUM} SELECT round, silo, size FROM qu")
def w05(s, d):
    return scheduling.quorum(literal(s, "silos", d), 0.5).select("round", "silo", "size")


@query("w06_deadline", f"WITH {literal_sql('silos')}, q AS (SELECT round, quantile_cont(latency, 0.6) m FROM silos GROUP BY round) SELECT round, silo FROM silos JOIN q USING (round) WHERE latency <= m")
def w06(s, d):
    return scheduling.deadline(literal(s, "silos", d), 0.6).select("round", "silo")


@query("w07_early_stop", f"""WITH {literal_sql('history')}, t AS (SELECT gen, row_number() OVER (ORDER BY gen) n, avg(hv) OVER (ORDER BY gen ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) a, avg(hv) OVER (ORDER BY gen ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) b FROM history),
f AS (SELECT gen, CAST(n >= 6 AND (a - b) / greatest(abs(b), 1e-12) < 0.01 AS INT) flat FROM t), r AS (SELECT *, sum(1 - flat) OVER (ORDER BY gen) run FROM f),
c AS (SELECT gen, sum(flat) OVER (PARTITION BY run ORDER BY gen) stagnant FROM r) SELECT gen, CAST(stagnant AS BIGINT) stagnant, stagnant >= 3 stop FROM c""")
def w07(s, d):
    return pareto.early_stop(literal(s, "history", d), 3, 0.01, 3)


@query("w08_hv2d", f"""WITH {literal_sql('solutions')}, p AS (SELECT *, coalesce(min(o1) OVER (ORDER BY o0, o1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) b FROM solutions WHERE o0 < 1 AND o1 < 1) SELECT round(sum((1 - o0) * greatest(b - o1, 0)), 6) hv FROM p""")
def w08(s, d):
    return pareto.hypervolume2(literal(s, "solutions", d), "o0", "o1", (1.0, 1.0)).select(r6("hv"))


@query("w09_hv3d", f"""WITH {literal_sql('solutions')}, p AS (SELECT DISTINCT o0, o1, o2 FROM solutions WHERE o0 < 1 AND o1 < 1 AND o2 < 1), c AS (SELECT DISTINCT o0 x FROM p), w AS (SELECT x, lead(x, 1, 1.0) OVER (ORDER BY x) - x width FROM c),
j AS (SELECT x, width, o1, o2, coalesce(min(o2) OVER (PARTITION BY x ORDER BY o1, o2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) b FROM w JOIN p ON o0 <= x) SELECT round(sum(width * (1 - o1) * greatest(b - o2, 0)), 6) hv FROM j""")
def w09(s, d):
    return pareto.hypervolume3(literal(s, "solutions", d), "o0", "o1", "o2", (1.0, 1.0, 1.0)).select(r6("hv"))


TOPK = ANOVA + ", k AS (SELECT silo, j, row_number() OVER (PARTITION BY silo ORDER BY round(rel, 9) DESC, j) r FROM f)"


@query("w10_topk_votes", TOPK + " SELECT CAST(j AS INT) j, count(*) votes FROM k WHERE r <= 3 GROUP BY j")
def w10(s, d):
    return relevance.top_votes(relevance.anova(fx.orders_by_nation(s, d)), 3)


@query("w11_local_top_union", TOPK + " SELECT DISTINCT CAST(j AS INT) j FROM k WHERE r <= 2")
def w11(s, d):
    return relevance.local_top(relevance.anova(fx.orders_by_nation(s, d)), 2).select("j").distinct()


@query("w12_wilcoxon_w", f"""WITH {literal_sql('runs')}, p AS (SELECT a.dataset, a.value - b.value d FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed WHERE a.method = 'aware' AND b.method = 'base'),
k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY dataset, round(abs(d), 12)) - 1) / 2 r FROM p WHERE round(d, 12) <> 0)
SELECT dataset, count(*) n, CAST(coalesce(sum(r) FILTER (WHERE d > 0), 0) AS DOUBLE) w_plus, CAST(coalesce(sum(r) FILTER (WHERE d < 0), 0) AS DOUBLE) w_minus FROM k GROUP BY dataset""")
def w12(s, d):
    return stats.wilcoxon(stats.paired(literal(s, "runs", d), "aware", "base"))


@query("w12_wilcoxon_p")
def w12b(s, d):
    return stats.wilcoxon_p(stats.paired(literal(s, "runs", d), "aware", "base"))


@query("w13_holm", f"WITH {literal_sql('tests')}, s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p step FROM tests) SELECT family, test, p, round(least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, test)), 6) adjusted FROM s")
def w13(s, d):
    return stats.holm(literal(s, "tests", d)).select("family", "test", "p", r6("adjusted"))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query("w14_calibration", A2 + f""", g AS (SELECT l, v, round(p, 9) p, unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) t FROM sco), c AS (SELECT l, t, count(*) FILTER (WHERE p >= t AND v = 1) tp, count(*) FILTER (WHERE p >= t AND v = 0) fp, count(*) FILTER (WHERE p < t AND v = 1) fn FROM g GROUP BY l, t),
f AS (SELECT l, t, tp + fn pos, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END f1 FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(f1, 9) DESC, t) r FROM f)
SELECT CAST(l AS INT) l, CASE WHEN pos = 0 THEN 0.5 ELSE t END threshold, round(f1, 6) f1 FROM k WHERE r = 1""")
def w14(s, d):
    return metrics.calibrated(scored(a2(s, d)).withColumn("p", F.round("p", 9)), GRID).select("l", "threshold", r6("f1"))


@query("w15_tiers", f"WITH {literal_sql('silos')}, s AS (SELECT DISTINCT silo FROM silos) SELECT silo, ['cloud', 'server', 'edge'][CAST((row_number() OVER (ORDER BY silo) - 1) % 3 + 1 AS INT)] tier FROM s")
def w15(s, d):
    return scheduling.tiers(literal(s, "silos", d).select("silo").distinct(), ["cloud", "server", "edge"])


@query("w16_fixed_quorum", f"""WITH {literal_sql('replies')}, k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY took, silo) r FROM replies WHERE took IS NOT NULL), t AS (SELECT round, count(*) n, max(took) FILTER (WHERE r = 2) q, max(took) f FROM k GROUP BY round)
SELECT round(avg(q), 6) mean_quorum, round(stddev_samp(q), 6) sd_quorum, round(avg(f), 6) mean_full, round(avg(f / q), 6) speedup FROM t WHERE n = 3""")
def w16(s, d):
    t = scheduling.measured_rounds(literal(s, "replies", d), 3, 2)
    return t.select(*(r6(c) for c in t.columns))


@query("w17_iid_ntile", f"WITH {fx.FIXTURE_SQL['b']} SELECT row_id, CAST(ntile(7) OVER (ORDER BY {HASH}, row_id) - 1 AS INT) client FROM b")
def w17(s, d):
    return partition.iid(fx.orders_by_nation(s, d), 7).select("row_id", "client")


# --- limits and top-k


@query("t01_ranking_mask", RANKED + " SELECT CAST(j AS INT) j FROM fr ORDER BY round(rel, 9) DESC, j LIMIT 4")
def t01(s, d):
    b = fx.orders_by_nation(s, d)
    local = relevance.anova(b)
    n = b.filter("split = 'train'").groupBy("silo").agg(F.count(F.lit(1)).alias("n"))
    return relevance.ranking_mask(relevance.federated_rank(local, n), 0.5, 7)


@query("t02_all_features", "SELECT CAST(unnest(range(0, 59)) AS INT) j")
def t02(s, d):
    return s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(58))).alias("j"))


@query("t03_random_mask", "SELECT CAST(j AS INT) j FROM (SELECT unnest(range(0, 59)) j) ORDER BY ((j % 1000003) * 2654435761 + 3 * 40503 + 12345) % 4294967296, j LIMIT 12")
def t03(s, d):
    return relevance.random_mask(s.range(59).select(F.col("id").cast("int").alias("j")).withColumn("j", F.col("j").cast("long")), 12, 3).select(F.col("j").cast("int").alias("j"))


@query("t04_val_best", CAPPED + " SELECT i, o0, selected FROM k ORDER BY o0, i LIMIT 1")
def t04(s, d):
    f = pareto.capped_front(pareto.front(literal(s, "solutions", d), ["o0", "o1"]), 6)
    return f.orderBy("o0", "i").limit(1).select("i", "o0", "selected")


@query("t05_budget_best", BUDGET + " SELECT budget, i, o0, selected FROM j WHERE r = 1")
def t05(s, d):
    return pareto.best_per_budget(literal(s, "solutions", d), literal(s, "budgets", d))


@query("t07_sorted_silos", f"WITH {literal_sql('parts')} SELECT array_to_string(list_sort(list(DISTINCT silo)), ',') silos FROM parts")
def t07(s, d):
    return literal(s, "parts", d).agg(F.array_join(F.array_sort(F.collect_set("silo")), ",").alias("silos"))


@query("t08_greedy_mask")
def t08(s, d):
    return s.createDataFrame([(p, j) for p, j in enumerate(relevance.greedy_mask(fx.orders_by_nation(s, d), 7, 0.5))], "place int, j int")


@query("t09_baseline_suite", RANKED + """, rs AS (SELECT unnest([0.15, 0.3, 0.6]::DOUBLE[]) ratio), kr AS (SELECT j, row_number() OVER (ORDER BY round(rel, 9) DESC, j) k FROM fr),
lo AS (SELECT silo, j, row_number() OVER (PARTITION BY silo ORDER BY round(rel, 9) DESC, j) r FROM f), n AS (SELECT ratio, greatest(1, round_even(ratio * 7, 0)) m FROM rs),
vt AS (SELECT ratio, j, count(*) v, max(m) m FROM lo, n WHERE r <= m GROUP BY ratio, j), kv AS (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY v DESC, j) k FROM vt)
SELECT 'rank' method, ratio, CAST(j AS INT) j FROM kr, n WHERE k <= m UNION ALL SELECT 'union', ratio, CAST(j AS INT) FROM vt UNION ALL SELECT 'frequency', ratio, CAST(j AS INT) FROM kv WHERE k <= m""")
def t09(s, d):
    b = fx.orders_by_nation(s, d)
    local = relevance.anova(b)
    n = b.filter("split = 'train'").groupBy("silo").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(s.createDataFrame([(r, max(1, round(r * 7))) for r in (0.15, 0.3, 0.6)], "ratio double, m int"))
    ranked = relevance.federated_rank(local, n).withColumn("k", F.row_number().over(W.orderBy(F.round("rel", 9).desc(), "j")))
    votes = local.withColumn("r", F.row_number().over(W.partitionBy("silo").orderBy(F.round("rel", 9).desc(), "j"))).join(sizes, F.col("r") <= F.col("m"))
    votes = votes.groupBy("ratio", "j", "m").agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.row_number().over(W.partitionBy("ratio").orderBy(F.col("v").desc(), "j")))
    out = ranked.join(sizes, F.col("k") <= F.col("m")).select(F.lit("rank").alias("method"), "ratio", "j")
    out = out.unionByName(votes.select(F.lit("union").alias("method"), "ratio", "j"))
    return out.unionByName(votes.filter("k <= m").select(F.lit("frequency").alias("method"), "ratio", "j"))


# --- sets


@query("u01_row_union", f"WITH {fx.FIXTURE_SQL['c']} SELECT silo, count(*) n FROM c GROUP BY silo")
def u01(s, d):
    c = fx.documents_by_source(s, d)
    return c.filter("split = 'train'").unionByName(c.filter("split = 'val'")).groupBy("silo").agg(F.count(F.lit(1)).alias("n"))


@query("u02_noise_features", "SELECT CAST(unnest(range(0, 59)) AS INT) j EXCEPT SELECT CAST(unnest([1, 5, 9, 58]) AS INT)")
def u02(s, d):
    every = s.range(59).select(F.col("id").cast("int").alias("j"))
    return every.exceptAll(s.createDataFrame([(j,) for j in (1, 5, 9, 58)], "j int"))


@query("u03_common_seeds", f"WITH {literal_sql('runs')} SELECT dataset, seed FROM runs WHERE method = 'aware' INTERSECT SELECT dataset, seed FROM runs WHERE method = 'base' INTERSECT SELECT dataset, seed FROM runs WHERE method = 'union'")
def u03(s, d):
    r = literal(s, "runs", d)
    a, b, c = (r.filter(F.col("method") == m).select("dataset", "seed") for m in ("aware", "base", "union"))
    return a.intersect(b).intersect(c)


@query("u06_dedupe", f"WITH {literal_sql('masks')}, k AS (SELECT DISTINCT array_to_string(list_sort(string_split(sel, ',')), ',') sel FROM masks WHERE sel <> '') SELECT sel FROM k WHERE sel NOT IN ('0')")
def u06(s, d):
    m = literal(s, "masks", d).filter("sel <> ''").select(F.array_join(F.array_sort(F.split("sel", ",")), ",").alias("sel")).distinct()
    return m.join(s.createDataFrame([("0",)], "sel string"), "sel", "left_anti")


@query("u07_overlap", f"WITH {fx.FIXTURE_SQL['b']}, k AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY {HASH}, row_id) r, count(*) OVER (PARTITION BY silo) n FROM b), a AS (SELECT row_id FROM b WHERE split = 'val'), e AS (SELECT row_id FROM k WHERE r <= greatest(1, floor(n * 0.25))) SELECT round((SELECT count(*) FROM a JOIN e USING (row_id)) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) share")
def u07(s, d):
    b = fx.orders_by_nation(s, d)
    a = b.filter("split = 'val'").select("row_id")
    e = partition.silo_val_split(b.drop("split"), 0.25).filter("split = 'val'").select("row_id")
    return stats.overlap(a, e).select(r6("share"))


# --- functions


@query("f03_hardness_softmax", A2 + ", h AS (SELECT l, (1 - least(greatest(f1, 0), 1)) / 0.5 h FROM lf) SELECT CAST(l AS INT) l, round(exp(h - max(h) OVER ()) / sum(exp(h)) OVER () * exp(max(h) OVER ()), 6) w FROM h")
def f03(s, d):
    t = metrics.label_f1(a2_counters(s, d)).withColumn("h", (1 - C.clip(F.col("f1"), 0.0, 1.0)) / F.lit(0.5))
    every = W.partitionBy(F.lit(0))
    t = t.withColumn("e", F.exp(F.col("h") - F.max("h").over(every)))
    return t.select("l", F.round(F.col("e") / F.sum("e").over(every), 6).alias("w"))


@query("f04_log_densities", "SELECT CAST(i AS INT) i, round(exp(ln(2.0) + i * (ln(17.7) - ln(2.0)) / 7), 6) density FROM (SELECT unnest(range(0, 8)) i)")
def f04(s, d):
    return s.range(1).select(F.posexplode(C.log_spaced(2.0, 17.7, 8)).alias("i", "density")).select("i", r6("density"))


@query("f12_pair_seed", "SELECT CAST(i AS INT) i, CAST(j AS INT) j, CAST((CAST(987654321987 AS HUGEINT) * 1000003 + least(i, j) * 1009 + greatest(i, j)) % CAST(18446744073709551616 AS HUGEINT) AS VARCHAR) seed FROM (SELECT unnest(range(0, 4)) i), (SELECT unnest(range(0, 4)) j) WHERE i <> j")
def f12(s, d):
    i, j = (s.range(4).select(F.col("id").cast("int").alias(n)) for n in "ij")
    return i.join(j, F.col("i") != F.col("j")).select("i", "j", C.pair_seed(987654321987, F.col("i"), F.col("j")).cast("string").alias("seed"))


@query("f13_latency", f"WITH {literal_sql('silos')}, t AS (SELECT *, ['cloud', 'server', 'edge'][silo % 3 + 1] tier FROM silos) SELECT round, silo, round(0.0::DOUBLE + CASE tier WHEN 'cloud' THEN 1.0 WHEN 'server' THEN 2.0 ELSE 8.0 END * 0.002 * size + 0.05, 6) took FROM t")
def f13(s, d):
    t = literal(s, "silos", d).withColumn("tier", F.element_at(F.array(F.lit("cloud"), F.lit("server"), F.lit("edge")), F.col("silo") % 3 + 1))
    sec = scheduling.latency(F.col("size"), F.col("tier"), {"cloud": 1.0, "server": 2.0, "edge": 8.0}, 0.002, 0.05)
    return t.select("round", "silo", F.round(sec, 6).alias("took"))


# --- partitioners, replay, evaluation


@query("g12_batched_masks", A2 + "SELECT 0 mask_id, silo, CAST(l AS INT) l, tp, fp, fn FROM ctr")
def g12(s, d):
    return knn.batch_counters(fx.vectors_multi(s, d), [SEL16]).select("mask_id", "silo", "l", "tp", "fp", "fn")


@query("g15_quantity_skew", f"WITH {fx.FIXTURE_SQL['a2']}, k AS (SELECT row_id, row_number() OVER (ORDER BY {HASH}, row_id) r, count(*) OVER () n FROM a2), z AS (SELECT *, greatest(1, floor(0.5 / 1.0 * n)) c0, greatest(1, floor(0.3 / 1.0 * n)) c1, greatest(1, floor(0.2 / 1.0 * n)) c2 FROM k) SELECT row_id, CAST(CASE WHEN r <= c0 + n - c0 - c1 - c2 THEN 0 WHEN r <= c0 + n - c0 - c1 - c2 + c1 THEN 1 ELSE 2 END AS INT) client FROM z")
def g15(s, d):
    return partition.quantity_skew(fx.vectors_multi(s, d), [0.5, 0.3, 0.2]).select("row_id", "client")


P = [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.25, 0.25, 0.5], [0.4, 0.3, 0.3], [0.1, 0.1, 0.8]]


@query("g16_label_skew", f"""WITH {fx.FIXTURE_SQL['a2']}, w AS (SELECT row_id, {HASH} / 4294967296.0::DOUBLE u, {', '.join(f"CASE WHEN list_sum(y) > 0 THEN {' + '.join(f'y[{i + 1}] * {r[c]}::DOUBLE' for i, r in enumerate(P))} ELSE 1.0::DOUBLE END s{c}" for c in range(3))} FROM a2)
SELECT row_id, CAST(least(2, CAST(s0 <= u * (s0 + s1 + s2) AS INT) + CAST(s0 + s1 <= u * (s0 + s1 + s2) AS INT) + CAST(s0 + s1 + s2 <= u * (s0 + s1 + s2) AS INT)) AS INT) client FROM w""")
def g16(s, d):
    return partition.label_skew(fx.vectors_multi(s, d), P).select("row_id", "client")


@query("g17_natural_silos", f"WITH {fx.FIXTURE_SQL['c']}, k AS (SELECT silo, row_number() OVER (ORDER BY min(row_id)) - 1 client FROM c GROUP BY silo) SELECT row_id, CAST(client AS INT) client FROM c JOIN k USING (silo)")
def g17(s, d):
    return partition.natural(fx.documents_by_source(s, d)).select("row_id", "client")


@query("g18_rebalanced")
def g18(s, d):
    skewed = partition.quantity_skew(fx.vectors_multi(s, d), [0.9, 0.06, 0.04]).select("row_id", "client")
    return partition.rebalanced(skewed, 3, 40)


@query("g24_replay", SUBSET + ", " + QUORUM + ", " + f"""fu AS ({F1SQL.format(join='SEMI JOIN silos USING (round, silo)')}), qs AS ({F1SQL.format(join='SEMI JOIN qu USING (round, silo)')}), st AS (SELECT round, max(latency) slow, count(*) m FROM qu GROUP BY round), n AS (SELECT round, count(*) n FROM silos GROUP BY round)
SELECT 'quorum' policy, round(avg(abs(qs.macro - fu.macro)), 6) mae, round(avg(m / n), 6) participation, round(sum(slow), 6) critical_path FROM qs JOIN fu USING (round) JOIN st USING (round) JOIN n USING (round)""")
def g24(s, d):
    silos = literal(s, "silos", d)
    t = scheduling.replay(round_counters(s, d), silos, {"quorum": scheduling.quorum(silos, 0.5)})
    return t.select("policy", r6("mae"), r6("participation"), r6("critical_path"))


@query("g25_uniform_policy", f"WITH {literal_sql('silos')}, q AS (SELECT round, silo, coalesce(sum(size) OVER (PARTITION BY round ORDER BY (((silo * 31 + round) % 1000003) * 2654435761 + 12345) % 4294967296, silo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(size) OVER (PARTITION BY round) a FROM silos) SELECT round, silo FROM q WHERE b < 0.7 * a")
def g25(s, d):
    return scheduling.quorum(literal(s, "silos", d), 0.7, "uniform").select("round", "silo")


@query("g26_centralized", A2.replace("CAST(vec_id % 8 AS INT) silo", "0 silo") + "SELECT CAST(l AS INT) l, tp, fp, fn FROM tot")
def g26(s, d):
    rows = a2(s, d).withColumn("silo", F.lit(0))
    return metrics.totals(knn.counters(rows, knn.predictions(rows)))


@query("g27_heldout", A2 + "SELECT held_out, round(avg(f1), 6) macro FROM (SELECT silo >= 6 held_out, l, CASE WHEN sum(2 * tp + fp + fn) > 0 THEN 2.0 * sum(tp) / sum(2 * tp + fp + fn) ELSE 0 END f1 FROM ctr GROUP BY silo >= 6, l) GROUP BY held_out")
def g27(s, d):
    rows = a2(s, d)
    c = a2_counters(s, d).join(partition.held_out_silos(rows), "silo")
    return metrics.macro_f1(c, ["held_out"]).select("held_out", F.round("macro_f1", 6).alias("macro"))


@query("g30_summary_table", f"WITH {literal_sql('runs')} SELECT dataset, method, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, min(value) least, round(median(value), 6) median, max(value) largest FROM runs GROUP BY ROLLUP (dataset, method)")
def g30(s, d):
    t = stats.summary(literal(s, "runs", d), rollup=True)
    return t.select("dataset", "method", "n", r6("mean"), r6("std"), "least", r6("median"), "largest")


@query("g30_report_pivot", f"WITH {literal_sql('runs')} SELECT dataset, {', '.join(f'round(avg(value) FILTER (WHERE method = {chr(39)}{m}{chr(39)}), 6) {m}' for m in ('aware', 'base'))} FROM runs GROUP BY dataset")
def g30b(s, d):
    return stats.report(literal(s, "runs", d), ["aware", "base"]).select("dataset", r6("aware"), r6("base"))


@query("s11_resume_anti_join", f"WITH {literal_sql('runs')} SELECT d dataset, CAST(s AS INT) seed FROM (SELECT unnest(['ecg', 'icu', 'sense']) d), (SELECT unnest(range(0, 9)) s) WHERE NOT EXISTS (SELECT 1 FROM runs WHERE dataset = d AND seed = s AND method = 'base')")
def s11(s, d):
    grid = s.createDataFrame([(x, i) for x in ("ecg", "icu", "sense") for i in range(9)], "dataset string, seed int")
    return stats.to_do(grid, literal(s, "runs", d).filter("method = 'base'"), ["dataset", "seed"])


@query("g01_search")
def g01(s, d):
    out = search.run(fx.vectors_multi(s, d), n_features=59, seed=5)
    return s.createDataFrame(out.front_rows(), "i int, o0 double, o1 double, selected int")


@query("g20_logreg")
def g20(s, d):
    return search.logistic_counters(fx.vectors_multi(s, d), SEL16)


@query("s15_synthetic")
def s15(s, d):
    return synthetic.scaled_out(s, rows=2000, features=20, labels=4, silos=4, seed=3).select("row_id", "silo", "split", F.size("x").alias("n_features"), F.aggregate("y", F.lit(0), lambda a, v: a + v).alias("n_labels"))


# --- streams

EV = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(user_id % 5 AS INT) silo, value, user_id, ts, event_id FROM events"


@query("r01_stream_counters", f"SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) n, round(sum(value), 4) total FROM ({EV}) GROUP BY ALL")
def r01(s, d):
    return rounds.daily_counters(s, d)


@query("r02_stream_quorum", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) k, count(*) OVER (PARTITION BY day) mass FROM ({EV})) SELECT CAST(day AS VARCHAR) AS day, CAST(count(DISTINCT silo) AS INT) silos, count(*) n, round(sum(value), 4) total FROM o WHERE k <= ceil(0.5 * mass) GROUP BY day")
def r02(s, d):
    return rounds.quorum_rounds(s, d, 0.5)


@query("r03_stream_deadline", f"SELECT CAST(day AS VARCHAR) AS start, silo, count(*) n FROM ({EV}) GROUP BY ALL")
def r03(s, d):
    return rounds.deadline_windows(s, d)
