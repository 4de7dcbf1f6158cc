"""Properties of the engine's own operators."""

from __future__ import annotations

import datetime
import itertools
import os
import random
import subprocess
import sys
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siloforge import session
from siloforge.functions import columns as C
from siloforge.operators import knn, metrics, pareto, partition, relevance, secure, stats
from siloforge.plans import catalog, catalog_more, config, fixtures, runner, search
from siloforge.plans.literals import literal
from siloforge.sources import arrays, synthetic
from siloforge.streaming import rounds

assert catalog_more  # registers its queries


def as_dict(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def test_kernel_equals_relational_path(spark, sf_dir):
    for rows in (fixtures.vectors_multi(spark, sf_dir), fixtures.vectors_single(spark, sf_dir)):
        sel = [0, 3, 7, 11, 12]
        own = knn.projected(rows, sel)
        want = as_dict(knn.counters(own, knn.predictions(own)).select("silo", "l", "tp", "fp", "fn"))
        got = as_dict(knn.batch_counters(rows, [sel, []]).filter("mask_id = 0").select("silo", "l", "tp", "fp", "fn"))
        assert got == want


def test_tiny_silos(spark):
    rows = [(0, 0, "train", [1.0, 0.0], [1, 0]), (1, 0, "val", [1.0, 0.0], [1, 1]), (2, 1, "train", [1.0, 0.0], [1, 0]), (3, 1, "train", [0.0, 0.0], [0, 0]), (4, 1, "val", [0.0, 1.0], [0, 1])]
    df = spark.createDataFrame(rows, "row_id long, silo int, split string, x array<double>, y array<int>")
    want = as_dict(knn.counters(df, knn.predictions(df)).select("silo", "l", "tp", "fp", "fn"))
    got = as_dict(knn.batch_counters(df, [[0, 1]]).select("silo", "l", "tp", "fp", "fn"))
    assert want == got and want[0, 0] == (0, 0, 1)


def test_sums_and_positives(spark, sf_dir):
    rows = fixtures.vectors_multi(spark, sf_dir)
    c = knn.batch_counters(rows, [[0, 1, 2], [5, 6]]).collect()
    by = {}
    for r in c:
        by.setdefault((r["silo"], r["l"]), set()).add(r["tp"] + r["fn"])
    assert all(len(v) == 1 for v in by.values())


def test_secure_sum_is_the_plain_sum(spark):
    v = spark.createDataFrame([(s, p, (-1) ** s * s * 10**15 + p) for s in range(7) for p in range(5)], "silo int, pos int, v long")
    got = dict(map(tuple, secure.secure_sum(v).collect()))
    assert got == {p: sum((-1) ** s * s * 10**15 + p for s in range(7)) for p in range(5)}
    assert all(r["v"] != (-1) ** r["silo"] * r["silo"] * 10**15 + r["pos"] for r in secure.masked(v, 1).collect() if r["silo"])
    one = spark.createDataFrame([(0, 0, 5)], "silo int, pos int, v long")
    assert secure.secure_sum(one).first()["total"] == 5


def test_front_is_complete_and_free_of_dominance(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (60, 2)) / 12)]
    df = spark.createDataFrame(pts, "i int, o0 double, o1 double")
    got = {r["i"] for r in pareto.front(df, ["o0", "o1"]).collect()}
    want = {p[0] for p in pts if not any(search.dominates(q[1:], p[1:]) for q in pts)}
    assert got == want
    ranks = {r["i"]: r["rank"] for r in pareto.front_ranks(df, ["o0", "o1"]).collect()}
    pop = search.ranked([search.Solution((i,), (a, b)) for i, a, b in pts])
    assert ranks == {x.mask[0]: x.rank for x in pop}


def test_hypervolume(spark):
    pts = [(0.2, 0.7, 0.5), (0.5, 0.5, 0.2), (0.7, 0.2, 0.4), (0.2, 0.7, 0.5), (1.2, 0.1, 0.1)]
    df = spark.createDataFrame(pts, "a double, b double, c double")
    assert pareto.hypervolume2(df, "a", "b", (1.0, 1.0)).first()["hv"] == pytest.approx(search.hypervolume([p[:2] for p in pts]))
    grid = np.arange(0.05, 1, 0.1)
    cells = sum(any(all(g >= x - 1e-9 for g, x in zip(cell, p, strict=True)) for p in pts) for cell in itertools.product(grid, repeat=3))
    assert pareto.hypervolume3(df, "a", "b", "c", (1.0, 1.0, 1.0)).first()["hv"] == pytest.approx(cells / 1000)


def test_partitioners_cover_every_row_once(spark, sf_dir):
    rows = fixtures.vectors_multi(spark, sf_dir)
    n = rows.count()
    for out in (partition.iid(rows, 6), partition.quantity_skew(rows, [3, 1, 1]), partition.label_skew(rows, [[0.5, 0.5]] * 5), partition.natural(rows)):
        assert out.count() == n and out.select("row_id").distinct().count() == n
    small = partition.rebalanced(partition.quantity_skew(rows, [50, 1, 1]).select("row_id", "client"), 3, 30)
    assert min(r[1] for r in small.groupBy("client").count().collect()) == 30


def test_stratified_split_keeps_shares():
    y = (np.random.default_rng(0).random((400, 4)) < [0.5, 0.2, 0.1, 0.05]).astype(int)
    out = partition.stratified_split(y, 0.25)
    assert abs(out.mean() - 0.25) < 0.05
    assert np.allclose(y[out].sum(0) / y.sum(0), 0.25, atol=0.06)


def test_exact_p():
    assert stats.exact_p(0, 5) == pytest.approx(0.0625)
    assert stats.exact_p(7.5, 5) == 1.0


def test_metrics_of_empty_counters(spark):
    c = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 0, 0, 0)], "silo int, l int, tp long, fp long, fn long")
    assert metrics.macro_f1(c).first()[0] == 0 and metrics.micro_f1(c).first()[0] == 0


def test_archives_round_trip(spark, tmp_path):
    x, y = np.array([[0, 1.5], [2, 0], [0, 0]]), np.array([[1, 0], [0, 1], [1, 1]])
    (tmp_path / "a.npz").write_bytes(arrays.encoded(x, y))
    np.savez(tmp_path / "b.npz", X=x, y=y * 3)
    rows = arrays.read_archives(spark, str(tmp_path)).orderBy("path", "row").collect()
    assert [r["x"] for r in rows] == x.tolist() * 2 and [r["y"] for r in rows] == y.tolist() * 2


def test_shards_counters_and_reports(spark, tmp_path, sf_dir):
    rows = fixtures.vectors_multi(spark, sf_dir)
    arrays.write_shards(rows, str(tmp_path / "s"))
    some = arrays.read_shards(spark, str(tmp_path / "s"), [1, 2])
    assert some.count() == rows.filter("silo in (1, 2)").count()
    assert "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString() or "silo" in some._jdf.queryExecution().toString()
    c = literal(spark, "parts", sf_dir)
    arrays.write_counters(c, str(tmp_path / "c"))
    assert sorted(map(tuple, arrays.read_counters(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, c.collect()))
    grid = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "k string, seed int, v double")
    assert arrays.append_report(grid, str(tmp_path / "r"), ["k", "seed"]) == 2
    assert arrays.append_report(grid.unionByName(spark.createDataFrame([("c", 1, 1.0)], grid.schema)), str(tmp_path / "r"), ["k", "seed"]) == 1
    arrays.append_history(spark, str(tmp_path / "h"), [{"gen": 0, "hv": 0.5, "n_nd": 3, "evals": 8, "stagnant": 0}])
    assert spark.read.json(str(tmp_path / "h")).count() == 1


def test_packed_masks(spark):
    m = spark.createDataFrame([(0, [0, 2, 15]), (1, [])], "i int, sel array<int>")
    p = arrays.packed(m, 16)
    assert p.orderBy("i").first()["bytes"] == np.packbits([j in (0, 2, 15) for j in range(16)]).tolist()
    assert [r["sel"] for r in arrays.unpacked(p.drop("sel"), 16).orderBy("i").collect()] == [[0, 2, 15], []]


def test_settings():
    s = config.Settings({"a": {"b": 1}})
    s.set("a.c", "0.5")
    s.set("d.e", "true")
    assert s.get("a.c") == 0.5 and s.get("d.e") is True and s.get("x.y", 3) == 3
    assert config.method("warm25").max_ratio == 0.25
    assert config.objective_names([" F1_Macro", "ratio"]) == ["macro_f1", "ratio"]
    with pytest.raises(ValueError):
        config.objective_names(["ranking"])


def test_synthetic_cardinality():
    data = synthetic.generate(2000, 30, 6, 4, cardinality=2.0, seed=1)
    assert abs(data["y"].sum(1).mean() - 2.0) < 0.2 and set(data["silo"]) <= {0, 1, 2, 3}


def test_greedy_selection_and_cap(spark, sf_dir):
    assert relevance.greedy_selection([1.0, 0.9, 0.5], [[0, 1, 0], [1, 0, 0], [0, 0, 0]], 2) == [0, 2]
    with pytest.raises(ValueError):
        relevance.greedy_mask(fixtures.vectors_multi(spark, sf_dir), 59, 0.1, cap=10)


def test_search_operators():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = search.random_mask(20, 0.1, rng), search.random_mask(20, 0.1, rng)
        child = search.crossover(a, b, rng)
        assert child and set(child) <= {*a, *b}
        assert search.flip(a, 20, 0.05, 0.5, rng)
    rows = [{"l": k, "j": j, "r": float((j + k) % 7)} for k in range(3) for j in range(20)]
    g = search.Guide(rows, 20)
    g.update({0: 0.9, 1: 0.1, 2: 0.9})
    assert max(g.hardness, key=g.hardness.get) == 1 and abs(sum(g.hardness.values()) - 1) < 1e-9
    assert len(g.coverage(5, rng)) == 5
    assert len(g.swap((1, 2, 3), rng)) == 3 and len(g.swap((1, 2, 3), rng, guided=False)) == 3


def test_columns(spark):
    one = spark.range(1)
    r = one.select(C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), C.finite(F.lit(float("inf"))), C.fixed_point(F.lit(2.5), 0), C.mask_list(F.lit("1,5,9")), C.clip(F.lit(3.0), 0.0, 1.0)).first()
    assert tuple(r) == (0.0, 0.0, 2, [1, 5, 9], 1.0)
    with pytest.raises(Exception):
        one.select(C.fixed_point(F.lit(1e18), 20)).collect()


def event_files(spark, where, batches):
    """Event tables of a file each, modified one after the other."""
    (where / "events.parquet").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(where / f"b{i}"))
        part = next((where / f"b{i}").glob("part-*"))
        to = where / "events.parquet" / f"part-{i}.parquet"
        part.rename(to)
        os.utime(to, (1_700_000_000 + 10 * i,) * 2)


def test_rounds_over_many_files(spark, tmp_path):
    r = random.Random(5)
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour, 30)
    rows = [(i, at(1 + i // 30, i % 30 * 23 // 30), r.randrange(9), "x", float(i), None) for i in range(90)]
    late = [(500, at(1, 3), 2, "x", 1.0, None), (501, at(3, 1), 2, "x", 1.0, None)]  # the first comes after its window is closed
    batches = [rows[:10], rows[10:40], rows[40:75], rows[75:85] + late, rows[85:]]
    event_files(spark, tmp_path, batches)
    got = sorted(map(tuple, rounds.deadline_windows(spark, str(tmp_path), files_per_batch=1).collect()))
    want = {}
    for e in [*rows, late[1]]:
        key = (f"2024-01-0{e[1].day}", e[2] % 5)
        want[key] = want.get(key, 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())
    quorum = sorted(map(tuple, rounds.quorum_rounds(spark, str(tmp_path), 0.5, files_per_batch=1).collect()))
    expected = []
    for day, mass in ((1, 31), (2, 30), (3, 31)):
        arrived = [e for b in batches for e in sorted(b, key=lambda e: (e[1], e[0])) if e[1].day == day][: -(-mass // 2)]
        expected.append((f"2024-01-0{day}", len({e[2] % 5 for e in arrived}), len(arrived), sum(e[4] for e in arrived)))
    assert quorum == expected


def test_a_cluster_needs_a_shared_folder():
    conf, folder = SimpleNamespace(get=lambda k: None), SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=sc))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("of", ["train", "val"])
def test_neighbours_over_tiles(spark, sf_dir, metric, of):
    rows = knn.projected(fixtures.vectors_multi(spark, sf_dir), [0, 3, 7])
    whole, tiled = (sorted(map(str, knn.neighbours(rows, 4, of, metric, block).collect())) for block in (4096, 9))
    assert whole == tiled and whole
    data = {}
    for r in rows.collect():
        data.setdefault(r["silo"], {}).setdefault(r["split"], []).append((r["row_id"], np.array(r["x"])))
    got = {}
    for r in knn.neighbours(rows, 4, of, metric, 9).orderBy("rank").collect():
        got.setdefault(r["row_id"], []).append(r["nbr_id"])
    for parts in data.values():
        for i, q in parts[of]:
            near = lambda x: round(float(q @ x / np.linalg.norm(q) / np.linalg.norm(x)) if metric == "cosine" else -float(((q - x) ** 2).sum()), 9)  # noqa: E731, B023
            assert got[i] == [j for _, j in sorted((-near(x), j) for j, x in parts["train"] if j != i)[:4]]


def test_redundancy_is_the_correlation(spark, sf_dir):
    rows = fixtures.vectors_multi(spark, sf_dir)
    x = np.array([r["x"] for r in rows.filter("split = 'train'").collect()])
    want = np.abs(np.corrcoef(x.T))
    assert all(abs(want[i, j] - r) < 1e-9 for i, j, r in relevance.redundancy(rows).collect())


def test_search_moves_and_risk():
    rng = np.random.default_rng(3)
    rows = [SimpleNamespace(**{"l": k, "j": j, "r": float((j + k) % 7)}) for k in range(3) for j in range(20)]
    g = search.Guide([{"l": r.l, "j": r.j, "r": r.r} for r in rows], 20)
    m = (1, 5, 9)
    plain = {search.mutated(m, g, rng, 1.0, 0.0) for _ in range(200)}
    guided = {search.mutated(m, g, rng, 0.0, 1.0) for _ in range(200)}
    assert all(len(x) == 3 and len({*x} & {*m}) == 2 for x in plain | guided)
    assert len({next(iter({*m} - {*x})) for x in guided}) == 1 < len({next(iter({*m} - {*x})) for x in plain})
    assert {len(search.mutated(m, g, rng, 0.0, 0.0)) for _ in range(50)} != {3}
    pop = [search.Solution((i,), (i / 10, 1 - i / 10), risk=float(i == 4)) for i in range(11)]
    order = [x.mask[0] for x in search.ranked(pop, 0.5)]
    assert order[-1] == 4 and set(order[:2]) == {0, 10}
    assert len(g.population(10, 0.3, rng, 0.0)) == 10 and g.ranked_mask(4) in g.population(10, 0.2, rng, 0.3, filters=True)


def test_objectives_of_the_search(spark, sf_dir):
    rows = fixtures.vectors_multi(spark, sf_dir)
    names = ("macro_f1", "micro_f1", "ratio", "hamming", "gmean", "hmean")
    n_val = rows.filter("split = 'val'").count()
    for mode in ("global", "local_avg"):
        got = search.Evaluator(rows, 59, objectives=names, mode=mode).evaluated([tuple(range(16)), ()])
        counters = knn.batch_counters(rows, [list(range(16))]).drop("mask_id", "n_val")
        want = metrics.objectives(counters, 16, 59, n_val, mode).first()
        assert got[0].objectives == pytest.approx(tuple(want))
        assert got[0].risk == pytest.approx(metrics.dispersion(counters).first()["std_macro"])
        assert got[1].objectives == (1.0, 1.0, 0.0, 1.0, 1.0, 1.0)


def test_an_experiment_writes_its_reports(spark, sf_dir, tmp_path):
    rows = fixtures.vectors_multi(spark, sf_dir)
    settings = config.Settings({"method": "portfolio", "objectives": ["micro_f1", "ratio"], "search": {"population": 6, "generations": 2}, "log": str(tmp_path / "run.log")})
    out = runner.run(lambda: (rows.filter("row_id % 5 <> 4"), rows.filter("row_id % 5 = 4"), 59), settings, str(tmp_path / "out"))
    front = spark.read.json(str(tmp_path / "out/front")).collect()
    assert len(front) == out["front"] and all(len(r["objectives"]) == 2 for r in front)
    assert spark.read.json(str(tmp_path / "out/communication")).first()["messages"] == out["communication"]["messages"] > 0
    assert spark.read.json(str(tmp_path / "out/budgets")).count() == len(out["budgets"]) and spark.read.json(str(tmp_path / "out/summary")).first()["method"] == "portfolio"
    assert "generation 1" in (tmp_path / "run.log").read_text()


def test_stratified_folds_spread_every_label(spark, sf_dir):
    t = partition.stratified_folds(fixtures.orders_by_nation(spark, sf_dir), 4).persist()
    for stratum, counts in ((r["stratum"], r["n"]) for r in t.groupBy("stratum", "fold").count().groupBy("stratum").agg(F.collect_list("count").alias("n")).collect()):
        assert max(counts) - min(counts) <= 1, stratum
    t.unpersist()


def test_neighbour_information():
    rng = np.random.default_rng(8)
    assert relevance.digamma(np.array([1.0, 2.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, 0.42278433509846713, -1.9635100260214235, 2.251752589066721], abs=1e-10)
    for n, classes in ((2, 1), (9, 3), (60, 2)):
        x, y = rng.normal(size=n).round(n % 4), rng.integers(0, classes, n)
        digamma = lambda v: float(relevance.digamma(np.array([v]))[0])
        terms, some = [], [i for i in range(n) if (y == y[i]).sum() > 1]
        for i in some:
            mates = [abs(x[i] - x[j]) for j in range(n) if j != i and y[j] == y[i]]
            k = min(3, len(mates))
            r = np.nextafter(sorted(mates)[k - 1], 0)
            terms.append((digamma(k), digamma(len(mates) + 1), digamma(max(1, sum(abs(x[i] - x[j]) <= r for j in some)))))
        want = max(0.0, digamma(len(some)) + np.mean([a - b - c for a, b, c in terms])) if some else 0.0
        assert relevance.information(x, y) == pytest.approx(want, abs=1e-9)
    strong = relevance.information(np.concatenate([rng.normal(size=300), rng.normal(5, 1, 300)]), np.repeat([0, 1], 300))
    assert strong == pytest.approx(np.log(2), abs=0.06) and relevance.information(rng.normal(size=600), rng.integers(0, 2, 600)) < 0.06


def test_a_stopped_sweep_goes_on(spark, tmp_path):
    grid, ran = [{"method": m, "seed": i} for m in ("a", "b") for i in range(3)], []

    def one(p):
        if len(ran) == 4:
            raise KeyboardInterrupt
        ran.append((p["method"], p["seed"]))
        return {"value": p["seed"] / 2}

    path, schema = str(tmp_path / "r"), "method string,seed int,value double"
    with pytest.raises(KeyboardInterrupt):
        runner.resumed(spark, grid, one, path, schema)
    ran.clear()
    assert runner.resumed(spark, grid, one, path, schema) == 2 and ran == [("b", 1), ("b", 2)]
    assert runner.resumed(spark, grid, one, path, schema) == 0
    assert runner.known_report(spark, path, schema).count() == 6


def test_best_mask_of_equals(spark, tmp_path):
    path = f"{tmp_path}/supplier.parquet"
    duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) s_suppkey FROM range(1, 501) t(i)) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    got = catalog.QUERIES["t06_best_test_mask"](spark, str(tmp_path)).first()
    assert tuple(got) == con.sql(catalog.ORACLES["t06_best_test_mask"]).fetchall()[0] == (97 * 31 % 17 + 1, 0.0)


def test_neighbours_are_a_sessions_first_query(sf_dir):
    code = f"""
from siloforge.plans import catalog
from siloforge.session import build_session
print("rows", catalog.QUERIES["j04_knn_euclidean"](build_session(2, 2, "1g"), "{sf_dir}").count())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and "rows " in said.stdout, said.stderr[-800:]


def test_secure_sum_over_blocks(spark):
    rows = [(s, p, (s * 37 + p) * (-1) ** s) for s in range(60) for p in range(3) if (s + p) % 7] + [(5, 1, 11)]
    v = spark.createDataFrame(rows, "silo long, pos int, v long")
    want = {p: sum(x for _, q, x in rows if q == p) for p in range(3)}
    for block in (7, 4096):
        m = secure.masked(v, 9, block).collect()
        assert len(m) == len({(s, p) for s, p, _ in rows}) and len({r["v"] for r in m}) == len(m)
        assert {p: (sum(int(r["v"]) for r in m if r["pos"] == p) - want[p]) % 2**64 for p in range(3)} == dict.fromkeys(range(3), 0)
    assert dict(map(tuple, secure.secure_sum(v).collect())) == want


def test_pair_masks_are_those_of_pairs():
    a, b = (np.random.default_rng(i).integers(0, 2**64, 50, np.uint64) for i in (0, 1))
    one = secure.scrambled(a[:, None] ^ b[None, :]).astype(object)
    for same, size in ((False, 64), (False, 1 << 15), (True, 64), (True, 150), (True, 1 << 15)):
        m = np.triu(one, 1) if same else one
        plus, minus = secure.pair_masks(a, b, same, size)
        assert plus.tolist() == [x % 2**64 for x in m.sum(1)] and minus.tolist() == [-x % 2**64 for x in m.sum(0)]


def test_secure_moments_of_many_silos(spark):
    n = 20000  # 4 * 10^8 pairs of silos
    got = secure.secure_moments(spark.range(n).select(F.col("id").alias("silo"), (F.col("id") % 7).cast("double").alias("x"))).first()
    x = np.arange(n) % 7
    assert got["mean"] == pytest.approx(x.mean(), abs=1e-5) and got["std"] == pytest.approx(x.std(), abs=1e-5)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_among_copies(metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 5))[rng.integers(0, 9, 400)]
    for n, k in ((1, 5), (31, 5), (33, 40), (400, 7)):
        own = np.where(np.arange(n) % 2, np.arange(n), -1)
        sim = np.round(x[:n] @ x[:n].T if metric == "cosine" else -((x[:n, None] - x[None, :n]) ** 2).sum(2), 9)
        sim[own >= 0, own[own >= 0]] = -np.inf
        got = np.concatenate([top for _, top, _ in knn.nearest(x[:n], x[:n], k, own, metric)])
        assert np.array_equal(got, np.argsort(-sim, axis=1, kind="stable")[:, :k])


@pytest.mark.parametrize("d", [1, 2, 3, 18])
@pytest.mark.parametrize("kind", ["apart", "copies", "some copies", "near", "zeros"])
def test_places_by_single_precision_are_the_nearest(d, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, d))
    if kind != "apart":
        part = slice(0, 100) if kind == "some copies" else slice(0, 700)
        x[part] = {"near": x[:1] + 1e-6 * x, "zeros": x * (rng.random((700, 1)) < 0.3)}.get(kind, x[rng.integers(0, 20, 700)])[part]
    x = knn.unit(x)
    for n, k in ((2, 1), (6, 5), (130, 5), (700, 5)):
        for own in (None, np.arange(n)):
            q = x[:n] if own is not None else knn.unit(x[::-1] + 0.1)
            want = np.concatenate([top for _, top, _ in knn.nearest(q, x[:n], k, own)])
            assert np.array_equal(np.sort(knn.nearest_places(q, x[:n], k, own), 1), np.sort(want, 1))


def test_tasks_of_a_batch_are_even(spark, sf_dir):
    c = knn.batch_counters(fixtures.vectors_multi(spark, sf_dir), [[i, i + 1] for i in range(12)])
    of = c.select("silo", "mask_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").agg(F.countDistinct("silo").alias("silos"), F.count(F.lit(1)).alias("n")).collect()
    assert len(of) == 16 and {r["silos"] for r in of} == {1} and {r["n"] for r in of} == {6}


def test_large_and_many_silos_are_dealt(spark):
    uneven = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") < 800, 7).when(F.col("id") < 890, 1).alias("silo"), F.lit("train").alias("split"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1)).alias("y"))
    got = {tuple(r) for r in knn.deal(uneven).rows.groupBy("silo", "copies").agg(F.countDistinct("copy").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(7, 16, 16, 800 * 16), (1, 1, 1, 90), (None, 1, 1, 10)}
    many = knn.deal(uneven.withColumn("silo", F.col("row_id")))
    of = many.rows.groupBy(F.spark_partition_id()).count().collect()
    assert many.rows.count() == 900 and len(of) == 64 and {r["count"] for r in of} <= {14, 15}


def test_searches_in_step_are_those_alone(spark, sf_dir, monkeypatch):
    rows, jobs, plain = fixtures.vectors_multi(spark, sf_dir), [], knn.batch_counters
    monkeypatch.setattr(knn, "batch_counters", lambda r, masks, *a: jobs.append(masks) or plain(r, masks, *a))
    wish = {"population": 5, "generations": 2, "blend": 0.15}
    searches = [wish | {"seed": 1}, wish | {"seed": 1, "blend": 0.0}, wish | {"seed": 2, "participation": 0.5}, wish | {"seed": 2, "generations": 1, "objectives": ("hamming", "ratio"), "mode": "local_avg"}]
    alone = [search.run(rows, 59, **w) for w in searches]
    before, step = len(jobs), search.together(rows, 59, searches)
    for a, b in zip(alone, step, strict=True):
        assert b.evaluated == a.evaluated and [x.mask for x in b.population] == [x.mask for x in a.population]
        assert [x for s in b.population for x in (*s.objectives, s.risk)] == pytest.approx([x for s in a.population for x in (*s.objectives, s.risk)])
        assert [h["evals"] for h in b.history] == [h["evals"] for h in a.history] and [h["hv"] for h in b.history] == pytest.approx([h["hv"] for h in a.history])
    assert before == 3 + 3 + 3 + 2 and len(jobs) - before <= 2 * 3  # a generation's silos are all or a sample
    jobs.clear()
    got = runner.compared(rows, rows.limit(50), 59, ["base", "stable"], [1, 2], config.Settings({"search": {"population": 4, "generations": 2}}))
    assert got.count() == 4 and len(jobs) == 3 + 1
    assert all(len(set(map(tuple, masks))) == len(masks) for masks in jobs[:3])


def test_an_experiment_reads_its_rows_once(spark, sf_dir):
    rows, seen = fixtures.vectors_multi(spark, sf_dir), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    settings = config.Settings({"method": "aware", "seed": 3, "search": {"population": 4, "generations": 1}})
    out = runner.run(lambda: (rows.mapInArrow(counted, rows.schema), rows.limit(50), 59), settings)
    assert len(out["test_macro"]) == out["front"] and seen.value == 2 * rows.count()  # once to count the silos' rows, once to keep them


def test_partitions_are_known_without_a_job(spark):
    ints = spark.range(5000).select(F.hash(F.col("id").cast("int")).alias("h")).collect()
    assert [r["h"] for r in ints] == knn.hashed(np.arange(5000)).tolist()
    for n in (1, 7, 24, 300):
        to = spark.createDataFrame([(i,) for i in knn.in_partitions(n)], "i int").select(F.pmod(F.hash("i"), F.lit(n)).alias("p")).collect()
        assert [r["p"] for r in to] == list(range(n))
