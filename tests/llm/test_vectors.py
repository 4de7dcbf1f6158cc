from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siloforge.llm import neighbours


def brute(rows, top=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = {}
    for i, v in fine.items():
        if i % 20 == 0:
            s = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in fine.items() if j != i and len(w) == len(v))
            out[i] = [(j, -x) for x, j in s[:top]]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(neighbours.op3(spark, sf_dir)), brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len({x for x, _ in got[k]} & {x for x, _ in want[k]}) / len(want[k]) for k in want]) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for k, v in got.items():
        assert all(abs(s - vectors[k] @ vectors[i]) < 1e-12 for i, s in v)
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))


def test_awkward(spark, wide):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, -0.5 * i]) for i in range(61)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(50)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (220, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (240, [1.0, 2.0]), (241, [1.0, 3.0]), (260, [5.0]), (20, [9.0, 9.0, 9.0]), (20, [0.0, 1.0, 2.0])]
    df = wide(rows, "vec_id long, embedding array<float>")
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items()}


def test_index_over_small_blocks(spark, wide, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).round(3)
    x[200:600] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(neighbours.search(wide(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, fraction=0.3, least=60))
    want = brute(rows)
    assert np.mean([len({a for a, _ in got[k]} & {a for a, _ in want[k]}) / 20 for k in want]) >= 0.9
    assert got[220] == want[220]  # a vector with hundreds of copies


def test_empty(spark, wide):
    assert neighbours.search(wide([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", [0, 0.25, 0.5, 1.0])
def test_recall_on_vectors_of_varied_length(spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 48))[rng.integers(0, 100, 4000)] + 0.6 * rng.normal(size=(4000, 48))
    x *= (np.exp(spread * rng.normal(size=4000)) / np.linalg.norm(x, axis=1))[:, None]
    pivots = neighbours.chosen_pivots(x)
    block, w = neighbours.Block(np.arange(4000), x, pivots), neighbours.weights(x[:100], pivots)
    hit = 0
    for q in range(100):
        score = x @ x[q]
        score[q] = -np.inf
        got = block.nearest(q, x[q], w[q], 20, neighbours.FRACTION, neighbours.LEAST)[0]
        hit += len(set(got.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 100 * 20, hit / 2000


def test_equal_vectors_score_alike_in_blocks_of_any_size():
    rng = np.random.default_rng(6)
    for n in (700, 1203, 2001):
        x = rng.normal(size=(n, 61))
        q = x[3] + 0.1 * rng.normal(size=61)
        whole = neighbours.Block(np.arange(n), x, None).nearest(-1, q, None, 20, 1.0, 1)
        one = neighbours.Block(np.arange(1), x[3:4], None).nearest(-1, q, None, 20, 1.0, 1)
        few = neighbours.Block(np.arange(7), x[:7], None).nearest(-1, q, None, 20, 1.0, 1)
        assert whole[0][0] == 3 and whole[1][0] == one[1][0] == few[1][0]


def test_postings_hold_the_prefixes():
    rng = np.random.default_rng(6)
    w = neighbours.weights(rng.normal(size=(300, 9)), neighbours.chosen_pivots(rng.normal(size=(100, 9)), 40), 7)
    files = neighbours.postings(w)
    assert sum(len(rows) for rows, _ in files) == 300 * 7
    back = np.zeros_like(w)
    for p, (rows, held) in enumerate(files):
        back[rows, p] = held
    assert (back == w).all()


def test_blocks_grow_beyond_their_number():
    assert [neighbours.blocks_for(n, 64) for n in (0, 1, 4097, 50_000, 10**6, 10**9)] == [1, 1, 2, 13, 64, -(-(8 * 64 * 10**9) // (64 << 20))]
