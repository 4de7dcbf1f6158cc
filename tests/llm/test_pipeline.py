from __future__ import annotations

import itertools

import duckdb
from test_decontaminate import brute as hit_words
from test_sharding import brute as sharded_by_hand
from test_simhash import joined, shingles

import corpus_pipeline
from siloforge.llm import mixing, quality
from siloforge.session import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / str(n)))
            out = spark.read.parquet(str(tmp_path / str(n)))
            assert {r["doc_id"] for r in out.collect()} <= before
            assert all(seen[r["doc_id"]] == r["text"] for r in out.collect())
            if n < 3:
                assert out.select("doc_id").distinct().count() == out.count()
        else:
            assert out.count() == docs.count()
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_empty(spark, documents, sf_dir):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()}
    kept = [r["doc_id"] for r in quality.op1(spark, sf_dir).collect() if r["score"] >= 0.7]  # its votes have a brute-force test of their own
    sets = [shingles(rows[i][0] or "") if (rows[i][0] or "").split() else set() for i in kept]
    comp = joined(len(kept), [(a, b) for a, b in itertools.combinations(range(len(kept)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    low = {}
    for i, c in zip(kept, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    kept = sorted(low.values())
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    hits = hit_words([rows[i][0] for i in kept], items)
    kept = [i for i, (_, n, hit, _) in zip(kept, hits, strict=True) if not (hit and 20 * hit >= n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, *rows[i]) for i in kept])
    times = {i: taken // size for i, size, _, _, taken in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall() if size}
    assert all((rows[i][0] or "").split() for i in kept)  # so every document's share of the mix shows
    mixed = [(i, rows[i][0]) for i in kept for _ in range(times[i])]
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "shard", "slot"} <= set(out.columns)
    got = out.collect()
    assert all(r["text"] == rows[r["doc_id"]][0] for r in got)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], None) for r in got), key=str) == sharded_by_hand(mixed)
