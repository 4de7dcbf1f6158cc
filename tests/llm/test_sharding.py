from __future__ import annotations

import zlib

import numpy as np
import pytest

from siloforge.llm import sharding
from siloforge.session import cut


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4097])
def test_permutation(n):
    out = sharding.permuted(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert [sharding.feistel(i, n) for i in range(min(n, 300))] == out[:300].tolist()


def test_other_seeds_permute_otherwise():
    a, b = (sharding.permuted(np.arange(5000), 5000, s) for s in (1, 2))
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def brute(rows, shards=24):
    keyed = sorted((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows)
    out = []
    for i, (some, doc, crc, size) in enumerate(keyed):
        p = sharding.feistel(i, len(rows))
        out.append((doc if some else None, size, crc, "rows", p % shards, p // shards, None))
    return sorted(out, key=str)


def test_against_brute_force(spark, documents, tmp_path):
    rows = [(i * 7 % 101, f"text {i}") for i in range(150)] + [(None, None), (None, ""), (3, "é" * 9), (3, "é" * 9), (50, "long " * 50000)]
    documents(rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in sharding.op8(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)
    counts = {}
    for r in got:
        counts.setdefault(r[4], []).append(r[5])
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in counts.values())


def test_reruns_and_other_layouts_agree(spark, documents):
    docs = documents([(i, f"t{i % 9}") for i in range(500)])
    a, b = (sorted(map(tuple, sharding.assign(d).collect())) for d in (docs.repartition(7), docs.coalesce(1)))
    assert a == b


def test_empty(spark, documents):
    assert sharding.assign(documents([])).count() == 0


def test_whole_rows_are_not_written_and_agree(spark, documents, monkeypatch):
    written = []
    monkeypatch.setattr(sharding, "cut", lambda df, *a: written.append(df.columns) or cut(df, *a))
    rows = [(i * 7 % 101, f"text {i}") for i in range(700)] + [(5, f"same id {i % 40}") for i in range(400)] + [(None, None), (None, ""), (None, "a"), (3, "é" * 9), (3, "é" * 9)]
    docs = documents(rows).repartition(5)
    own = lambda df: sorted(map(tuple, df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)
    got = sharding.shard(docs)
    assert all("text" not in c for c in written) and written
    assert own(got) == own(sharding.assign(docs))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(rows, key=str)
    assert sharding.shard(documents([])).count() == 0
