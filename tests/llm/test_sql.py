"""Queries that SQL can express give the SQL's rows, on the given tables and on awkward ones."""

from __future__ import annotations

import duckdb
import pytest
from harness import duck_table, spark_table

from siloforge.llm import decontaminate, linededup, mixing, registry, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(name, spark, duck, sf_dir):
    assert spark_table(registry.QUERIES[name](spark, sf_dir)) == duck_table(duck, registry.ORACLE_SQL[name])


WORDS = "the quick brown fox jumps over a lazy dog and then runs away from every bear in sight today".split()
AWKWARD = [
    (1, None, None), (2, "", "b"), (3, " \t\n\x0b \r\n", "a"), (4, "A b\nA B\n a b \nx", "é"), (4, "A b\nA B\n a b \nx", "é"), (None, "no id at all", "a"), (5, "ß Ünï 東京 42\n\n", None),
    (6, " ".join(WORDS), "a"), (7, "Zzz " + " ".join(WORDS[2:17]) + " qqq", "b"), (8, " ".join(["word"] * 40), "c"), (9, "The QUICK, brown; fox! jumps? over a lazy dog and then runs away", "c"),
    (10, "ok fine then", "a"), (11, "long " * 20000, "big"), *((20 + i, f"common line\nown {i}\nCommon LINE ", "hot") for i in range(12)),
]
ITEMS = [(1, " ".join(WORDS)), (2, "ok fine"), (3, None), (4, ""), (5, "word " * 15), (5, "OK Fine"), (None, "no id"), (12, "東京")]


def files(tmp_path, spark, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_documents(rows, spark, documents, wide, tmp_path):
    con, where = files(tmp_path, spark, documents=documents(rows).repartition(3), benchmark=wide(ITEMS, "item_id long, text string"))
    for query, sql in ((linededup.op5, linededup.ORACLE), (decontaminate.op6, decontaminate.ORACLE), (mixing.op7, mixing.ORACLE)):
        if not rows:
            assert query(spark, where).count() == 0
        else:
            assert spark_table(query(spark, where)) == duck_table(con, sql)


def test_decontamination_by_shuffle_is_the_same(spark, documents, wide, tmp_path):
    docs, items = documents(AWKWARD), wide(ITEMS, "item_id long, text string")
    a = decontaminate.contamination(docs, items)
    b = decontaminate.contamination(docs, items, broadcast_bytes=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert decontaminate.contamination(docs, items.limit(0), 0).filter("size(items) > 0").isEmpty()
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id in (6, 7, 8)").isEmpty() and not kept.filter("doc_id = 11").isEmpty()


def test_awkward_pages(spark, wide, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(1, "http://a.b/c d\r\nWARC/1.1", same), (2, None, same), (2, None, same), (3, "u%41", None), (4, "", ""), (None, "x", same), (5, "y", "short"), (6, "y", "short"), (7, "z", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (8, "é", "é" * 50), (9, "é", "é" * 50), (10, "n", "x" * 300000)]
    con, where = files(tmp_path, spark, pages=wide(rows, "page_id long, url string, html string"))
    assert spark_table(warc.op10(spark, where)) == duck_table(con, warc.ORACLE)


def test_line_runs_compact(spark):
    runs = linededup.LineRuns(spark, 5, fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(b"a", 2), (b"b", 1), (bytes([n]), 9 - n)], "hash binary, documents long"))
    assert sorted(bytes(r[0]) for r in runs.frequent().collect()) == [b"\x00", b"\x01", b"\x02", b"\x03", b"\x04", b"a", b"b"]
    assert len(runs.levels) > 2 and all(len(x) < 2 for x in runs.levels)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if "run" in t.name]


def test_a_batch_is_merged_with_the_runs_in_place(spark):
    runs = linededup.LineRuns(spark, 5, fanout=9)
    rows = lambda n: spark.range(n * 300, n * 300 + 900).selectExpr("unhex(md5(cast(id as string))) AS hash").groupBy("hash").count().withColumnRenamed("count", "documents")
    for n in range(3):
        runs.add(rows(n))
    plan = runs.merged(rows(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 6 and "BroadcastExchange" not in plan
    runs.close()


@pytest.mark.parametrize("most", [0, 10**6])
def test_line_dedup_with_and_without_broadcast(spark, documents, tmp_path, most):
    con, where = files(tmp_path, spark, documents=documents(AWKWARD).repartition(3))
    out = linededup.dedup_lines(spark.read.parquet(f"{where}/documents.parquet"), broadcast_keys=most).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS kept_sha256")
    assert spark_table(out) == duck_table(con, linededup.ORACLE)


def test_mix_repeats_rows(spark, documents):
    docs = documents([(i, "w " * (i % 7 + 1), "ab"[i % 2] if i % 5 else None) for i in range(300)])
    out, plan = mixing.mix(docs), {r["doc_id"]: r["times"] for r in mixing.mixture(docs).collect()}
    assert out.columns == docs.columns
    got = {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    for r in mixing.mixture(docs).selectExpr("source", "size * times t", "target").groupBy("source", "target").sum("t").collect():
        assert abs(r[2] - r[1]) <= 7


def test_clean_by_shuffle_is_the_same(spark, documents, wide):
    own, bad = "some words of no test item at all", "a test item of a few words"
    docs = documents([(1, own), (1, bad), (None, own), (None, bad), (None, None), (2, bad), (3, own), (3, own), (4, "")])
    items = wide([(1, bad)], "item_id long, text string")
    a, b = (decontaminate.clean(docs, items, most) for most in (decontaminate.BROADCAST_BYTES, 0))
    assert a.columns == b.columns == docs.columns
    rows = [sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str) for df in (a, b)]
    assert rows[0] == rows[1] == sorted([(1, own), (None, own), (None, None), (3, own), (3, own), (4, "")], key=str)
