"""Tables of solutions, silos, runs and the like, the same for Spark and for SQL: made from the rows of the standard tables, or written by hand where they are parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from siloforge.session import table

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "budgets": ("budget int", [(b,) for b in (1, 2, 4, 6, 8, 12)]),
    "packed": ("i int, bytes array<int>, n_features int", [(0, [160, 1], 16), (1, [255, 128], 9), (2, [0, 0], 12)]),
    "manifest": ("shard string, clients string", [("demo", '[{"client_id": 0, "n_train": 119, "n_val": 39}, {"client_id": 1, "n_train": 150, "n_val": 50}]')]),
}

#: SQL that Spark and DuckDB read alike, over whole standard tables. Numbers are hashes of keys, counts and whole-number sums, so both get the same.
DERIVED = {
    "solutions": """SELECT CAST(s_suppkey AS INT) AS i, CAST(CAST(s_suppkey AS BIGINT) * 7919 % 97 AS DOUBLE) / 97 AS o0, CAST(CAST(s_suppkey AS BIGINT) * 104729 % 89 AS DOUBLE) / 89 AS o1,
  CAST(CAST(s_suppkey AS BIGINT) * 1299709 % 83 AS DOUBLE) / 83 AS o2, CAST(s_suppkey * 31 % 17 + 1 AS INT) AS selected FROM {supplier}""",
    "risks": "SELECT CAST(s_suppkey AS INT) AS i, CAST(s_suppkey * 13 % 11 AS DOUBLE) / 10 AS risk FROM {supplier}",
    "history": """SELECT CAST(s_suppkey AS INT) AS gen, CASE WHEN s_suppkey < 15 OR s_suppkey % 18 = 0 THEN CAST(0.5 AS DOUBLE) - CAST(0.4 AS DOUBLE) / (CAST(s_suppkey AS DOUBLE) + 1) ELSE CAST(0.473333 AS DOUBLE) END AS hv
  FROM {supplier}""",
    "silos": """SELECT round, silo, CAST(count(*) AS INT) AS size, CAST((silo * 7 + round * 3) % 11 + 1 AS DOUBLE) / 2 AS latency
  FROM (SELECT CAST(c_custkey % 3 AS INT) AS round, CAST(c_nationkey AS INT) AS silo FROM {customer}) AS t GROUP BY round, silo""",
    "replies": """SELECT round, silo, CASE WHEN round = 2 AND silo = 1 THEN NULL ELSE CAST(3 * (1 + (round * 7 + silo * 13) % 5) + count(*) % 3 + CASE WHEN silo = 2 THEN 20 ELSE 0 END AS DOUBLE) / 100 END AS took
  FROM (SELECT CAST(c_custkey % 8 AS INT) AS round, CAST(c_nationkey % 3 AS INT) AS silo FROM {customer}) AS t GROUP BY round, silo""",
    "parts": """SELECT silo, l, CAST(sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN f = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN f = 'N' AND s = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM (SELECT CAST(l_suppkey % 25 AS INT) AS silo, CAST(l_linenumber % 3 AS INT) AS l, l_returnflag AS f, l_linestatus AS s FROM {lineitem}) AS t GROUP BY silo, l""",
    "rounds": """SELECT CAST(s_suppkey % 16 + 1 AS INT) AS clients, CAST(s_suppkey * 13 % 400 + 1 AS INT) AS n_selected, CAST(s_suppkey * 29 % 787 + 400 AS INT) AS n_features, CAST(s_suppkey % 20 + 1 AS INT) AS n_labels
  FROM {supplier}""",
    "tests": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'f1' ELSE 'f2' END AS family, 't' || s_suppkey AS test, CAST(s_suppkey * 37 % 101 AS DOUBLE) / 1010 AS p FROM {supplier}",
    "runs": """SELECT dataset, method, seed, CAST(sum(v) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000 AS value
  FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'ecg' ELSE 'icu' END AS dataset, CASE o_orderkey % 3 WHEN 0 THEN 'aware' WHEN 1 THEN 'base' ELSE 'union' END AS method, CAST(o_orderkey % 8 AS INT) AS seed, CAST(o_custkey % 1000 AS BIGINT) AS v
    FROM {orders}) AS t GROUP BY dataset, method, seed HAVING NOT (dataset = 'icu' AND method = 'base' AND seed = 4)""",
    "duplicates": "SELECT CAST(l_orderkey AS BIGINT) AS row_id, CAST(l_linenumber % 3 AS INT) AS j, CAST(l_quantity AS DOUBLE) AS x FROM {lineitem}",
    "masks": "SELECT CAST(p_partkey AS INT) AS mask_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE (p_partkey % 5) || ',' || (p_partkey * 7 % 13 + 5) END AS sel FROM {part}",
    "numbers": "SELECT CAST(s_suppkey AS INT) AS silo, CAST(s_suppkey * 7919 % 2003 AS DOUBLE) / 60 - 15 AS x FROM {supplier}",
}


def literal(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    if name in DERIVED:
        used = set(re.findall(r"\{(\w+)\}", DERIVED[name]))
        return spark.sql(DERIVED[name], **{t: table(spark, sf_dir, t) for t in used})
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def literal_sql(name: str) -> str:
    """The same table as a CTE."""
    if name in DERIVED:
        return f"{name} AS ({re.sub(r'[{}]', '', DERIVED[name])})"

    def value(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    schema, rows = TABLES[name]
    cols = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"string": "VARCHAR", "array<int>": "INT[]"}
    names = ", ".join(c[0] for c in cols)
    casts = ", ".join(f"CAST({c} AS {kinds.get(t, t)}) {c}" for c, t in cols)
    values = ", ".join("(" + ", ".join(value(x) for x in r) + ")" for r in rows)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) t({names}))"
