"""Federations built from the standard tables: rows with a silo, a split, a feature vector x and labels y; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.session import table

#: Centres and scales of the order features, fixed so that any engine gets the same numbers.
ORDER_SCALES = ((130.0, 80.0), (28000.0, 12000.0), (0.2, 0.15), (0.04, 0.02), (5.0, 2.0), (150000.0, 90000.0), (4500.0, 3200.0))


def split_of(condition: Column) -> Column:
    return F.when(condition, "val").otherwise("train")


def vectors_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, 64 features, 10 one-hot labels, 8 silos."""
    e = table(spark, sf_dir, "embeddings")
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (F.col("label") == c).cast("int"))
    return e.select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 8).cast("int").alias("silo"), split_of(F.call_function("div", F.col("vec_id"), F.lit(8)) % 4 == 0).alias("split"),
        F.col("embedding").cast("array<double>").alias("x"), y.alias("y"))


def vectors_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: the signs of the first 5 numbers are labels, the other 59 features."""
    e = table(spark, sf_dir, "embeddings")
    y = F.transform(F.slice("embedding", 1, 5), lambda v: (v > 0).cast("int"))
    return e.select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % 8).cast("int").alias("silo"), split_of(F.call_function("div", F.col("vec_id"), F.lit(8)) % 4 == 0).alias("split"),
        F.slice(F.col("embedding").cast("array<double>"), 6, 59).alias("x"), y.alias("y"))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 25 nations: 7 scaled features, 4 labels. Orders without lines are left out."""
    o, c, li = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("f0"), F.avg("l_extendedprice").alias("f1"), F.sum("l_discount").alias("f2"), F.avg("l_tax").alias("f3"), F.count(F.lit(1)).cast("double").alias("f4"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y0"), F.max((F.col("l_discount") >= 0.1).cast("int")).alias("y3"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(lines, o["o_orderkey"] == lines["l_orderkey"])
    raw = [F.col("f0"), F.col("f1"), F.col("f2"), F.col("f3"), F.col("f4"), F.col("o_totalprice"), F.col("c_acctbal")]
    x = F.array(*((v - a) / b for v, (a, b) in zip(raw, ORDER_SCALES, strict=True)))
    y = F.array(F.col("y0"), (F.col("o_orderpriority") == "1-URGENT").cast("int"), (F.col("o_orderstatus") == "F").cast("int"), F.col("y3"))
    return j.select(F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").alias("silo"), split_of(F.col("o_orderkey") % 4 == 0).alias("split"), x.alias("x"), y.alias("y"))


def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of each source: how many words start with each letter; quality and toxic. The silo is the source's number."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.split(F.lower("text"), " ")
    x = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.size(F.filter(words, lambda w: F.startswith(w, F.chr(c)))).cast("double"))
    return d.select(F.col("doc_id").alias("row_id"), F.substring("source", 4, 9).cast("int").alias("silo"), split_of(F.col("doc_id") % 4 == 0).alias("split"), x.alias("x"), F.array("quality", "toxic").alias("y"))


FIXTURE_SQL = {
    "a1": """a1 AS (SELECT vec_id row_id, CAST(vec_id % 8 AS INT) silo, CASE WHEN (vec_id // 8) % 4 = 0 THEN 'val' ELSE 'train' END split,
  list_transform(embedding, lambda v: CAST(v AS DOUBLE)) x, list_transform(range(0, 10), lambda c: CAST(label = c AS INT)) y FROM embeddings)""",
    "a2": """a2 AS (SELECT vec_id row_id, CAST(vec_id % 8 AS INT) silo, CASE WHEN (vec_id // 8) % 4 = 0 THEN 'val' ELSE 'train' END split,
  list_transform(embedding[6:64], lambda v: CAST(v AS DOUBLE)) x, list_transform(embedding[1:5], lambda v: CAST(v > 0 AS INT)) y FROM embeddings)""",
    "b": """b AS (SELECT o_orderkey row_id, c_nationkey silo, CASE WHEN o_orderkey % 4 = 0 THEN 'val' ELSE 'train' END split,
  [(f0 - 130.0) / 80.0, (f1 - 28000.0) / 12000.0, (f2 - 0.2) / 0.15, (f3 - 0.04) / 0.02, (f4 - 5.0) / 2.0, (o_totalprice - 150000.0) / 90000.0, (c_acctbal - 4500.0) / 3200.0]::DOUBLE[] x,
  [y0, CAST(o_orderpriority = '1-URGENT' AS INT), CAST(o_orderstatus = 'F' AS INT), y3] y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, sum(l_quantity) f0, avg(l_extendedprice) f1, sum(l_discount) f2, avg(l_tax) f3, CAST(count(*) AS DOUBLE) f4,
    max(CAST(l_returnflag = 'R' AS INT)) y0, max(CAST(l_discount >= 0.1 AS INT)) y3 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
    "c": """c AS (SELECT doc_id row_id, CAST(substr(source, 4) AS INT) silo, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END split,
  list_transform(range(97, 123), lambda k: CAST(len(list_filter(string_split(lower(text), ' '), lambda w: starts_with(w, chr(CAST(k AS INT))))) AS DOUBLE)) x, [quality, toxic] y FROM documents JOIN labels USING (doc_id))""",
}


def rows_sql(name: str) -> str:
    """CTEs of a fixture's rows, its features (row_id, j, v) and labels (row_id, l, v) in long form."""
    return f"""{FIXTURE_SQL[name]},
r AS (SELECT * FROM {name}),
xl AS (SELECT row_id, silo, split, unnest(range(0, len(x))) j, unnest(x) v FROM r),
yl AS (SELECT row_id, silo, split, unnest(range(0, len(y))) l, unnest(y) v FROM r)"""


def long_x(rows: DataFrame) -> DataFrame:
    """(row_id, silo, split, j, v): a row a feature."""
    return rows.select("row_id", "silo", "split", F.posexplode("x").alias("j", "v"))


def long_y(rows: DataFrame) -> DataFrame:
    """(row_id, silo, split, l, v): a row a label, absent ones too."""
    return rows.select("row_id", "silo", "split", F.posexplode("y").alias("l", "v"))
