"""Connected components of a graph given as edges, by hooking and contraction.

In each round every node hooks to its smallest neighbour (or itself), and every edge moves to where its ends
hooked; loops and repetitions go. A node's component is where its chain of hooks ends. Nodes are renamed by a
bijective hash first, so that the rounds stay few on chains, whatever the order of the ids. A dense group shrinks to
next to nothing in its first round. A round has an aggregation, pre-aggregated before its shuffle, and a join
for either end, whose heavy side can be split, as the other has one row a node. Rounds are cut with tables
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siloforge.session import cut, discard

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs. Returns (node, component) for every node of an edge between two nodes; a component is named by its smallest node. Repeated and looping edges don't matter. The result is a table of its own, which discard() deletes."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.xxhash64("node"))
    used = [edges]
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        both = now.union(now.select("b", "a"))
        hooks = cut(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low")).select("n", F.least("n", "low").alias("to")), "hooks")
        used.append(hooks)
        label = label.join(hooks, F.col("label") == F.col("n"), "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = now.join(hooks, F.col("a") == F.col("n")).select(F.col("to").alias("x"), "b").join(hooks, F.col("b") == F.col("n")).select("x", F.col("to").alias("y"))
        new = cut(moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        discard(now)
        now = new
    else:
        raise RuntimeError("components: edges are left after the rounds allowed")
    label = cut(label, "labels")
    names = label.groupBy("label").agg(F.min("node").alias("component"))
    out = cut(label.join(names, "label").select("node", "component"), "components")
    for x in (*used, now, label):
        discard(x)
    return out
