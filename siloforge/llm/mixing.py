"""Mixing sources to target weights by hash-threshold histograms.

Each source takes all its documents as often as its target holds its size, and of one more round the documents whose
hash lies below a threshold. The thresholds are nested: sizes are summed by source and hash bucket, the bucket
where the running sum crosses the budget is found, and only that bucket's documents are summed again by the next
BITS of the hash, until all BITS * LEVELS are used. Nothing is sorted but the sums. The documents of the last
boundary value are taken if that comes nearer to the target.

A document's hash is the first 15 hexadecimal digits of the MD5 of its id (a null id: of its text), so reruns and
subsets agree; rows of equal id share their fate. A null text has size 0; a null source is a source, last in
order. Other columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.llm.rows import named
from siloforge.llm.sharding import numbered
from siloforge.session import cut, discard, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds target: the budget's shares by weight, where no source gets over most times its size and the rest of it goes to the others.

    Sources that their share would fill are closed at most times their size, and what they leave is shared anew among the open ones, until none closes any more. A round is one sum over the sources; nothing but the round's sums comes to the driver.
    """
    rows, _ = numbered(sizes, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__sf_row") % len(weights) + 1).cast("int")).cast("long")
    df = rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    whole = df.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, left, rest, closed = (whole[0] or 0) * share, (whole[0] or 0) * share, whole[1] or 0, 0
    while True:
        full = F.col("cap") * float(rest) <= F.lit(left) * F.col("weight")
        n, taken, open_ = df.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == closed:
            break
        closed, left, rest = n, budget - (taken or 0), open_ or 0
    return df.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.lit(left) * F.col("weight") / float(rest or 1)).alias("target"))


def of_source(edges: DataFrame, *columns: Column) -> tuple[DataFrame, Column]:
    """edges with the source as s and these columns, to broadcast (a row a source), and the condition that joins them."""
    return edges.select(F.col("source").alias("s"), *columns), F.col("source").eqNullSafe(F.col("s"))


def thresholds(sized: DataFrame, goal: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(source, rounds, threshold): documents with a hash below the threshold are taken rounds + 1 times, the others rounds times. Each level's boundary buckets are written; from the second level on only the documents of the first level's boundary buckets are read, which are written too."""
    goal = goal.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    edge = goal.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    inside = sized.select("source", "hash", "size").filter("size > 0")
    for n in range(levels):
        shift = bits * (levels - 1 - n)
        own = inside
        if n:
            e, same = of_source(edge, F.col("prefix").alias("p"))
            own = inside.join(e, same & (F.shiftright("hash", shift + bits) == F.col("p")), "left_semi")
            if n == 1:
                own = inside = cut(own, "boundary")
        sums = own.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))  # at most 2 ** bits rows a source
        e, same = of_source(edge, F.col("budget").alias("budget"))
        at = sums.withColumn("run", run).join(e, same).filter((F.col("run") > F.col("budget")) & (F.col("run") - F.col("size") <= F.col("budget")))
        edge = cut(at.select("source", (F.col("budget") - (F.col("run") - F.col("size"))).alias("budget"), F.col("bucket").alias("prefix"), F.col("size").alias("last")), "edges")
    whole = F.when(F.col("last") - F.col("budget") < F.col("budget"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    e, same = of_source(edge, whole.alias("threshold"))
    # where no bucket crosses the budget, it is the size of the whole source at most: nothing is left to take
    return goal.join(e, same, "left").select("source", "source_size", "target", "rounds", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, hash, size) of every document, written once; and the sources' thresholds."""
    sized = cut(docs.select("doc_id", "source", mix_hash().alias("hash"), n_words(F.col("text")).alias("size")), "sizes")
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = cut(targets(sources, weights, share, most), "targets")
    edges = cut(thresholds(sized, goal), "thresholds")
    for x in (sources, goal):
        discard(x)
    return sized, edges


def times() -> Column:
    return F.col("rounds") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times it is taken."""
    sized, edges = plan(docs, weights, share, most)
    e = edges.withColumnRenamed("source", "s")
    return sized.join(e, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", times().alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    sized, edges = plan(docs, weights, share, most)
    discard(sized)
    e = edges.select(F.col("source").alias("__sf_s"), F.col("rounds").alias("__sf_r"), F.col("threshold").alias("__sf_t"))
    n = F.col("__sf_r") + F.when(mix_hash() < F.col("__sf_t"), 1).otherwise(0)
    both = docs.join(e, docs["source"].eqNullSafe(F.col("__sf_s"))).withColumn("__sf_n", n).filter("__sf_n > 0")
    return both.select(*map(named, docs.columns), F.explode(F.sequence(F.lit(1), F.col("__sf_n"))).alias("__sf_i")).drop("__sf_i")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 cap, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] weight, row_number() OVER (ORDER BY source NULLS LAST) nth FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nth) k FROM w),
v AS (SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(CAST(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) lft,
    CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) rest FROM o),
f AS (SELECT min(k) a FROM v WHERE cap * rest > lft * weight),
t AS (SELECT v.source, source_size, CASE WHEN k >= f.a THEN (SELECT lft FROM v, f WHERE k = a) * weight / (SELECT rest FROM v, f WHERE k = a) ELSE CAST(cap AS DOUBLE) END target FROM v, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END rounds FROM t),
e AS (SELECT source, h, sum(size) x FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT source, h, x, sum(x) OVER (PARTITION BY source ORDER BY h) run FROM e),
b AS (SELECT g.source, CASE WHEN run - (target - rounds * source_size) < (target - rounds * source_size) - (run - x) THEN h + 1 ELSE h END edge
    FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE run > target - rounds * source_size AND run - x <= target - rounds * source_size)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CASE WHEN h < coalesce(edge, 0) THEN 1 ELSE 0 END) AS BIGINT) taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM g.source
"""
