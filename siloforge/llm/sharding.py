"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of (doc_id, CRC-32 and hash of the text): a range partitioning gives each row its
place in its partition, and the partitions' counts give their first numbers, so nothing is ordered in one task. assign()
writes the partitioned keys once. shard() fixes the ranges' bounds and counts their rows beforehand, from the keys alone, and
then shuffles the whole rows once, without writing them. An alternating Feistel network over Z_a x Z_b, the least such product that holds all rows
(a the rounded-up root of their count), permutes the numbers; results beyond the count walk their cycle on. The
permuted number mod the shard count is the shard, and the quotient the slot: both follow from the row number, the
row count and the seed, the law is `rows`, and shard sizes are at most one apart.

Rows equal in all three keys are interchangeable. Null texts have size 8 and CRC-32 0; null ids come first.
Equal texts get no common shard. Other columns are ignored by assign() and kept by shard(), but those that
have the name of one it adds. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.llm.rows import named
from siloforge.session import cut, discard, table

SHARDS, SEED, ROUNDS = 24, 20240229, 6
PRIME = 2147483647


def feistel(x: int, n: int, seed: int = SEED) -> int:
    """The permuted number of x, in plain Python: the rule that permuted() states  for arrays."""
    a, b = sides(n)
    while True:
        u, v = divmod(x, b)
        for r in range(ROUNDS):
            m, c = constants(seed, r)
            if r % 2:
                v = (v + scatter(u, m, c)) % b
            else:
                u = (u + scatter(v, m, c)) % a
        x = u * b + v
        if x < n:
            return x


def sides(n: int) -> tuple[int, int]:
    a = max(1, round(n**0.5))
    while a * a < n:
        a += 1
    return a, -(-max(n, 1) // a)


def constants(seed: int, r: int) -> tuple[int, int]:
    return (seed * 48271 + r * 16807 + 12345) % (PRIME - 1) + 1, (seed * 69621 + r * 40692 + 999) % PRIME


def scatter(v: int, m: int, c: int) -> int:
    t = (v % PRIME * m + c) % PRIME
    t = t * t % PRIME
    return (t * m + c) % PRIME


def permuted(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permuted numbers of x, an int64 array. All products stay below 2^62."""
    a, b = sides(n)

    def once(x: np.ndarray) -> np.ndarray:
        u, v = np.divmod(x, b)
        for r in range(ROUNDS):
            m, c = constants(seed, r)
            w = u if r % 2 else v
            t = (w % PRIME * m + c) % PRIME
            t = (t * t % PRIME * m + c) % PRIME
            u, v = (u, (v + t) % b) if r % 2 else ((u + t) % a, v)
        return u * b + v

    out = once(x)
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = once(out[beyond])
    return out


def numbered(rows: DataFrame, order: list[Column], partitions: int | None = None) -> tuple[DataFrame, int]:
    """rows with a column __sf_row (0 and up, gapless, in that order), and their count. Cut from its lineage, so that a rerun of a task can't renumber rows."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows equal in the whole order are interchangeable: the last key only spreads them
    spread = rows.withColumn("__sf_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(n, *order, "__sf_tie").sortWithinPartitions(*order, "__sf_tie")
    at = F.monotonically_increasing_id()
    placed = cut(ranged.withColumn("__sf_part", F.shiftright(at, 33).cast("int")).withColumn("__sf_at", at.bitwiseAND(F.lit((1 << 33) - 1))).drop("__sf_tie"), "rows")
    counts = {r[0]: r[1] for r in placed.groupBy("__sf_part").count().collect()}  # one row a partition
    first, total = [], 0
    for k in sorted(counts):
        first.append((k, total))
        total += counts[k]
    starts = spark.createDataFrame(first, "__sf_p int, __sf_start long")
    out = placed.join(F.broadcast(starts), F.col("__sf_part") == F.col("__sf_p")).withColumn("__sf_row", F.col("__sf_start") + F.col("__sf_at"))
    return out.drop("__sf_p", "__sf_start", "__sf_part", "__sf_at"), total


def keys(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    return {"doc_id": docs["doc_id"].cast("long"), "size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")), "__sf_hash": F.xxhash64(text)}


def placed(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """rows with shard and slot in place of __sf_row."""

    @F.arrow_udf("long")
    def place(row: pa.Array) -> pa.Array:
        return pa.array(permuted(row.to_numpy(zero_copy_only=False).astype(np.int64), n, seed))

    rows = rows.withColumn("__sf_place", place("__sf_row"))
    at = F.col("__sf_place")
    return rows.withColumn("shard", (at % shards).cast("int")).withColumn("slot", F.call_function("div", at, F.lit(shards))).drop("__sf_place", "__sf_row")


ORDER = ["doc_id", "text_crc32", "__sf_hash"]


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot. Texts are not shuffled."""
    rows, n = numbered(docs.select(*(c.alias(name) for name, c in keys(docs).items())), [F.col(c) for c in ORDER])
    return placed(rows, n, shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")


def bounds_of(short: DataFrame, n: int, each: int = 64) -> list[tuple]:
    """Keys that cut the rows into up to n ranges of about equal counts: every so many of a sorted draw of keys. They decide only how evenly the work is spread, not the rows' numbers."""
    total, few = short.count(), each * n
    line = (short.sample(few / total, SEED) if total > few else short).distinct().collect()  # some 64 rows a range
    keys = sorted(comparable(*r) for r in line)
    return keys[:: max(1, -(-len(keys) // n))][1:]


def comparable(doc: int | None, crc: int, text: int) -> tuple:
    return doc is not None, doc or 0, crc, text


def range_of(bounds: list[tuple]) -> Callable[..., Column]:
    """A column function of the three keys: how many of the bounds are not above them. Bounds are in groups, of which one is searched. No Python worker is needed beside whole texts."""
    if not bounds:
        return lambda doc, crc, text: F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    kind = "struct<known:boolean,doc:bigint,crc:bigint,text:bigint>"
    told = [dict(zip(("known", "doc", "crc", "text"), b, strict=True)) for b in bounds]
    groups = F.from_json(F.lit(json.dumps([told[i : i + step] for i in range(0, len(told), step)])), f"array<array<{kind}>>")
    firsts = F.from_json(F.lit(json.dumps(told[::step])), f"array<{kind}>")

    def at(doc: str, crc: str, text: str) -> Column:
        here = F.struct(F.col(doc).isNotNull().alias("known"), F.coalesce(doc, F.lit(0)).cast("long").alias("doc"), F.col(crc).cast("long").alias("crc"), F.col(text).cast("long").alias("text"))
        below = lambda line: F.size(F.filter(line, lambda b: b <= here))
        group = below(firsts)
        return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.element_at(groups, group))).cast("int")

    return at


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents with all their columns, and size, text_crc32, shard, slot, as assign() gives them. The documents are read twice, so they must be the same each time, as a table's rows are."""
    spark, added, own = docs.sparkSession, ("size", "text_crc32", "shard", "slot"), keys(docs)
    kept = [c for c in docs.columns if c.lower() not in added]
    short = cut(docs.select(*(own[c].alias(c) for c in ORDER)), "keys")
    at = range_of(bounds_of(short, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = {r[0]: r[1] for r in short.groupBy(at(*ORDER).alias("part")).count().collect()}  # one row a range
    discard(short)
    first, n = [], 0
    for k in sorted(counts):
        first.append((k, n))
        n += counts[k]
    starts = spark.createDataFrame(first, "__sf_p int, __sf_start long")
    tie = F.xxhash64(*(named(c) for c in kept if "map<" not in docs.schema[c].dataType.simpleString()))  # rows equal in all three keys have the same place each time
    whole = docs.select(*map(named, kept), own["size"].alias("size"), own["text_crc32"].alias("text_crc32"), own["doc_id"].alias("__sf_id"), own["__sf_hash"].alias("__sf_hash"), tie.alias("__sf_tie"))
    line = ["__sf_id", "text_crc32", "__sf_hash"]
    place = F.row_number().over(W.partitionBy("__sf_part").orderBy(*line, "__sf_tie"))
    rows = whole.withColumn("__sf_part", at(*line)).withColumn("__sf_at", place).join(F.broadcast(starts), F.col("__sf_part") == F.col("__sf_p"))
    return placed(rows.withColumn("__sf_row", F.col("__sf_start") + F.col("__sf_at") - 1), n, shards, seed).select(*map(named, kept), *added)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
