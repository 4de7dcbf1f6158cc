"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (hash, documents), bucketed and sorted by hash. Each batch of documents is reduced to its distinct keys, each
with its number of documents; it is merge-anti-joined with the keys that the runs have settled already (found in at least
MIN_DOCUMENTS), merge-joined with the counts of the runs, which decide what is settled now, and becomes a run of its own on
level 0, with the newly settled keys apart. When FANOUT runs are on a level they are compacted into one of the next level. The index
grows with the distinct keys; a settled key takes no more space, however often it comes.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at both ends and with A-Z lower-cased; empty keys are
kept out. Keys are compared by their MD5. A null or empty text is one empty line. Repeated rows are documents of
their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.session import arrow_limits, cut, discard, fresh_path, remove, table

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCUMENTS, MIN_CHARS, BATCHES, FANOUT = 10, 1, 4, 3
BROADCAST_KEYS = 200_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def key_hash(line: Column, min_chars: int) -> Column:
    """The MD5 of a line's key; null for keys of fewer code points."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


class LineRuns:
    """The levelled runs. add() takes a batch of (hash, documents), one row a hash; frequent() gives the settled hashes, each once.

    A run is a table in the shared folder, bucketed and sorted by hash in as many buckets as a shuffle has partitions, so a batch, which is
    dealt out by hash as it is counted, is merged with the runs in place: runs are never shuffled but when they are compacted.
    """

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT) -> None:
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def write(self, rows: DataFrame) -> str:
        """Writes (hash, documents, settled) as a run; its name."""
        path = fresh_path(self.spark, "run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        rows.write.format("parquet").partitionBy("settled").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def known(self, run: str, settled: bool) -> DataFrame:
        return self.spark.table(run).filter(F.col("settled") == settled).select("hash", "documents")

    def merged(self, batch: DataFrame) -> DataFrame:
        """(hash, documents, settled): the batch without what is settled already. A hash is settled when batch and runs together have it often enough."""
        total = F.col("documents")
        for run in self.runs():
            batch = batch.join(self.known(run, True).select("hash").hint("merge"), "hash", "left_anti")
        for i, run in enumerate(self.runs()):
            batch = batch.join(self.known(run, False).withColumnRenamed("documents", f"d{i}").hint("merge"), "hash", "left")
            total = total + F.coalesce(f"d{i}", F.lit(0))
        return batch.select("hash", "documents", (total >= self.min_documents).alias("settled"))

    def add(self, batch: DataFrame) -> None:
        self.levels[0].append(self.write(self.merged(batch)))
        self.compact()

    def compact(self) -> None:
        """Merges the runs of a full level into one of the next. What is settled leaves the counts."""
        for n, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            counts = reduce(DataFrame.unionByName, (self.known(run, False) for run in level)).groupBy("hash").agg(F.sum("documents").alias("documents"))
            counts = counts.join(self.frequent(), "hash", "left_anti")
            settled = reduce(DataFrame.unionByName, (self.known(run, True) for run in level))
            whole = self.write(counts.withColumn("settled", F.lit(False)).unionByName(settled.withColumn("settled", F.lit(True))).repartition(self.buckets, "hash"))
            for run in level:
                self.drop(run)
            level.clear()
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n + 1].append(whole)

    def frequent(self) -> DataFrame:
        """Hashes found in at least min_documents documents."""
        return reduce(DataFrame.unionByName, (self.known(run, True).select("hash") for run in self.runs()))

    def close(self) -> None:
        for run in self.runs():
            self.drop(run)
        self.levels = [[]]


def who() -> Column:
    """Names a document by its id and text, in 128 bits; equal rows are named alike."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(who, hash): the distinct keys of each document of at least min_chars code points. The lines are hashed once, here."""
    hashes = F.array_distinct(F.filter(F.transform(lines(F.col("text")), lambda x: key_hash(x, min_chars)), lambda x: x.isNotNull()))
    return docs.select(who().alias("who"), F.explode(hashes).alias("hash"))


def frequent_keys(keys: DataFrame, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT) -> DataFrame:
    """keys: (who, hash, batch). Hashes in at least min_documents documents, written as a table; the batches are fed one by one."""
    runs = LineRuns(keys.sparkSession, min_documents, fanout)
    for n in sorted(r[0] for r in keys.select("batch").distinct().collect()):  # a row a batch
        runs.add(keys.filter(F.col("batch") == n).groupBy("hash").agg(F.count(F.lit(1)).alias("documents")))
    out = cut(runs.frequent() if runs.runs() else keys.select("hash").limit(0), "frequent")
    runs.close()
    return out


def without(frequent: set[bytes], min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops the lines of these keys."""
    white = WHITE.encode()

    def kept(line: bytes) -> bool:
        key = line.strip(white).lower()  # of bytes: A-Z only
        return not (key and (min_chars < 2 or len(key.decode()) >= min_chars) and hashlib.md5(key).digest() in frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, after = [], [], []
            for x in batch.column("text").cast(pa.large_binary()):
                own = (x.as_py() or b"").split(b"\n")
                left = list(filter(kept, own))
                texts.append(b"\n".join(left))
                before.append(len(own))
                after.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per document: doc_id, text without the lines of frequent keys, n_lines before, n_dropped. While there are at most broadcast_keys frequent keys they are broadcast and no text is shuffled; beyond that each document's own frequent keys are joined to it."""
    docs = docs.select("doc_id", "text")
    keys = cut(keys_of(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("who"), F.lit(batches)).cast("int")), "keys", ["batch"])
    frequent = frequent_keys(keys, min_documents, fanout)
    if (known := frequent.count()) <= broadcast_keys and min_chars > 0:
        discard(keys)
        arrow_limits(docs.sparkSession)
        held = docs.sparkSession.sparkContext.broadcast({bytes(r[0]) for r in frequent.collect()} if known else set())  # at most broadcast_keys
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long"
        return docs.mapInArrow(lambda parts: without(held.value, min_chars)(parts), schema)
    hit = keys.join(frequent, "hash", "left_semi").groupBy("who").agg(F.collect_set("hash").alias("drop"))
    both = docs.withColumn("who", who()).join(hit, "who", "left").withColumn("lines", lines(F.col("text")))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.coalesce(F.array_contains("drop", key_hash(x, min_chars)), F.lit(False)))
    )
    both = both.withColumn("kept", kept)
    return both.select(
        "doc_id", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT r, unnest(ls) line, unnest(range(1, len(ls) + 1)) p FROM d),
k AS (SELECT r, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) n_lines, CAST(count(f.key) AS BIGINT) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) kept_sha256
FROM k JOIN d USING (r) LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""
