"""Sources and sinks: numpy archives, shards by silo, JSON counters, reports, masks as packed bits."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """x and y (0/1) of an archive: a sparse pair (X_data, X_indices, X_indptr, X_shape, and the same for Y) or dense X with Y or y. Repeated entries of a sparse row are summed."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:

        def dense(name: str) -> np.ndarray:
            shape = tuple(int(v) for v in z[f"{name}_shape"])
            out = np.zeros(shape)
            rows = np.repeat(np.arange(shape[0]), np.diff(z[f"{name}_indptr"]))
            np.add.at(out, (rows, z[f"{name}_indices"]), z[f"{name}_data"])
            return out

        x = dense("X") if "X_data" in z else np.asarray(z["X"], float)
        y = dense("Y") if "Y_data" in z else np.asarray(z["Y" if "Y" in z else "y"])
    return x, (y > 0).astype(int)


def encoded(x: np.ndarray, y: np.ndarray) -> bytes:
    """The sparse archive of a dense pair."""

    def parts(name: str, a: np.ndarray) -> dict[str, np.ndarray]:
        r, c = np.nonzero(a)
        return {f"{name}_data": a[r, c], f"{name}_indices": c, f"{name}_indptr": np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(a)))]), f"{name}_shape": np.array(a.shape)}

    out = io.BytesIO()
    np.savez_compressed(out, **parts("X", np.asarray(x, np.float32)), **parts("Y", np.asarray(y, np.int8)))
    return out.getvalue()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, x, y) of every archive under a path of any file system; an archive is decoded by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                x, y = decoded(content.as_py())
                for a in range(0, len(x), 4096):
                    part = slice(a, a + 4096)
                    n = len(x[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * n), pa.array(np.arange(a, a + n)), pa.array(x[part].tolist(), pa.list_(pa.float64())), pa.array(y[part].tolist(), pa.list_(pa.int32()))], names=["path", "row", "x", "y"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, x array<double>, y array<int>")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a silo and split, so a reader of some silos opens only theirs."""
    rows.write.mode("overwrite").partitionBy("silo", "split").parquet(path)


def read_shards(spark: SparkSession, path: str, silos: list | None = None) -> DataFrame:
    t = spark.read.parquet(path)
    return t if silos is None else t.filter(F.col("silo").isin(silos))


def write_counters(counters: DataFrame, path: str) -> None:
    """One JSON object a silo: client_id, and tp, fp, fn as arrays in the order of the labels."""
    c = _by_label(counters)
    c.withColumnRenamed("silo", "client_id").write.mode("overwrite").json(path)


def _by_label(counters: DataFrame) -> DataFrame:
    sorted_ = counters.groupBy("silo").agg(F.array_sort(F.collect_list(F.struct("l", "tp", "fp", "fn"))).alias("c"))
    return sorted_.select("silo", F.col("c.tp").alias("tp"), F.col("c.fp").alias("fp"), F.col("c.fn").alias("fn"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(silo, l, tp, fp, fn) of JSON counters."""
    c = spark.read.schema("client_id int, tp array<long>, fp array<long>, fn array<long>").json(path)
    z = c.select(F.col("client_id").alias("silo"), F.posexplode(F.arrays_zip("tp", "fp", "fn")).alias("l", "z"))
    return z.select("silo", "l", "z.tp", "z.fp", "z.fn")


def append_history(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Generations, as JSON lines."""
    spark.createDataFrame([(r["gen"], float(r["hv"]), r["n_nd"], r["evals"], r["stagnant"]) for r in rows], "gen int, hv double, n_nd int, evals int, stagnant int").coalesce(1).write.mode("append").json(path)


def append_report(rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends to a CSV report the rows whose key it doesn't have yet; how many that were."""
    spark = rows.sparkSession
    try:
        done = spark.read.option("header", True).schema(rows.schema).csv(path).select(*key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").option("header", True).csv(path)
    rows.unpersist()
    return n


def packed(masks: DataFrame, n_features: int) -> DataFrame:
    """sel (array of features) to bytes (array of ints), most significant bit first."""
    size = -(-n_features // 8)
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s * 2 + F.array_contains("sel", b * 8 + k).cast("int"))
    return masks.withColumn("bytes", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), byte))


def unpacked(masks: DataFrame, n_features: int) -> DataFrame:
    """bytes back to sel."""
    from siloforge.functions.columns import packed_bit

    return masks.withColumn("sel", F.filter(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda j: packed_bit(F.col("bytes"), j) == 1))
