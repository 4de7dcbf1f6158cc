"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 2 << 20


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siloforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def arrow_limits(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session doesn't, or not as tightly, so that whole texts fit a Python worker. Nothing else of the session is changed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = (spark.conf.get(key, None) or "").rstrip("b")
    if known.lstrip("-").isdigit() and not 0 < int(known) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a local session takes a temporary folder; on a cluster that is an error, as executors don't see the driver's disk."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and {sc.master} needs a folder that its executors share")
        top = tempfile.mkdtemp(prefix="siloforge-")
        atexit.register(__import__("shutil").rmtree, top, True)
        sc.setCheckpointDir(top)
        return sc._jsc.sc().getCheckpointDir().get()
    return top


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/siloforge-{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; a lost executor costs no recomputation beyond it."""
    path = fresh_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siloforge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it."""
    if path := getattr(df, "_siloforge_path", None):
        remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
