"""Evaluation rounds as streams: counters that arrive over time, closed by quorum or by a deadline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from siloforge.session import fresh_path, table


def events_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream of its files, in the order of their modification."""
    name = "events.parquet"
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    return read.parquet(f"{sf_dir}/{name[:-8]}*.parquet")


def drained(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into a Parquet table in the shared folder (exactly once, by batch number), and reads it. In update mode a key's last row counts."""
    spark = stream.sparkSession
    out, seen = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", seen).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    if mode == "complete":
        last = got.agg(F.max("batch")).first()[0]
        got = got.filter(F.col("batch") == last)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*(F.col(c) if c in keys else F.col(f"last.{c}") for c in stream.columns))
    return got.drop("batch")


def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, event_type, n, total): running counters of each day's round."""
    e = events_stream(spark, sf_dir)
    t = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drained(t, "complete", "daily")


def quorum_rounds(spark: SparkSession, sf_dir: str, share: float, files_per_batch: int | None = None) -> DataFrame:
    """(day, silos, n, total): each day's round closes with the reply that brings what has arrived to this share of the round's mass, and gives its row then; later replies are not counted.

    A round's mass is known beforehand (here, the day's events in the table, as silos announce their sizes). Replies count in the order of their batches, and inside a batch by (ts, event_id). Of an open round the state holds the count, the sum and the silos seen; of a closed one only that it is closed. A round that never reaches its quorum gives no row.
    """
    day = F.date_format("ts", "yyyy-MM-dd")
    mass = table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("mass"))
    e = events_stream(spark, sf_dir, files_per_batch).select(day.alias("day"), (F.col("user_id") % 5).cast("int").alias("silo"), "ts", "event_id", "value").join(F.broadcast(mass), "day")  # a row a round

    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, n, total, silos = state.get if state.exists else (False, 0, 0.0, [])
        if not closed:
            f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            missing = max(0, math.ceil(share * int(f["mass"].iloc[0])) - n)
            closed, f = len(f) >= missing, f.iloc[:missing]
            n, total = n + len(f), total + float(f["value"].sum())
            silos = sorted({*silos, *f["silo"].dropna().astype(int).tolist()})
            if closed:
                yield pd.DataFrame({"day": [key[0]], "silos": [len(silos)], "n": [n], "total": [round(total, 4)]})
                n, total, silos = 0, 0.0, []
        state.update((closed, n, total, silos))

    t = e.groupBy("day").applyInPandasWithState(close, "day string, silos int, n long, total double", "closed boolean, n long, total double, silos array<int>", "append", GroupStateTimeout.NoTimeout)
    return drained(t, "append", "quorum")


def deadline_windows(spark: SparkSession, sf_dir: str, length: str = "1 day", late: str = "2 hours", files_per_batch: int | None = None) -> DataFrame:
    """(start, silo, n): counts of each window; rows that come later than the watermark allows are dropped. Windows that the watermark has not passed when the input ends are closed by its end."""
    e = events_stream(spark, sf_dir, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    t = e.groupBy(F.window("ts", length).alias("w"), (F.col("user_id") % 5).cast("int").alias("silo")).agg(F.count(F.lit(1)).alias("n"))
    return drained(t.select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "silo", "n"), "update", "deadline", ["start", "silo"])
