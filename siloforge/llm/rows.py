"""Mapping whole rows, whatever the columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its exact name, which may hold dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow() to rows of the same columns. run sees and gives batches with the columns' names; Spark sees numbered ones, as it can't map names that hold dots."""
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    numbered = df.toDF(*plain)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain)

    return numbered.mapInArrow(renamed, numbered.schema).toDF(*names)
