"""Registry of the corpus queries and what their tasks share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of text handed to a Python worker at once; it bounds a worker's memory when texts are long.
BATCH_ROWS = 500


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one row can hold a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column one by one; null is the empty text."""
    for x in column:
        yield x.as_py() or ""


#: A table is broadcast by hint only after it was counted and has no more rows than this.
SMALL_ROWS = 100_000


def small_join(rows: DataFrame, table_: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a stored table of counts: broadcast if it was counted to be small, else left to Spark."""
    small = table_.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(table_) if small else table_, keys, how)
