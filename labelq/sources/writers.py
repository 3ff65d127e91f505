"""Sinks for run tables and metrics."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.session import mounted

RUN_KEYS = ("dataset", "base_model", "noise_type", "seed")


def datacard(df: DataFrame, path: str, keys: Sequence[str] = RUN_KEYS) -> None:
    """Long run table, one folder per run (or per ``keys``), so later reads prune on dataset, model, noise and seed.

    A run may hold most rows: the rebalance lets Spark split it into as many tasks and files as its
    measured size asks for, and gather small runs. A run that is written again replaces itself only.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_datacard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def labelled_dirs(df: DataFrame, path: str, label: str, text: str) -> None:
    """A new folder with one text file per row below ``<label>=<value>``, each ending with a newline.

    In a mounted folder a task writes its files itself, with no checksum file beside each and no process started for
    it. A file is put in place when it is complete, under a name that a repeated task gives it again.
    """
    folder = mounted(df.sparkSession, path)
    rows = df.select(F.col(label).cast("string").alias(label), F.col(text).alias("value"))
    if folder is None:
        rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").partitionBy(label).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = TaskContext.get(), 0, {}
        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value not in made:
                    made[value] = f"{folder}/{_escaped(label)}={_escaped(value) if value else NO_VALUE}"
                    os.makedirs(made[value], exist_ok=True)
                name = f"{task.partitionId():05d}-{n:08d}.txt"
                part = f"{made[value]}/.{name}.{task.taskAttemptId()}"
                with open(part, "wb") as f:
                    f.write((line or b"") + b"\n")
                os.replace(part, f"{made[value]}/{name}")
                n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    os.makedirs(folder)
    # Bytes, so that no text is changed by being decoded.
    rows.select(label, F.col("value").cast("binary").alias("value")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _escaped(name: str) -> str:
    """A folder name as Spark's own writer gives it."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", name)


def metrics_csv(train: DataFrame, test: DataFrame, path: str) -> None:
    """Train and test metrics in one CSV folder with a ``split`` column."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    both.write.mode("overwrite").csv(path, header=True)


def pending_runs(grid: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Runs of a grid whose output does not exist yet; all of them with ``force``."""
    return grid if force else grid.join(done.select(*grid.columns).distinct(), grid.columns, "left_anti")
