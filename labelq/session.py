"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "labelq", cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", str(cpus))
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (a test) is a fresh local folder used.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="labelq-"))
        base = sc.getCheckpointDir()
    # One folder per application, so that everything an application wrote can be deleted together.
    return f"{base.rstrip('/')}/labelq-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder; call it when its results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x").rsplit("/", 1)[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The local name of a ``file:`` path, a folder that the driver and all executors have mounted; None for other stores."""
    sc = spark.sparkContext
    if re.search(r"[*?\[{]", path):  # Hadoop would expand it
        return None
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return at.getPath() if at.getScheme() == "file" else None


@contextlib.contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, a write by partitions keeps up to ``most`` files of a task open; beyond that Spark sorts its rows first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Narrow rows that one file of an intermediate of known size holds at least.
FILE_ROWS = 100_000


def materialised(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write an intermediate that is read several times to the shared folder; it outlives lost executors.

    ``rows`` is the number of narrow rows it has at most, where that is known: it is then written by as many tasks as
    these rows need, though by one for each core at least, and not in a small file for each shuffle partition.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
