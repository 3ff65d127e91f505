"""Readers for the file layouts of labelled data sets and of stored runs.

All schemas are explicit, so no file is read twice to infer types. Run metadata is parsed out of the
path with one expression per file, not per row value.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.session import materialised, mounted


# The folder and file naming of stored runs.
RUN_FOLDER = r"results_(.*)_randomseed_(.*)_([^_/]*)$"
DATACARD_FILE = r"^(.*)_([^_]*)_label_issues\.csv$"
PREDS_FILE = r"^(.*)_([^_]*)_([^_]*)_([^_]*)_([^_]*)_test_preds\.csv$"


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def csv_with_header(spark: SparkSession, path: str, schema: str, label: str, drop: Sequence[str] = ()) -> DataFrame:
    """Header CSV; ``label`` is renamed, unwanted columns are not read."""
    return spark.read.schema(schema).csv(path, header=True).drop(*drop).withColumnRenamed(label, "label")


def csv_named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless CSV with supplied names; no row is taken for a header."""
    return spark.read.schema(schema).csv(path, header=False)


def tsv_label_first(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Tab-separated series: a 1-based label, then the values of one channel."""
    names = [f"v{i}" for i in range(length)]
    schema = "raw double, " + ", ".join(f"{n} double" for n in names)
    df = spark.read.schema(schema).option("sep", "\t").csv(path)
    return df.select((F.col("raw").cast("int") - 1).alias("label"), F.array(F.array(*names)).alias("channels"))


def labelled_dirs(spark: SparkSession, path: str) -> DataFrame:
    """One text file per row; the label is the parent folder. Newlines are removed, ends trimmed.

    In a mounted folder the files are listed and read by tasks of many files each, however small the files are.
    """
    files = _listed(spark, path)
    if files is None:
        where = F.col("_metadata.file_path")
        raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.regexp_extract(where, r"/([^/]+)/[^/]+$", 1).alias("label"), F.regexp_extract(where, r"/([^/]+)$", 1).alias("file"), "value")
    else:
        raw = files.mapInArrow(_contents, "label string, file string, value binary").withColumn("value", F.col("value").cast("string"))
    return raw.select("label", "file", strip(F.regexp_replace("value", "\n", "")).alias("text"))


TASK_BYTES = 16 << 20  # of files that one task reads
TASK_FILES = 4096
BATCH_BYTES = 4 << 20  # of contents that leave a worker at once
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")


def _encoded(name: str) -> str:
    """A name as it stands in the paths that Spark reports."""
    return re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", name)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size) of what Spark would read in each folder; -1 for a folder."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            with os.scandir(folder) as found:
                rows = [(e.path, -1 if e.is_dir() else e.stat().st_size) for e in found
                        if e.name[0] != "." and (e.name[0] != "_" or "=" in e.name) and not e.name.endswith("._COPYING_")]
            for s in range(0, len(rows), 10_000):
                path, size = zip(*rows[s:s + 10_000])
                yield pa.record_batch({"path": pa.array(path, pa.string()), "size": pa.array(size, pa.int64())})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        parts = [p.rsplit("/", 2) for p, _ in held]
        return pa.record_batch({"label": pa.array([_encoded(x[-2]) for x in parts], pa.string()), "file": pa.array([_encoded(x[-1]) for x in parts], pa.string()),
                                "value": pa.array([v for _, v in held], pa.binary())})

    held, size = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                held.append((path, f.read()))
            size += len(held[-1][1])
            if size >= BATCH_BYTES:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    """The paths of all files below a mounted folder, dealt out; None where Spark has to read them itself.

    Each folder is listed by a task; the driver sees folders only. Empty files have no row.
    """
    top = mounted(spark, path)
    if top is None or not os.path.isdir(top):
        return None
    level, files = [top], None
    while level:
        folders = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 4 * spark.sparkContext.defaultParallelism))
        found = materialised(folders.mapInArrow(_entries, "path string, size long"), "listed")
        own = found.filter("size > 0")
        files = own if files is None else files.unionByName(own)
        level = [r["path"] for r in found.filter("size < 0").select("path").collect()]
    packed = F.lower("path").rlike("(" + "|".join(re.escape(x) for x in PACKED) + ")$").cast("int")
    n, size, odd = files.agg(F.count("*"), F.sum("size"), F.max(packed)).first()
    if odd:
        return None
    tasks = max(-(-(size or 0) // TASK_BYTES), -(-n // TASK_FILES), min(n, spark.sparkContext.defaultParallelism), 1)
    return files.select("path").repartition(tasks, "path")


def ts_text(spark: SparkSession, path: str) -> DataFrame:
    """``.ts`` lines: channels separated by ':', values by ',', the label last."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & ~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", ":")
    channels = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda c: F.split(c, ",").cast("array<double>"))
    return lines.select(channels.alias("channels"), F.trim(F.element_at(parts, -1)).alias("label"))


def arff_text(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: lines starting with '@' or '%' are declarations, the last field is the label."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & ~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split("value", ",")
    return lines.select(F.slice(parts, 1, F.size(parts) - 1).cast("array<double>").alias("features"), F.trim(F.element_at(parts, -1)).alias("label"))


DATACARD_SCHEMA = (
    "id long, is_injected_noise int, noisy_label int, "
    + ", ".join(f"label_issues_{m} int, preds_cleaned_{m} int" for m in ("aum", "cincer", "simifeat", "cleanlab"))
    + ", observed_labels int")


def with_run_names(raw: DataFrame, folder: str = r"/([^/]+)/[^/]+$", file: str = r"/([^/]+)$") -> DataFrame:
    """Add dataset, base_model, noise_type, seed and stamp, read from the folder and file part of the path."""
    where = F.url_decode(F.col("_metadata.file_path"))
    run, name = F.regexp_extract(where, folder, 1), F.regexp_extract(where, file, 1)
    return raw.select(
        F.regexp_extract(name, DATACARD_FILE, 1).alias("dataset"),
        F.regexp_extract(run, RUN_FOLDER, 3).alias("base_model"),
        F.regexp_extract(name, DATACARD_FILE, 2).alias("noise_type"),
        F.regexp_extract(run, RUN_FOLDER, 2).alias("seed"),
        F.regexp_extract(run, RUN_FOLDER, 1).alias("stamp"),
        *raw.columns)


def datacards(spark: SparkSession, path: str, schema: str = DATACARD_SCHEMA) -> DataFrame:
    """Wide run tables below ``results_<stamp>_randomseed_<seed>_<model>/<dataset>_<noise>_label_issues.csv``."""
    raw = (spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*_label_issues.csv")
           .csv(path, header=True))
    return with_run_names(raw)


def predictions(spark: SparkSession, path: str, file: str = r"/([^/]+)$", glob: str = "*_test_preds.csv") -> DataFrame:
    """Headerless one-column files ``<dataset>_<model>_<noise>_<method>_<seed>_test_preds.csv``.

    The names of the files found, which the driver has listed anyway, are parsed once each; a row only looks its file up.
    """
    raw = spark.read.schema("pred int").option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)
    fields = ("dataset", "base_model", "noise_type", "method", "seed")
    name = F.regexp_extract(F.url_decode("_where"), file, 1)
    # The listing writes a path without an authority as scheme:///path, the rows as scheme:/path.
    listed = {w for f in raw.inputFiles() for w in (f, re.sub(r"^([\w.+-]+):///", r"\1:/", f))}
    found = spark.createDataFrame([(w,) for w in sorted(listed)], "_where string")
    run = F.struct(*[F.regexp_extract(name, PREDS_FILE, i).alias(f) for i, f in enumerate(fields, 1)])
    d = raw.withColumn("_where", F.col("_metadata.file_path")).join(F.broadcast(found.select("_where", run.alias("_run"))), "_where", "left")
    known = F.coalesce("_run", F.raise_error(F.concat(F.lit("not among the listed files: "), "_where")).cast(dict(found.select(run.alias("r")).dtypes)["r"]))
    return d.withColumn("_run", known).select("_run.*", "pred")


def label_from_findings(studies: DataFrame, readings: DataFrame, keys: Sequence[str], finding: str, reading: str,
                        positive: str, unsure: Sequence[str], wanted: str) -> DataFrame:
    """Label 1 when the finding holds ``positive``; unsure findings are settled by a keyed lookup.

    ``readings`` is reduced to one row per key before the join, so a key with very many readings
    costs one counter, not a fan-out.
    """
    seen = readings.groupBy(*keys).agg(F.max((F.col(reading) == F.lit(wanted)).cast("int")).alias("_seen"))
    text = F.lower(F.col(finding))
    doubt = F.lit(False)
    for word in unsure:
        doubt = doubt | F.contains(text, F.lit(word))
    label = F.when(F.contains(text, F.lit(positive)), 1).when(doubt, F.coalesce("_seen", F.lit(0))).otherwise(0)
    return studies.join(seen, list(keys), "left").withColumn("label", label.cast("int")).drop("_seen")


