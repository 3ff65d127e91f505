"""Readers of stored files."""

import os

from pyspark.sql import functions as F

from labelq.session import open_files, scratch_path
from labelq.sources import readers, writers


def local(path):
    return path.removeprefix("file:")


def test_names_of_prediction_files_are_parsed_once_a_file(spark):
    """Names with characters that a path encodes find their runs; no row parses a path."""
    path = scratch_path(spark, "preds")
    names = {"a b": [1, 2], "x%20y": [None, 4], "p=q&r": [5]}
    for i, (name, values) in enumerate(names.items()):
        os.makedirs(folder := f"{local(path)}/sub {i}")
        with open(f"{folder}/{name}_mlp_uniform-0.1_aum_{i}_test_preds.csv", "w") as f:
            f.writelines('""\n' if v is None else f"{v}\n" for v in values)
    d = readers.predictions(spark, path)
    rows = d.groupBy("dataset", "base_model", "noise_type", "method", "seed").agg(F.count("*").alias("n"), F.sum("pred").alias("total"))
    got = {tuple(r) for r in rows.collect()}
    assert got == {("a b", "mlp", "uniform-0.1", "aum", "0", 2, 3), ("x%20y", "mlp", "uniform-0.1", "aum", "1", 2, 4), ("p=q&r", "mlp", "uniform-0.1", "aum", "2", 1, 5)}
    above = d._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert len(above) == 2 and "regexp_extract" not in above[0]


def test_open_files_puts_the_setting_back(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with open_files(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before


def test_one_file_per_row_is_read_by_few_tasks(spark, monkeypatch):
    """What the tasks write and read themselves is what Spark's own writer and reader make of the same rows."""
    texts = [" one\nline ", None, "", "tab\t", "\u00e9\u4e2d", "x" * 9000] * 20
    labels = ["en", None, "", "a b", "c/d%", "e=f", "\u00e9"]
    rows = [(labels[i % 7], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = lambda d: sorted((r["label"], r["text"]) for r in d.collect())
    path, other = scratch_path(spark, "dirs"), scratch_path(spark, "dirs")
    writers.labelled_dirs(df, path, "lang", "text")
    os.makedirs(f"{local(path)}/deep/er")
    for name in (".hidden", "_mark", "none.txt"):
        with open(f"{local(path)}/deep/er/{name}", "w") as f:
            f.write("" if name == "none.txt" else "not read")
    with open(f"{local(path)}/deep/er/50%.txt", "w") as f:
        f.write("read")
    d = readers.labelled_dirs(spark, path)
    mine = got(d)
    assert d.rdd.getNumPartitions() <= 16  # 121 files; four of Spark's open costs fill one of its tasks
    assert len(mine) == 121 and ("er", "read") in mine
    assert [r["file"] for r in d.filter("label = 'er'").collect()] == ["50%25.txt"]
    for module in (readers, writers):
        monkeypatch.setattr(module, "mounted", lambda *_: None)
    assert got(readers.labelled_dirs(spark, path)) == mine
    writers.labelled_dirs(df, other, "lang", "text")
    assert got(readers.labelled_dirs(spark, other)) == [r for r in mine if r[0] != "er"]
