"""Physical plans: what is read, what is pushed down, what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from labelq.catalog.registry import load
from labelq.functions import rand
from labelq.functions.ordering import flag_first, ranked
from labelq.operators import neighbours
from labelq.sources import writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key,columns", [
    ("metrics_all", 5), ("estimate_transition", 5), ("class_prior", 1), ("label_offset", 2), ("detection_metrics", 3)])
def test_only_needed_columns_are_read(spark, key, columns):
    text = plan(load()[0][key](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(s.count(":") <= columns for s in schemas), schemas


def test_no_cartesian_product_in_any_relational_query(spark):
    queries, _ = load()
    for key in ("noise_by_matrix", "noise_sweep", "transition_given_true", "standard_scale", "cl_thresholds", "results_table", "wilcoxon_pairs", "param_grid", "minmax_per_channel"):
        text = plan(queries[key](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key


def test_metric_rows_are_combined_before_the_shuffle(spark):
    text = plan(load()[0]["metrics_all"](spark, SF))
    assert "partial_count" in text


def test_exact_selection_moves_no_rows(spark, tmp_path):
    """Flagging the n smallest rows by hash leaves the wide table where it is."""
    spark.range(5000).withColumn("x", F.rand(1)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = plan(flag_first(df, F.lit(100), rand.hash32("a", "id"), F.col("id")))
    assert "Exchange" not in text and "Join" not in text


def test_ranking_shuffles_the_rows_once(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.range(5000).select("id", (F.col("id") % 3).alias("k"), F.rand(1).alias("x")).write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
        text = plan(ranked(df, ["k"], F.col("x"), F.col("id")))
        left, right = text.split("SortMergeJoin")[1].split("FileScan parquet")[:2]
        assert left.count("Exchange") == 1, text  # the rows
        assert right.count("Exchange") == 3, text  # bucket counts: combined, summed per key, joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_runs_are_pruned_by_folder(spark, tmp_path):
    rows = [("d0", "mlp", "uniform-0.1", "42", i, "aum", i % 2) for i in range(20)] + [("d1", "mlp", "uniform-0.4", "42", i, "aum", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset string, base_model string, noise_type string, seed string, id long, method string, label_issue int")
    writers.datacard(df, str(tmp_path / "cards"))
    back = writers.read_datacard(spark, str(tmp_path / "cards")).filter("noise_type = 'uniform-0.4'")
    assert back.count() == 20
    assert "PartitionFilters: [isnotnull(noise_type" in plan(back)


def test_filters_reach_the_scan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey < 10").select("o_custkey")
    assert "LessThan(o_orderkey,10)" in plan(o)


def test_copies_are_limited_before_the_shuffle(spark, tmp_path):
    """Of a hot set of identical vectors each task forwards only the few rows that can matter."""
    path = str(tmp_path / "v")
    spark.range(3000).select("id", F.lit(0).alias("label"), F.array(F.lit(1.0), F.lit(0.0)).alias("features")).repartition(4).write.parquet(path)
    limited = neighbours._limit_copies(neighbours.prepared(spark.read.parquet(path), "cosine", None), 5)
    text = plan(limited)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert sorted(r["id"] for r in limited.collect()) == [0, 1, 2, 3, 4]


def test_scratch_follows_the_session_setting(spark):
    from labelq.session import scratch_path

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    if base:
        assert a.startswith(base)
