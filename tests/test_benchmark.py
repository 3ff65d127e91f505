import pytest
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.operators.sampling import stratified_split
from labelq.plans import benchmark


def dataset(spark, tag, k=3, n=300, d=6):
    feats = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: rand.normal(tag, F.col("id"), i) * 0.3 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    df = spark.range(n).withColumn("label", (F.col("id") % k).cast("int")).withColumn("features", arrays.unit(feats))
    split = stratified_split(df, "label", 0.3)
    return split.filter("is_test = 0").drop("is_test"), split.filter("is_test = 1").drop("is_test")


def test_runs_are_stored_skipped_and_evaluated(spark, tmp_path):
    sets = {"one": dataset(spark, "one")}
    grid = [("uniform", 0.2), ("classdependent", None)]
    args = dict(n_classes={"one": 3}, out=str(tmp_path / "bench"))
    key = lambda noise, m: ("one", "softmax", noise, "42", m)
    assert benchmark.run(sets, grid[:1], ["cincer"], **args) == [key("uniform-0.2", "nocleaning"), key("uniform-0.2", "cincer")]
    assert benchmark.run(sets, grid, ["cincer"], **args) == [key("classdependent", "nocleaning"), key("classdependent", "cincer")]
    assert benchmark.run(sets, grid, ["cincer"], **args) == []
    before = sorted(spark.read.parquet(args["out"] + "/cards").filter("method = 'cincer'").collect())
    assert benchmark.run(sets, grid[:1], ["cincer", "cleanlab"], settings={"cleanlab": {"folds": 2}}, **args) == [key("uniform-0.2", "cleanlab")]
    cards = spark.read.parquet(args["out"] + "/cards")
    assert sorted(cards.filter("method = 'cincer'").collect()) == before
    both = cards.filter("noise_type = 'uniform-0.2'").groupBy("id").agg(F.count_distinct("noisy_label").alias("c"), F.count("*").alias("n"))
    assert both.filter("c <> 1 or n <> 2").count() == 0
    rows = cards.count()
    assert len(benchmark.run(sets, grid[:1], ["cincer"], force=True, **args)) == 2
    assert spark.read.parquet(args["out"] + "/cards").count() == rows
    labels = sets["one"][1].select(F.lit("one").alias("dataset"), "id", "label")
    r = {(x["noise_type"], x["method"]): x for x in benchmark.evaluate(spark, args["out"], labels).collect()}
    assert set(r) == {(n, m) for n in ("uniform-0.2", "classdependent") for m in ("cincer", "nocleaning")} | {("uniform-0.2", "cleanlab")}
    assert r["uniform-0.2", "cincer"]["cleaning_f1"] > 0.85
    assert all(x["downstream_f1"] > 0.8 for x in r.values())


def test_seeds_and_base_models_change_a_run(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    sets = {"one": dataset(spark, "one", n=150)}
    flat = lambda: LogisticRegression(family="multinomial", maxIter=1, regParam=50.0)
    args = dict(n_classes={"one": 3}, out=str(tmp_path / "bench"), base_models={"softmax": benchmark.learn.default_classifier, "flat": flat}, seeds=["1", "2"])
    done = benchmark.run(sets, [("uniform", 0.3)], ["cincer"], **args)
    assert len(done) == 8
    cards = spark.read.parquet(args["out"] + "/cards")
    labels = {(r.base_model, str(r.seed)): set() for r in cards.select("base_model", "seed").distinct().collect()}
    flags = {k: set() for k in labels}
    for r in cards.collect():
        labels[r.base_model, str(r.seed)].add((r.id, r.noisy_label))
        flags[r.base_model, str(r.seed)].add((r.id, r.label_issue))
    assert labels["softmax", "1"] == labels["flat", "1"] != labels["softmax", "2"]
    assert flags["softmax", "1"] != flags["flat", "1"]


def test_noise_by_name(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("label"), F.array(F.col("id") / 200, F.lit(1.0)).alias("features"),
                                 *[((F.col("id") + i) % 3).cast("int").alias(f"a{i}") for i in range(3)])
    ann = ["a0", "a1", "a2"]
    for kind in benchmark.NOISE_KINDS:
        out = benchmark.add_noise(df, kind, 3, 0.2, ann, df.select("label", F.col("label").alias("pred")), 2)
        assert out.filter("is_injected_noise <> cast(noisy_label <> label AS int)").count() == 0
        assert out.count() == 200
    with pytest.raises(ValueError):
        benchmark.add_noise(df, "salt", 3)
    with pytest.raises(ValueError):
        benchmark.add_noise(df, "dissenting_label", 3, 0.1)
