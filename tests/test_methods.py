"""Planted errors, planted parameters, and known values of the statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.operators import consensus, learn, metrics, noise, votes
from labelq.plans import experiments, ranking, results

K, D, N = 4, 8, 600


@pytest.fixture(scope="module")
def noisy(spark):
    feats = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: rand.normal("f", F.col("id"), i) * 0.3 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    d = spark.range(N).withColumn("label", (F.col("id") % K).cast("int")).withColumn("features", arrays.unit(feats))
    return noise.uniform(d, K, 0.2, "planted").cache()


@pytest.mark.parametrize("method,settings,least", [
    ("simifeat", {"min_similarity": 0.0, "method": "mv"}, 0.9), ("simifeat", {"min_similarity": 0.0, "steps": 300}, 0.75),
    ("cincer", {}, 0.9), ("cleanlab", {"folds": 3}, 0.85), ("aum", {"alpha": 0.3}, 0.6)])
def test_detectors_find_planted_noise(noisy, method, settings, least):
    data = noisy.select("id", "features", F.col("noisy_label").alias("label"))
    flags = experiments.find_label_issues(data, method, K, **settings)
    joined = noisy.join(flags, "id")
    assert joined.count() == N
    got = metrics.metrics(joined, "is_injected_noise", "label_issue").first()["weighted_f1"]
    assert got > least, got


def test_unknown_detector(noisy):
    with pytest.raises(ValueError):
        experiments.find_label_issues(noisy, "guess", K)


def test_training_dynamics_lower_the_loss(noisy):
    dyn, losses = learn.training_dynamics(noisy.select("id", "features", "label"), K, epochs=4)
    assert all(a > b for a, b in zip(losses, losses[1:]))
    assert dyn.count() == 4 * N and dyn.select("id", "epoch").distinct().count() == 4 * N


def test_out_of_fold_scores_cover_every_row_once(noisy):
    p = learn.oof_probs(noisy.select("id", "features", "label"), 3)
    assert p.count() == N and p.select("id").distinct().count() == N
    assert np.allclose([sum(r["probs"]) for r in p.select("probs").limit(50).collect()], 1)


def test_transition_is_recovered_from_consensus():
    t = np.array([[0.8, 0.15, 0.05], [0.1, 0.7, 0.2], [0.05, 0.05, 0.9]])
    p = np.array([0.5, 0.3, 0.2])
    p3 = np.einsum("i,ij,ik,il->jkl", p, t, t, t)
    got_t, got_p, loss, _ = consensus.solve_transition(p3, 2000)
    assert np.abs(got_t - t).max() < 0.05 and np.abs(got_p - p).max() < 0.05


def test_solver_gradient_lowers_loss_monotonically_enough():
    rng = np.random.default_rng(3)
    p3 = rng.dirichlet(np.ones(27)).reshape(3, 3, 3)
    losses = [consensus.solve_transition(p3, s)[2] for s in (5, 50, 400)]
    assert losses[0] >= losses[1] >= losses[2]


def test_vote_model_recovers_planted_issues(spark):
    d = spark.range(4000).withColumn("issue", (rand.uniform("i", "id") < 0.1).cast("int"))
    flags = []
    for j, (hit, false) in enumerate([(0.9, 0.05), (0.8, 0.1), (0.7, 0.1), (0.85, 0.2)]):
        d = d.withColumn(f"f{j}", (rand.uniform(f"g{j}", "id") < F.when(F.col("issue") == 1, hit).otherwise(false)).cast("int"))
        flags.append(f"f{j}")
    out = votes.vote_model(d, flags).withColumn("label_issue", (F.col("probability") > 0.5).cast("int"))
    assert metrics.metrics(out, "issue", "label_issue").first()["weighted_f1"] > 0.95
    top = votes.top_suspicious(votes.vote_model(d, flags), 5).collect()
    assert len(top) == 5 and all(r["f0"] + r["f1"] + r["f2"] + r["f3"] == 4 for r in top)


def test_tail_probabilities():
    assert abs(ranking.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(ranking.chi_square_tail(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(ranking.chi_square_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(ranking.chi_square_tail(11.070497693516351, 5) - 0.05) < 1e-9
    assert abs(ranking.normal_tail(1.959963984540054) - 0.025) < 1e-12
    # n = 5, statistic 0: two of 32 sign patterns
    assert ranking.signed_rank_exact(0, 5) == 2 / 32


def test_friedman_known_example(spark):
    values = {"a": [7.0, 9.9, 8.5, 5.1, 10.3], "b": [5.3, 5.7, 4.7, 3.5, 7.7], "c": [4.9, 7.6, 5.5, 2.8, 8.4]}
    rows = [(m, i, v) for m, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "method string, block int, v double")
    r = ranking.friedman(df, ["block"], "v").first()
    sums = [15, 7, 8]
    assert abs(r["statistic"] - (12 / (5 * 3 * 4) * sum(s * s for s in sums) - 3 * 5 * 4)) < 1e-6
    assert abs(r["p_value"] - np.exp(-r["statistic"] / 2)) < 1e-6


def test_holm_stops_at_first_failure(spark):
    df = spark.createDataFrame([("a", "b", 0.001), ("a", "c", 0.03), ("b", "c", 0.04)], "method_1 string, method_2 string, p_value double")
    got = {(r["method_1"], r["method_2"]): r["significant"] for r in ranking.holm(df).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
    groups = {r["methods"] for r in ranking.indistinct_groups(ranking.holm(df)).collect()}
    assert groups == {"a,c", "b,c"}


def test_param_grid_with_an_empty_side(spark):
    assert results.param_grid(spark, {}, {"alpha": [1, 2]}).count() == 2
    assert results.param_grid(spark, {"lr": [1, 2, 3]}, {"alpha": [1, 2]}).count() == 6
    assert results.param_grid(spark, {}, {}).count() == 1


def test_metrics_on_a_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    r = metrics.metrics(df, "t", "p").first()
    assert r["accuracy"] == 0.5 and abs(r["weighted_f1"] - round((2 * (2 / 3) + 1 * 0.5 + 0) / 4, 6)) < 1e-9


def test_datacard_reader_takes_names_from_the_path(spark, tmp_path):
    from labelq.sources import readers

    run = tmp_path / "results_2024-01-01_randomseed_42_mobilenet-v2"
    run.mkdir()
    head = "id,is_injected_noise,noisy_label," + ",".join(f"label_issues_{m},preds_cleaned_{m}" for m in ("aum", "cincer", "simifeat", "cleanlab")) + ",observed_labels"
    (run / "car_evaluation_uniform-0.1_label_issues.csv").write_text(head + "\n0,1,2,0,1,0,1,0,1,0,1,3\n")
    (run / "notes.csv").write_text("x\n")
    r = readers.datacards(spark, str(tmp_path)).collect()
    assert len(r) == 1
    assert (r[0]["dataset"], r[0]["base_model"], r[0]["noise_type"], r[0]["seed"], r[0]["stamp"]) == ("car_evaluation", "mobilenet-v2", "uniform-0.1", "42", "2024-01-01")


def test_codes_of_values_with_a_common_beginning(spark):
    from labelq.operators import prep

    names = [f"Customer#{i:09d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string")
    got = {r.value: r.code for r in prep.codes(df, "name").collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_comparison_per_slice_equals_each_slice_alone(spark):
    from labelq.functions import rand

    good = {"a": 0.3, "b": 0.0, "c": 0.28}
    rows = [(s, b, m, v if s == "clear" else 0.0) for s in ("clear", "none") for b in range(30) for m, v in good.items()]
    df = spark.createDataFrame(rows, "slice string, block int, method string, base double").withColumn("v", F.round(F.col("base") + rand.uniform("x", "slice", "block", "method") * 0.2, 3))
    got = ranking.compare(df, ["block"], "v", ["slice"])
    alone = {s: {(r.method_1, r.method_2): (round(r.p_value, 9), r.significant) for r in ranking.compare(df.filter(F.col("slice") == s), ["block"], "v").collect()} for s in ("clear", "none")}
    assert {s: {(r.method_1, r.method_2): (round(r.p_value, 9), r.significant) for r in got.filter(F.col("slice") == s).collect()} for s in alone} == alone
    assert alone["clear"]["a", "b"][1] == 1
    groups = {(r["slice"], r.methods) for r in ranking.indistinct_groups(got, ["slice"]).collect()}
    assert ("clear", "b") in groups and (("none", "a,b,c") in groups or any(x for _, x in alone["none"].values()))
