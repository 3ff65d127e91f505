"""Queries that fit models; they have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelq.catalog.base import KE, lab_structured, noisy_structured, query
from labelq.operators import learn, noise
from labelq.operators.sampling import stratified_split
from labelq.plans import experiments
from labelq.session import materialised


def probs_out(df):
    return df.select("id", "label", "pred", F.round(F.array_max("probs"), 6).alias("confidence"))


@query("fit_classifier")
def _(spark, sf):
    d = lab_structured(spark, sf)
    return probs_out(learn.predict(learn.fit(d, weighted=True), d))


@query("training_dynamics")
def _(spark, sf):
    dyn, _ = learn.training_dynamics(lab_structured(spark, sf), KE, epochs=4)
    return dyn.select("id", "epoch", "target", F.round(F.array_max("logits"), 6).alias("top"))


@query("oof_probs")
def _(spark, sf):
    return probs_out(learn.oof_probs(noisy_structured(spark, sf).select("id", "features", "label"), 3))


@query("two_fold_detect")
def _(spark, sf):
    return experiments.by_margin(noisy_structured(spark, sf).select("id", "features", "label"), KE, "margin", 0.25)


@query("confident_detect")
def _(spark, sf):
    return experiments.find_label_issues(noisy_structured(spark, sf).select("id", "features", "label"), "cleanlab", KE, folds=3)


@query("dynamics_detect")
def _(spark, sf):
    return experiments.find_label_issues(noisy_structured(spark, sf).select("id", "features", "label"), "aum", KE, alpha=0.05)


@query("simifeat_halves")
def _(spark, sf):
    d = noisy_structured(spark, sf).select("id", "features", "label")
    return experiments.find_label_issues(d, "simifeat", KE, min_similarity=0.0, features_from=learn.hidden_from)


@query("hidden_features")
def _(spark, sf):
    d = noisy_structured(spark, sf).select("id", "features", "label")
    halves = experiments.half_features(d, KE, learn.hidden_from)
    both = halves["A"].withColumn("half", F.lit("A")).unionByName(halves["B"].withColumn("half", F.lit("B")))
    return both.select("id", "half", F.size("features").alias("width"), F.round(F.array_max("features"), 6).alias("top"))


def _sides(spark, sf):
    d = materialised(stratified_split(lab_structured(spark, sf), "label", 0.25), "sides")
    cols = ("id", "features", "label")
    return d.filter("is_test = 0").select(*cols), d.filter("is_test = 1").select(*cols)


@query("experiment_baseline")
def _(spark, sf):
    train, test = _sides(spark, sf)
    return experiments.baseline(train, test)


@query("experiment_detect")
def _(spark, sf):
    train, test = _sides(spark, sf)
    noisy = noise.uniform(train, KE, 0.2, "experiment")
    return experiments.detect_and_refit(noisy, test, ["cincer", "simifeat"], KE, {"simifeat": {"min_similarity": 0.0}})
