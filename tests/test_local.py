"""Local transitions, halves with learned features, and maximal groups against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.operators import consensus, learn, metrics, noise
from labelq.operators.sampling import half_split
from labelq.plans import experiments, ranking


def test_groups_of_thirty_methods_match_brute_force(spark):
    rng = random.Random(1)
    names = [f"m{i:02d}" for i in range(30)]
    alike = {frozenset(p) for p in itertools.combinations(names, 2) if rng.random() < 0.55}
    alike |= {frozenset(p) for p in itertools.combinations(names[:9], 2)}
    rows = [("a", x, y, int(frozenset((x, y)) not in alike)) for x, y in itertools.combinations(names, 2)] + [("b", "m1", "m2", 1), ("c", "m1", "m2", 0)]
    pairs = spark.createDataFrame(rows, "slice string, method_1 string, method_2 string, significant int")
    found = ranking.indistinct_groups(pairs, ["slice"]).collect()
    got = {frozenset(r.methods.split(",")) for r in found if r["slice"] == "a"}
    near = {n: {m for m in names if frozenset((n, m)) in alike} for n in names}
    want, level = set(), {frozenset([n]) for n in names}
    while level:  # all sets, size by size; a set is maximal if nothing joins it
        grown = set()
        for c in level:
            more = set.intersection(*(near[m] for m in c)) - c
            want |= set() if more else {c}
            grown |= {c | {m} for m in more}
        level = grown
    assert got == want and len(found) == len(want) + 3
    assert {(r["slice"], r.methods, r["size"]) for r in found if r["slice"] != "a"} == {("b", "m1", 1), ("b", "m2", 1), ("c", "m1,m2", 2)}
    assert ranking.indistinct_groups(pairs.limit(0), ["slice"]).count() == 0


@pytest.fixture(scope="module")
def regions(spark):
    """Two far regions of three classes with other transitions each; neighbours share the true class."""
    t = {0: [[0.8, 0.15, 0.05], [0.1, 0.85, 0.05], [0.05, 0.05, 0.9]], 1: [[0.65, 0.25, 0.1], [0.05, 0.9, 0.05], [0.1, 0.15, 0.75]]}
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6000):
        region, label = i % 2, int(rng.integers(3))
        x = np.zeros(8)
        x[label], x[4 + region] = 1.0, 2.0
        rows.append((i, (x + rng.normal(size=8) * 0.08).tolist(), int(rng.choice(3, p=t[region][label])), region, label))
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, region int, truth int")
    return df.repartition(8, "id"), t


def test_local_transitions_are_recovered(regions):
    df, t = regions
    cells = df.select(F.col("region").cast("long").alias("cell"), "id")
    got = consensus.local_transitions(df.select("id", "features", "label"), 3, cells=cells).collect()
    assert len(got) == 18
    for r in got:
        assert abs(r.local - t[r.cell][r.label][r.noisy_label]) < 0.05, r
        assert 0.25 < r.share < 0.42
    for cell in (0, 1):
        mixed = np.array([[next(r.prob for r in got if (r.cell, r.label, r.noisy_label) == (cell, i, j)) for j in range(3)] for i in range(3)])
        assert np.allclose(mixed.sum(1), 1)


def test_cover_holds_every_row_in_small_cells(regions):
    df, _ = regions
    some = df.where("id < 900").select("id", "features")
    cells = consensus.cover(some, 60)
    assert cells.select("id").distinct().count() == 900 and cells.count() == cells.distinct().count()
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert max(sizes) <= 60 and len(sizes) < 200


def test_halves_are_searched_in_features_of_the_other_half(spark):
    feats = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: rand.normal("f", F.col("id"), i) * 0.3 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    d = noise.uniform(spark.range(600).withColumn("label", (F.col("id") % 4).cast("int")).withColumn("features", arrays.unit(feats)), 4, 0.2, "planted").cache()
    data = d.select("id", "features", F.col("noisy_label").alias("label"))
    model, losses = learn.fit_hidden(data, 4, steps=25)
    assert losses[-1] < 0.8 * losses[0]
    seen = []

    def spy(train, n_classes):
        ids = {r.id for r in train.select("id").collect()}
        made = learn.hidden_from(train, n_classes)

        def apply(rows):
            seen.append((ids, {r.id for r in rows.select("id").collect()}))
            return made(rows)
        return apply

    flags = experiments.find_label_issues(data, "simifeat", 4, min_similarity=0.0, method="mv", features_from=spy)
    assert len(seen) == 2 and all(not a & b and len(a | b) == 600 for a, b in seen)
    joined = d.join(flags, "id")
    assert joined.count() == 600
    assert metrics.metrics(joined, "is_injected_noise", "label_issue").first()["weighted_f1"] > 0.85
    constant = experiments.find_label_issues(data, "simifeat", 4, min_similarity=0.0, method="mv", features_from=lambda t, n: lambda rows: rows.withColumn("features", F.array(F.lit(1.0), F.lit(0.0))))
    assert constant.join(flags.withColumnRenamed("label_issue", "other"), "id").where("label_issue <> other").count() > 100
    halves = experiments.half_features(data, 4, lambda t, n: lambda rows: rows)
    assert {r.id for r in halves["A"].collect()} == {r.id for r in half_split(data, "half").where("half = 'A'").collect()}
