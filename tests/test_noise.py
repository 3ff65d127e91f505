"""Rates within 0.01 and transition entries within 0.05 at N = 10000; features unchanged; exact counts where promised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.operators import annotators, noise, sampling

N, K, D = 10000, 10, 12


@pytest.fixture(scope="module")
def df(spark):
    feats = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: rand.normal("f", F.col("id"), i))
    d = spark.range(N).select("id", F.floor(rand.uniform("y", "id") * K).cast("int").alias("label"), feats.alias("features"))
    for a in (1, 2, 3):
        d = d.withColumn(f"a{a}", F.when(rand.uniform(f"w{a}", "id") < 0.5, F.floor(rand.uniform(f"v{a}", "id") * K)).otherwise(F.col("label")).cast("int"))
    return d.cache()


def realised(d):
    p = d.select("label", "noisy_label", "is_injected_noise").toPandas()
    assert ((p.label != p.noisy_label).astype(int) == p.is_injected_noise).all()
    t = np.zeros((K, K))
    np.add.at(t, (p.label.to_numpy(), p.noisy_label.to_numpy()), 1)
    return p.is_injected_noise.mean(), t / t.sum(1, keepdims=True)


@pytest.mark.parametrize("p", [0.1, 0.4])
def test_uniform(df, p):
    rate, t = realised(noise.uniform(df, K, p))
    want = np.full((K, K), p / (K - 1)) + np.eye(K) * (1 - p - p / (K - 1))
    assert abs(rate - p) < 0.01 and np.abs(t - want).max() < 0.05


@pytest.mark.parametrize("p", [0.0, 0.1, 0.4, 1.0])
def test_asymmetric_is_exact(df, p):
    d = noise.asymmetric(df, K, p)
    rate, t = realised(d)
    assert round(rate * N) == int(p * N)
    assert d.filter("noisy_label <> label AND noisy_label <> (label + 1) % 10").count() == 0


def test_by_matrix(spark, df):
    rng = np.random.default_rng(0)
    m = rng.dirichlet(np.ones(K), K)
    table = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(K) for j in range(K)], "from_label int, to_label int, prob double")
    _, t = realised(noise.flip_by_matrix(df, table))
    assert np.abs(t - m).max() < 0.06
    bad = table.withColumn("prob", F.col("prob") * 2)
    with pytest.raises(ValueError):
        noise.flip_by_matrix(df, bad)


def test_instance_dependent(df):
    p = 0.2
    d = noise.instance_dependent(df, D, K, p)
    rate, _ = realised(d)
    assert p < rate < p + 0.1  # the flip rate is drawn from [p, p+0.1]
    s = noise.instance_scores(df, D, K, p).select("label", "q", "flip_probs").toPandas()
    fp = np.stack(s["flip_probs"])
    assert np.allclose(fp.sum(1), 1) and np.allclose(fp[np.arange(N), s.label], 1 - s.q)
    assert s.q.between(p, p + 0.1).all()


def test_class_dependent_follows_confusions(df):
    preds = df.withColumn("pred", F.when(rand.uniform("cd", "id") < 0.3, (F.col("label") + 2) % K).otherwise(F.col("label")).cast("int"))
    _, t = realised(noise.class_dependent(df, preds, K))
    table = noise.class_dependent_matrix(preds, K).toPandas().pivot(index="from_label", columns="to_label", values="prob").to_numpy()
    assert np.abs(table - (np.eye(K) * 0.7 + np.roll(np.eye(K), 2, axis=1) * 0.3)).max() < 0.05
    assert np.allclose(table.sum(1), 1) and np.abs(t - table).max() < 0.05


@pytest.mark.parametrize("p", [0.0, 0.1, 0.3])
def test_dissent_meets_the_rate_with_annotator_labels(df, p):
    for fn in (annotators.dissenting_label, annotators.dissenting_worker):
        d = fn(df, ["a1", "a2", "a3"], p)
        rate, _ = realised(d)
        assert round(rate * N) == int(np.ceil(p * N))
        assert d.filter("is_injected_noise = 1 AND noisy_label NOT IN (a1, a2, a3)").count() == 0


def test_dissenting_worker_equals_the_sequential_rule(spark):
    """Workers one after the other, rows in each worker's own order, until the share is reached."""
    rows = [(i, i % 3, (i * 7) % 3, (i * 5 + 1) % 3, (i * i) % 3) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, label int, a1 int, a2 int, a3 int")
    h = d.select("id", *[rand.hash32("dissenting_worker", F.lit(w), "id").alias(f"h{w}") for w in (1, 2, 3)]).toPandas().set_index("id")
    hw = spark.range(1).select(*[rand.hash32("dissenting_worker/worker", F.lit(w)).alias(str(w)) for w in (1, 2, 3)]).first().asDict()
    label, noisy = {r[0]: r[1] for r in rows}, {r[0]: r[1] for r in rows}
    errors, p = 0, 0.4
    for w in sorted((1, 2, 3), key=lambda w: hw[str(w)]):
        for i in sorted(label, key=lambda i: (h.loc[i, f"h{w}"], i)):
            if rows[i][1 + w] != label[i] and noisy[i] == label[i] and errors / 60 < p:
                noisy[i] = rows[i][1 + w]
                errors += 1
    got = {r["id"]: r["noisy_label"] for r in annotators.dissenting_worker(d, ["a1", "a2", "a3"], p).collect()}
    assert got == noisy


def test_features_move_and_labels_stay(df):
    d = noise.gaussian_features(df, 0.0, 0.01)
    x = d.select("features", "noisy_features", "label").limit(500).toPandas()
    diff = np.stack(x.noisy_features) - np.stack(x.features)
    assert abs(diff.std() - 0.01) < 0.001 and abs(diff.mean()) < 0.001


def test_splits_have_exact_sizes(df):
    s = sampling.stratified_split(df, "label", 0.15).groupBy("label").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).toPandas()
    assert (s.t == np.floor(s.n * 0.15 + 0.5)).all()
    folds = sampling.kfold(df, "label", 5).groupBy("label", "fold").count().toPandas().pivot(index="label", columns="fold", values="count")
    assert (folds.max(axis=1) - folds.min(axis=1)).max() <= 1
    assert sampling.half_split(df).filter("half = 'A'").count() == N // 2
    rounds = sampling.sample_rounds(df, 300, 3).toPandas()
    assert (rounds.groupby("round").id.nunique() == 300).all()
