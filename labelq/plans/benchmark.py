"""The benchmark run: corrupt, detect, clean, refit, store; then evaluate what is stored.

The grid of runs is looped over on the driver, one Spark program per run; everything inside a run is
distributed. A method whose rows are stored already for a run is skipped. The seed goes into every draw of a
run, and the base model fits every classifier of it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.operators import annotators as ann
from labelq.operators import learn, noise
from labelq.operators.prep import clean
from labelq.plans import results
from labelq.plans.experiments import find_label_issues, seeded
from labelq.session import materialised
from labelq.sources import writers

# Names of the label noise kinds.
NOISE_KINDS = ("uniform", "asymmetric", "classdependent", "instancedependent", "dissenting_label", "dissenting_worker", "crowd_majority")


def add_noise(df: DataFrame, kind: str, n_classes: int, rate: float = 0.0, annotators: Sequence[str] | None = None,
              preds: DataFrame | None = None, n_features: int | None = None, seed: str | None = None) -> DataFrame:
    """Corrupt the labels of (id, features, label) by a kind's name.

    The annotator kinds need the annotator columns, the class-dependent kind predictions
    (label, pred), the instance-dependent kind the number of features.
    """
    if kind == "uniform":
        return noise.uniform(df, n_classes, rate, seeded("uniform", seed))
    if kind == "asymmetric":
        return noise.asymmetric(df, n_classes, rate, seeded("asymmetric", seed))
    if kind == "classdependent":
        if preds is None:
            raise ValueError("class-dependent noise needs the predictions of a model")
        return noise.class_dependent(df, preds, n_classes, tag=seeded("classdependent", seed))
    if kind == "instancedependent":
        if n_features is None:
            raise ValueError("instance-dependent noise needs the number of features")
        return noise.instance_dependent(df, n_features, n_classes, rate, seeded("instance", seed))
    if kind in ("dissenting_label", "dissenting_worker", "crowd_majority"):
        if not annotators:
            raise ValueError(f"{kind} noise needs annotator columns")
        if kind == "crowd_majority":
            return ann.crowd_majority(df, annotators)
        return getattr(ann, kind)(df, annotators, rate, seeded(kind, seed))
    raise ValueError(f"unknown noise {kind!r}, known: {NOISE_KINDS}")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What is stored at a path, or None if nothing has been written there; any other fault is raised."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


RUN_METHOD = (*results.RUN, "method")


def run(datasets: Mapping[str, tuple[DataFrame, DataFrame]], kinds: Sequence[tuple[str, float | None]], methods: Sequence[str],
        n_classes: Mapping[str, int], out: str, base_models: Mapping[str, Callable] | None = None, seeds: Sequence[str] = ("42",),
        settings: Mapping[str, dict] | None = None, force: bool = False) -> list[tuple[str, ...]]:
    """Do every (dataset, base model, noise, seed, method) of the grid that is not stored; returns those done now.

    ``base_models`` maps names to functions that make a classifier. ``out/cards`` receives the run tables in long
    form, ``out/preds`` the test predictions, one folder per run and method. Class-dependent noise fits the base
    model on the clean table first. Draws are keyed, so a method added later meets the same noisy labels.
    """
    models = dict(base_models or {"softmax": learn.default_classifier})
    wanted = ["nocleaning", *methods]
    done_now = []
    for name, (train, test) in datasets.items():
        spark, k = train.sparkSession, n_classes[name]
        grid = spark.createDataFrame(
            [(name, model, kind if rate is None else f"{kind}-{rate}", str(seed), m, kind, rate) for model in models for kind, rate in kinds for seed in seeds for m in wanted],
            "dataset string, base_model string, noise_type string, seed string, method string, kind string, rate double")
        old = None if force else stored(spark, f"{out}/preds")
        if old is not None:
            seen = old.select(*[F.col(c).cast("string").alias(c) for c in RUN_METHOD]).distinct()
            grid = grid.join(seen, [*RUN_METHOD], "left_anti")
        left: dict[tuple, list[str]] = {}
        for r in grid.collect():
            left.setdefault((*[r[c] for c in results.RUN], r["kind"], r["rate"]), []).append(r["method"])
        for key, todo in sorted(left.items(), key=str):
            _one(train, test, key, [m for m in wanted if m in todo], k, out, models[key[1]], settings or {})
            done_now += [(*key[:4], m) for m in wanted if m in todo]
    return done_now


def _one(train: DataFrame, test: DataFrame, key: tuple, methods: Sequence[str], k: int, out: str, make: Callable, settings: Mapping[str, dict]) -> None:
    *run_key, kind, rate = key
    seed = run_key[3]
    preds = learn.predict(learn.fit(train, make=make), train).select("label", "pred") if kind == "classdependent" else None
    width = len(train.select("features").first()[0]) if kind == "instancedependent" else None
    noisy = materialised(add_noise(train, kind, k, rate or 0.0, preds=preds, n_features=width, seed=seed).select(
        "id", "features", F.col("label").alias("observed_label"), "noisy_label", "is_injected_noise"), "noisy")
    data = noisy.select("id", "features", F.col("noisy_label").alias("label"))
    for m in methods:
        where = [F.lit(v).alias(c) for c, v in zip(RUN_METHOD, (*run_key, m), strict=True)]
        if m == "nocleaning":
            kept = data
        else:
            flags = materialised(find_label_issues(data, m, k, **{"make": make, "seed": seed, **settings.get(m, {})}), "flags")
            kept = clean(data, flags)
        model = learn.fit(kept, make=make)
        if m != "nocleaning":
            after = learn.predict(model, data).select("id", F.col("pred").alias("pred_cleaned"))
            # A row that a detector gave no flag stays in the table, unflagged.
            card = noisy.drop("features").join(flags, "id", "left").na.fill(0, ["label_issue"]).join(after, "id")
            writers.datacard(card.select(*where, "id", "observed_label", "noisy_label", "is_injected_noise", "label_issue", "pred_cleaned"), f"{out}/cards", RUN_METHOD)
        # Predictions last: a method counts as done once they exist.
        scored = learn.predict(model, test.select("id", "features", "label"))
        writers.datacard(scored.select(*where, "id", "pred"), f"{out}/preds", RUN_METHOD)


def evaluate(spark: SparkSession, out: str, test_labels: DataFrame, missing: float | None = None) -> DataFrame:
    """(dataset, base_model, noise_type, seed, method, cleaning_f1, downstream_f1) of everything stored.

    ``test_labels`` is (dataset, id, label).
    """
    as_text = lambda d: d.select(*[F.col(c).cast("string").alias(c) if c in results.RUN else F.col(c) for c in d.columns])
    cards, preds = as_text(spark.read.parquet(f"{out}/cards")), as_text(spark.read.parquet(f"{out}/preds"))
    return results.results_table(results.detection_metrics(cards), results.downstream_metrics(preds, test_labels), missing)
