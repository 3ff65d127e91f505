"""Detectors by name, and the corrupt-detect-clean-refit experiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.operators import aum, confident, consensus, learn, margin, neighbours
from labelq.operators.metrics import metrics
from labelq.operators.prep import clean
from labelq.operators.sampling import half_split
from labelq.session import materialised

# Default settings of the detectors.
DEFAULTS = {
    "aum": {"alpha": 0.01},
    "cincer": {"inspector": "margin", "threshold": 0.25},
    "simifeat": {"k": 10, "rounds": 10, "sample": None, "steps": 1000, "min_similarity": 0.45, "offset": 2.5, "method": "both"},
    "cleanlab": {"folds": 5},
}


def seeded(tag: str, seed: str | None) -> str:
    """The tag of a draw under a seed; without one the tag itself."""
    return tag if seed is None else f"{tag}/{seed}"


def by_dynamics(df: DataFrame, n_classes: int, alpha: float, epochs: int = 8, make: Callable | None = None, seed: str | None = None) -> DataFrame:
    """Two passes with an extra class; a row is flagged below the alpha quantile of the extra class.

    The dynamics come from its own softmax descent, whatever model ``make`` gives to other steps.
    """
    placed = materialised(aum.threshold_class(df, n_classes, seeded("aum", seed)), "threshold")
    scored = []
    for n in (1, 2):
        data = placed.select("id", "features", F.col(f"label_{n}").alias("label"))
        dyn, _ = learn.training_dynamics(data, n_classes + 1, epochs)
        is_thr = F.col("in_first") if n == 1 else 1 - F.col("in_first")
        scores = aum.aum_score(dyn).join(placed.select("id", is_thr.alias("is_threshold")), "id")
        scored.append(materialised(scores, f"pass{n}"))
    return aum.flags(df, aum.aum_issues(*scored, alpha))


def by_margin(df: DataFrame, n_classes: int, inspector: str, threshold: float, make: Callable = learn.default_classifier, seed: str | None = None) -> DataFrame:
    """Two halves, each inspected with the model of the other."""
    flagged = margin.inspect(learn.cross_halves(df, make=make, tag=seeded("half", seed)), inspector, threshold)
    return flagged.select("id", F.col("suspicious").alias("label_issue"))


def half_features(df: DataFrame, n_classes: int, features_from: Callable, tag: str = "half") -> dict[str, DataFrame]:
    """The halves of (id, features, label), each with the features of a model fitted on the other half."""
    placed = materialised(half_split(df.select("id", "features", "label"), tag), "halves")
    part = {h: placed.filter(F.col("half") == h).drop("half") for h in ("A", "B")}
    return {h: materialised(features_from(part[o], n_classes)(part[h]), f"half{h}") for h, o in (("A", "B"), ("B", "A"))}


def by_neighbours(df: DataFrame, n_classes: int, k: int, rounds: int, sample: int | None, steps: int, min_similarity: float, offset: float, method: str,
                  features_from: Callable | None = None, make: Callable | None = None, seed: str | None = None) -> DataFrame:
    """Neighbour vote and class-wise rank.

    Without ``features_from`` the given features are searched in one pass. With it (``learn.hidden_from`` or another
    callable of a training table and the number of classes that returns a function from rows to rows with other
    features) there are two passes: each half is searched within itself, in features of a model that was fitted on
    the other half. ``make`` is not used.
    """
    parts = {"": df} if features_from is None else half_features(df, n_classes, features_from, seeded("half", seed))
    out = None
    for name, rows in parts.items():
        found = neighbours.knn(rows, rows, k - 1)
        flags = consensus.detect(rows, found, n_classes, rounds, sample, steps, min_similarity, offset, method, seeded("consensus" + name, seed))
        out = flags if out is None else out.unionByName(flags)
    return out


def by_confidence(df: DataFrame, n_classes: int, folds: int, make: Callable = learn.default_classifier, seed: str | None = None) -> DataFrame:
    """Confident learning on out-of-fold probabilities."""
    probs = materialised(learn.oof_probs(df, folds, make=make, tag=seeded("fold", seed)).select("id", "label", "probs"), "probs")
    return confident.issues(probs, n_classes)


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "aum": by_dynamics, "cincer": by_margin, "simifeat": by_neighbours, "cleanlab": by_confidence,
}


def find_label_issues(df: DataFrame, detector: str, n_classes: int, **settings) -> DataFrame:
    """(id, label_issue) of (id, features, label) by a detector's name."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}, known: {sorted(DETECTORS)}")
    return DETECTORS[detector](df, n_classes, **{**DEFAULTS[detector], **settings})


def baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """(split, metrics..) of the model without any cleaning."""
    model = learn.fit(train)
    both = learn.predict(model, train.select("id", "features", "label").withColumn("split", F.lit("train"))).unionByName(
        learn.predict(model, test.select("id", "features", "label").withColumn("split", F.lit("test"))))
    return metrics(both, "label", "pred", ["split"])


def detect_and_refit(noisy: DataFrame, test: DataFrame, methods: list[str], n_classes: int, settings: dict | None = None) -> DataFrame:
    """Per method: detection metrics, rows left, and the refitted model's test F1.

    ``noisy`` is (id, features, label, noisy_label, is_injected_noise); detectors see the noisy label.
    """
    seen = materialised(noisy.select("id", "features", F.col("noisy_label").alias("label"), "is_injected_noise"), "noisy")
    data = seen.select("id", "features", "label")
    out = None
    for m in ["nocleaning", *methods]:
        if m == "nocleaning":
            flags = data.select("id", F.lit(0).alias("label_issue"))
        else:
            flags = materialised(find_label_issues(data, m, n_classes, **(settings or {}).get(m, {})), "flags")
        kept = clean(data, flags)
        model = learn.fit(kept)
        found = metrics(seen.join(flags, "id"), "is_injected_noise", "label_issue").select(F.col("weighted_f1").alias("cleaning_f1"))
        down = metrics(learn.predict(model, test.select("id", "features", "label")), "label", "pred").select(F.col("weighted_f1").alias("downstream_f1"))
        row = seen.join(flags, "id").agg(F.count("*").alias("n"), F.sum("label_issue").alias("flagged"), F.sum("is_injected_noise").alias("injected"))
        row = row.select(F.lit(m).alias("method"), "n", "flagged", "injected", found.scalar().alias("cleaning_f1"), down.scalar().alias("downstream_f1"))
        out = row if out is None else out.unionByName(row)
    return out
