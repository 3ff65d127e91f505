"""Base classifiers, out-of-fold scores and training dynamics.

Any ``pyspark.ml`` classifier with a probability column can take the place of the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions import arrays
from labelq.operators.sampling import class_weights, half_split, kfold
from labelq.session import materialised


def default_classifier():
    return LogisticRegression(family="multinomial", maxIter=20, regParam=0.01)


def _assembled(df: DataFrame) -> DataFrame:
    return df.withColumn("_vec", array_to_vector(F.col("features")))


def fit(df: DataFrame, weighted: bool = False, make: Callable = default_classifier):
    """Fit a classifier on (features, label), optionally weighting rows by 1 minus their class share."""
    model = make().setFeaturesCol("_vec").setLabelCol("label").setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
    data = _assembled(df.select("features", "label"))
    if weighted:
        data = data.join(F.broadcast(class_weights(df, "label")), "label")
        model = model.setWeightCol("weight")
    return model.fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``probs`` and ``pred`` (the most probable class, first on ties)."""
    out = model.transform(_assembled(df)).withColumn("probs", vector_to_array(F.col("_prob")))
    return out.withColumn("pred", arrays.argmax("probs")).drop("_vec", "_prob", "_raw", "_pred")


def oof_probs(df: DataFrame, folds: int = 5, weighted: bool = False, make: Callable = default_classifier, tag: str = "fold") -> DataFrame:
    """Every row scored by a model that did not see it; the fold table is read from storage by each fit."""
    placed = materialised(kfold(df, "label", folds, tag), "folds")
    out = None
    for k in range(folds):
        model = fit(placed.filter(F.col("fold") != k), weighted, make)
        part = predict(model, placed.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("fold")


def cross_halves(df: DataFrame, weighted: bool = False, make: Callable = default_classifier, tag: str = "half") -> DataFrame:
    """Both halves, each scored by a model fitted on the other one; adds ``half``."""
    placed = materialised(half_split(df, tag), "halves")
    parts = []
    for train, test in (("A", "B"), ("B", "A")):
        model = fit(placed.filter(F.col("half") == train), weighted, make)
        parts.append(predict(model, placed.filter(F.col("half") == test)))
    return parts[0].unionByName(parts[1])


# ---- softmax regression with recorded logits ----

def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, dtype=float) for v in pdf["features"]])
    return np.hstack([x, np.ones((len(x), 1))]), pdf["label"].to_numpy()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _gradient(df: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sum of gradients, loss and rows. Each task sends one flattened matrix; they are added by position."""
    k, d = w.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, loss, n = np.zeros((k, d)), 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = _batch(pdf)
            p = _softmax(x @ w.T)
            loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
            p[np.arange(len(y)), y] -= 1.0
            g += p.T @ x
            n += len(y)
        yield pd.DataFrame({"i": np.arange(k * d + 2), "v": np.r_[g.ravel(), loss, float(n)]})

    sums = df.select("features", "label").mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * d + 2)
    for r in sums:  # one number per model weight
        flat[r["i"]] = r["v"]
    return flat[:-2].reshape(k, d), flat[-2], int(flat[-1])


def training_dynamics(df: DataFrame, n_classes: int, epochs: int = 5, rate: float = 2.0, steps_per_epoch: int = 1):
    """((id, epoch, target, logits), losses): logits of every row after every epoch of full-batch descent.

    The model is K x (D+1) numbers; the table is read once per step and once more to write the
    logits of all epochs together.
    """
    width = len(df.select("features").first()[0]) + 1
    w, history, losses = np.zeros((n_classes, width)), [], []
    for _ in range(epochs):
        for _ in range(steps_per_epoch):
            g, loss, n = _gradient(df, w)
            w = w - rate * g / max(n, 1)
        losses.append(loss / max(n, 1))
        history.append(w.copy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = _batch(pdf)
            for epoch, m in enumerate(history):
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "epoch": epoch, "target": y, "logits": list(x @ m.T)})

    idt = dict(df.dtypes)["id"]
    return df.select("id", "features", "label").mapInPandas(run, f"id {idt}, epoch int, target int, logits array<double>"), losses


# ---- one hidden layer, by distributed partial gradients ----

class Hidden:
    """One tanh layer and a softmax; ``weights`` are (hidden, D+1) and (classes, hidden+1)."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def layer(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0].T)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Sums of the gradients and of the loss; ``x`` ends with a column of ones."""
        h = self.layer(x)
        h1 = np.hstack([h, np.ones((len(h), 1))])
        p = _softmax(h1 @ self.weights[1].T)
        loss = -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
        p[np.arange(len(y)), y] -= 1.0
        back = (p @ self.weights[1][:, :-1]) * (1.0 - h * h)
        return [back.T @ x, p.T @ h1], loss


def fit_hidden(df: DataFrame, n_classes: int, hidden: int = 16, steps: int = 40, rate: float = 0.1, decay: float = 1e-3) -> tuple[Hidden, list[float]]:
    """A hidden-layer classifier of (features, label) and its mean loss before every step.

    Every step is one pass in which a task sends the sums of its gradients; they are added on the executors, so the
    driver gets one number per weight. Rows without a label are left out.
    """
    data = df.select("features", "label").where("label is not null")
    width = len(data.first()[0]) + 1
    rng = np.random.default_rng(3)
    model = Hidden([rng.normal(0, 1.0, (hidden, width)), rng.normal(0, 0.1, (n_classes, hidden + 1))])
    sizes = [w.size for w in model.weights]
    mean, square, losses = [0.0, 0.0], [0.0, 0.0], []
    for step in range(1, steps + 1):
        def run(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros(sum(sizes) + 2)
            for pdf in batches:
                if len(pdf):
                    x, y = _batch(pdf)
                    g, loss = model.gradients(x, y)
                    total += np.r_[g[0].ravel(), g[1].ravel(), loss, float(len(y))]
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        flat = np.zeros(sum(sizes) + 2)
        for r in data.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one number per weight
            flat[r["i"]] = r["v"]
        losses.append(flat[-2] / max(flat[-1], 1.0))
        parts = flat[: sizes[0]], flat[sizes[0] : -2]
        new = []
        for i, (w, g) in enumerate(zip(model.weights, parts, strict=True)):
            g = g.reshape(w.shape) / max(flat[-1], 1.0) + decay * w
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            new.append(w - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8))
        model = Hidden(new)
    return model, losses


def hidden_features(model: Hidden, df: DataFrame) -> DataFrame:
    """``df`` with the hidden layer of its rows, scaled to length 1, as ``features``."""
    @F.pandas_udf("array<double>")
    def layer(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=float) for v in features])
        h = model.layer(np.hstack([x, np.ones((len(x), 1))]))
        return pd.Series(list(h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)))

    return df.withColumn("features", layer("features"))


def hidden_from(train: DataFrame, n_classes: int) -> Callable[[DataFrame], DataFrame]:
    """The default ``features_from``: fit on ``train``, give back what replaces features by the hidden layer."""
    model, _ = fit_hidden(train, n_classes)
    return lambda rows: hidden_features(model, rows)
