"""Suspicious rows by prediction margin, and the counterexamples that explain them.

``scored`` is (id, features, label, probs). A counterexample is a trusted row whose label is the
class predicted for the suspicious row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.functions.ordering import ranked
from labelq.operators import neighbours
from labelq.session import materialised


def inspect(scored: DataFrame, inspector: str = "margin", threshold: float = 0.25, tag: str = "inspect") -> DataFrame:
    """Add ``pred``, ``suspiciousness`` and ``suspicious`` (1 when above threshold and the model disagrees).

    ``always`` and ``never`` score minus and plus infinity, as the method defines them; ``random`` has
    no score and flags with probability ``threshold``.
    """
    pred = arrays.argmax("probs")
    if inspector == "margin":
        s = F.array_max("probs") - arrays.at("probs", "label")
    elif inspector == "always":
        s = F.lit(float("-inf"))
    elif inspector == "never":
        s = F.lit(float("inf"))
    elif inspector == "random":
        s = F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown inspector {inspector!r}")
    above = rand.uniform(tag, "id") < threshold if inspector == "random" else F.col("suspiciousness") > threshold
    d = scored.withColumn("pred", pred).withColumn("suspiciousness", s)
    return d.withColumn("suspicious", (above & (F.col("pred") != F.col("label"))).cast("int"))


def nearest(suspicious: DataFrame, trusted: DataFrame, k: int = 25, **layout) -> DataFrame:
    """(id, rank, nbr_id, dist): up to k nearest trusted rows of the predicted class."""
    found = neighbours.knn(suspicious, trusted, k, "euclidean", "pred", "label", **layout)
    return found.select("id", "rank", "nbr_id", "dist")


def random_pick(suspicious: DataFrame, trusted: DataFrame, tag: str = "pick") -> DataFrame:
    """(id, nbr_id): a uniformly drawn trusted row of the predicted class.

    Trusted rows are numbered within their class; a suspicious row draws a number and joins on it, so
    neither side fans out.
    """
    h = rand.hash32(tag, "id")
    numbered = ranked(trusted.select("id", "label"), ["label"], h, F.lit(0), [F.col("id")], "_no", bucket=F.shiftright(h, 22))
    sizes = trusted.groupBy("label").agg(F.count("*").alias("_size"))
    drawn = suspicious.select("id", F.col("pred").alias("label")).join(F.broadcast(sizes), "label")
    drawn = drawn.withColumn("_no", (F.floor(rand.uniform(tag + "/draw", "id") * F.col("_size")) + 1).cast("long"))
    return drawn.join(numbered.withColumnRenamed("id", "nbr_id"), ["label", "_no"]).select("id", "nbr_id")


def log_likelihood_gradient(scored: DataFrame) -> DataFrame:
    """Add ``grad`` = e_label - probs: with (x, 1) it spans the gradient of softmax regression."""
    g = F.transform("probs", lambda p, j: F.when(j == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0)) - p)
    return scored.withColumn("grad", g)


def kernel(qa: np.ndarray, da: np.ndarray, qx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Dot products of the gradients: (e_i - p_i).(e_j - p_j) * (x_i.x_j + 1)."""
    return (qa @ da.T) * (qx @ dx.T + 1.0)


def by_gradient(suspicious: DataFrame, trusted: DataFrame, k: int = 1, **layout) -> DataFrame:
    """(id, rank, nbr_id, score): trusted rows of the predicted class with the greatest gradient product.

    The error vector and (x, 1) stay apart; the search bounds the product by their inner products.
    """
    def side(df: DataFrame, group: str) -> DataFrame:
        x = F.concat("features", F.array(F.lit(1.0)))
        return log_likelihood_gradient(df).select("id", "label", F.col(group).alias("_g"), "grad", x.alias("features"))

    found = neighbours.knn(side(suspicious, "pred"), side(trusted, "label"), k, "product", "_g", "_g", factor="grad", **layout)
    return found.select("id", "rank", "nbr_id", (-F.col("dist")).alias("score"))


def within_radius(suspicious: DataFrame, trusted: DataFrame, share: float = 0.1, **layout) -> DataFrame:
    """(id, n_within, nbr_id): best gradient product within ``share`` of the diameter, else the nearest row."""
    if not 0 < share < 1:
        raise ValueError("share of the diameter must lie between 0 and 1")
    everything = suspicious.select("id", "label", "features").unionByName(trusted.select("id", "label", "features"))
    radius = share * neighbours.diameter(everything, **layout)
    s, t = log_likelihood_gradient(suspicious), log_likelihood_gradient(trusted)
    found = neighbours.within_radius(s, t, radius, kernel, "grad", "pred", "label", **layout)
    near = materialised(found.select("id", "n_within", "nbr_id"), "within")
    rest = suspicious.join(near, "id", "left_anti")
    lone = nearest(rest, trusted, 1, **layout).select("id", F.lit(0).cast("long").alias("n_within"), "nbr_id")
    return near.unionByName(lone)


def removal(suspicious: DataFrame, counterexamples: DataFrame | None = None) -> DataFrame:
    """(id): the suspicious rows, or those and their counterexamples."""
    if counterexamples is None:
        return suspicious.select("id").distinct()
    pair = counterexamples.select(F.explode(F.array("id", "nbr_id")).alias("id"))
    return pair.distinct()
