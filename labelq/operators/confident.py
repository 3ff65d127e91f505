"""Confident learning on out-of-sample probabilities ``(id, label, probs)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.functions.ordering import attach, quantile, ranked
from labelq.operators.noise import class_grid


def thresholds(probs: DataFrame) -> DataFrame:
    """(label, threshold, n): mean probability of the own class."""
    return probs.groupBy("label").agg(F.avg(arrays.at("probs", "label")).alias("threshold"), F.count("*").alias("n"))


def confident_class(probs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``confident``: the most probable class among those at or above their threshold, or null."""
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("t"))
    pairs = F.transform("probs", lambda p, j: F.struct(p.alias("p"), (-j).alias("low"), j.alias("j")))
    best = F.array_max(F.filter(pairs, lambda z: z["p"] >= F.try_element_at("_t", z["j"])))
    return probs.withColumn("_t", table.scalar()).withColumn("confident", best["j"]).drop("_t")


def confident_joint(probs: DataFrame, n_classes: int) -> DataFrame:
    """(label, confident, n, calibrated): raw counts, and counts scaled to the observed label counts.

    The diagonal is at least 1; zero cells are present.
    """
    cuts = thresholds(probs)
    counts = (
        confident_class(probs, cuts)
        .groupBy(F.col("label").alias("_l"), F.col("confident").alias("_c")).agg(F.count("*").alias("n"))
    )  # rows without a confident class form a null cell that the grid join leaves out
    grid = class_grid(probs, n_classes, ("label", "confident"))
    full = grid.join(F.broadcast(counts), (F.col("label") == F.col("_l")) & (F.col("confident") == F.col("_c")), "left").select(
        "label", "confident", F.coalesce("n", F.lit(0)).alias("n"))
    floor = F.when(F.col("label") == F.col("confident"), F.greatest("n", F.lit(1))).otherwise(F.col("n"))
    row = F.sum(floor).over(W.partitionBy("label"))
    joined = full.join(F.broadcast(cuts.select("label", F.col("n").alias("_n"))), "label", "left")
    return joined.select("label", "confident", "n", (floor / F.greatest(row, F.lit(1)) * F.coalesce("_n", F.lit(0))).alias("calibrated"))


def issues(probs: DataFrame, n_classes: int, joint: DataFrame | None = None) -> DataFrame:
    """(id, label_issue): prune by noise rate.

    For every pair (i, j) the n_ij rows labelled i with the largest p[j] - p[i] are flagged, ties at the
    cut included, unless the model agrees with the label. Only the cut values are computed; no row is
    sorted.
    """
    joint = joint if joint is not None else confident_joint(probs, n_classes)
    own = arrays.at("probs", "label")
    cells = probs.select("label", own.alias("_own"), F.posexplode("probs").alias("other", "_p")).filter("other <> label")
    margins = cells.select("label", "other", (F.col("_p") - F.col("_own")).alias("margin"))
    sizes = thresholds(probs).select("label", F.col("n").alias("_m"))
    wanted = joint.filter("label <> confident").select("label", F.col("confident").alias("other"), F.least(F.round("calibrated"), F.lit(1e18)).cast("long").alias("n"))
    places = wanted.join(F.broadcast(sizes), "label").filter("n > 0").select("label", "other", F.greatest(F.col("_m") - F.col("n"), F.lit(0)).alias("position"))
    cuts = quantile(margins, "margin", places, ["label", "other"], "cut")
    table = cuts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("other", "cut"))).alias("_cuts"))
    wide = attach(probs, table, ["label"])
    over = F.filter("probs", lambda p, j: (j != F.col("label")) & (p - own >= F.try_element_at("_cuts", j)))
    flagged = (F.coalesce(F.size(over), F.lit(0)) > 0) & (arrays.argmax("probs") != F.col("label"))
    return wide.select("id", flagged.cast("int").alias("label_issue"))


def label_quality(probs: DataFrame) -> DataFrame:
    """(id, score, rank): self-confidence, least trustworthy first; ties by a keyed hash, then id."""
    scored = probs.select("id", arrays.at("probs", "label").alias("score"))
    return ranked(scored, [], F.col("score"), rand.hash32("quality", "id"), [F.col("id")])
