"""Classification metrics from confusion counts.

Every metric starts from one grouped count with map-side combine; what follows works on at most
(classes x classes) rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import arrays


def confusion_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., truth, pred, n)."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall, F1 (0 where undefined)."""
    roles = F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("h")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
    ))
    per = (
        confusion_counts(df, truth, pred, by).select(*by, roles.alias("r"))
        .groupBy(*by, F.col("r.class").alias("class"))
        .agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.h").alias("hits"))
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    s, p, h = F.col("support"), F.col("predicted"), F.col("hits")
    return (
        per.withColumn("precision", ratio(h, p)).withColumn("recall", ratio(h, s)).withColumn("f1", ratio(2 * h, s + p))
    )


def metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """All metrics in one pass, one row per group.

    Micro F1, precision and recall equal accuracy for single-label data. ``error_rate`` keeps the
    meaning it has in the benchmark (1 minus the 0-1 loss); ``true_error_rate`` is the 0-1 loss.
    """
    s, n = F.col("support"), F.sum("support")
    acc = F.sum("hits") / n
    cols = {
        "f1": acc, "weighted_f1": F.sum(F.col("f1") * s) / n, "accuracy": acc, "precision": acc, "recall": acc,
        "error_rate": acc, "true_error_rate": F.lit(1.0) - acc,
        "weighted_precision": F.sum(F.col("precision") * s) / n, "weighted_recall": F.sum(F.col("recall") * s) / n,
    }
    out = class_scores(df, truth, pred, by).groupBy(*by).agg(n.alias("n_rows"), *[c.alias(k) for k, c in cols.items()])
    return out.select(*by, "n_rows", *[F.round(k, digits).alias(k) for k in cols])


def class_grid(df: DataFrame, n_classes: int, names: tuple[str, str]) -> DataFrame:
    """All pairs of class codes, so that zero cells exist."""
    k = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(names[0]))
    return k.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))


def confusion_matrix(df: DataFrame, truth: str, pred: str, n_classes: int, digits: int = 6) -> DataFrame:
    """(from_label, to_label, prob): counts normalised over the true class, zero cells included."""
    counts = confusion_counts(df, truth, pred)
    full = (
        class_grid(df, n_classes, ("from_label", "to_label"))
        .join(F.broadcast(counts), (F.col("from_label") == F.col("truth")) & (F.col("to_label") == F.col("pred")), "left")
        .select("from_label", "to_label", F.coalesce("n", F.lit(0)).alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("from_label"))
    prob = F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0))
    return full.select("from_label", "to_label", F.round(prob, digits).alias("prob"))


def calibration_error(df: DataFrame, label: str, probs: str, bins: int = 3) -> DataFrame:
    """Expected calibration error over equal-width bins of the top confidence."""
    conf = F.array_max(probs)
    per = (
        df.select(conf.alias("conf"), (arrays.argmax(probs) == F.col(label)).cast("int").alias("hit"))
        .groupBy(F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("conf"))
    )
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def topk_accuracy(df: DataFrame, label: str, probs: str, ks: Sequence[int]) -> DataFrame:
    """Percentage of rows whose label is among the k most probable classes, for several k."""
    own = arrays.at(probs, label)
    ahead = F.size(F.filter(F.transform(probs, lambda p, j: (p > own) | ((p == own) & (j < F.col(label)))), lambda b: b))
    hits = df.select(ahead.alias("ahead"))
    return (
        hits.agg(*[F.avg((F.col("ahead") < k).cast("int")).alias(f"k{k}") for k in ks])
        .select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("a")) for k in ks])).alias("s"))
        .select(F.col("s.k").alias("k"), F.round(F.col("s.a") * 100, 6).alias("accuracy_pct"))
    )
