"""Label and feature noise for single-annotator tables ``(id, features, label)``.

All functions add ``noisy_label`` and ``is_injected_noise``. Draws are keyed by id, so a re-run task
repeats its draws and a table may be repartitioned freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import arrays, rand
from labelq.functions.ordering import flag_first
from labelq.operators.metrics import class_grid, confusion_matrix

EPS = 1e-7


def with_flag(df: DataFrame, label: str = "label", noisy: str = "noisy_label") -> DataFrame:
    return df.withColumn("is_injected_noise", (F.col(label) != F.col(noisy)).cast("int"))


def next_class(label: Column, k: int) -> Column:
    return ((label + 1) % k).cast("int")


def other_class(label: Column, u: Column, k: int) -> Column:
    """One of the other k-1 classes, equally likely."""
    return ((label + 1 + F.floor(u * (k - 1))) % k).cast("int")


def uniform(df: DataFrame, n_classes: int, rate: float, tag: str = "uniform") -> DataFrame:
    """Keep the label with probability 1-rate, else each other class is equally likely."""
    u1, u2 = rand.uniform(tag, "id"), rand.uniform(tag + "/to", "id")
    label = F.col("label")
    return with_flag(df.withColumn("noisy_label", F.when(u1 < rate, other_class(label, u2, n_classes)).otherwise(label).cast("int")))


def asymmetric(df: DataFrame, n_classes: int, rate: float, tag: str = "asymmetric") -> DataFrame:
    """Exactly floor(rate*N) distinct rows move to the next class."""
    n = F.floor(F.round(F.lit(rate) * F.col("group_rows"), 9))
    flagged = flag_first(df, n, rand.hash32(tag, "id"), F.col("id"), out="_move")
    label = F.col("label")
    return with_flag(flagged.withColumn("noisy_label", F.when(F.col("_move") == 1, next_class(label, n_classes)).otherwise(label).cast("int"))).drop("_move")


def draw(cumulative: Column, values: Column, u: Column) -> Column:
    """The value whose cumulative interval holds u; the last one absorbs rounding."""
    i = F.least(F.size(F.filter(cumulative, lambda c: c <= u)), F.size(values) - 1)
    return F.get(values, i)


def running_sum(a: Column) -> Column:
    """Cumulative sums; rows are as long as the number of classes."""
    return F.transform(a, lambda _, i: arrays.total(F.slice(a, 1, i + 1)))


def by_matrix(df: DataFrame, matrix: DataFrame, tag: str = "matrix", label: str = "label") -> DataFrame:
    """Draw the new label from row ``label`` of a transition table (from_label, to_label, prob)."""
    rows = (
        matrix.groupBy(F.col("from_label").alias("_from"))
        .agg(F.array_sort(F.collect_list(F.struct("to_label", "prob"))).alias("_cells"))
        .select("_from", F.col("_cells.to_label").alias("_to"), running_sum(F.col("_cells.prob")).alias("_cum"))
    )
    joined = df.join(F.broadcast(rows), F.col(label) == F.col("_from"), "left")
    drawn = F.coalesce(draw(F.col("_cum"), F.col("_to"), rand.uniform(tag, "id")), F.col(label)).cast("int")
    return with_flag(joined.withColumn("noisy_label", drawn), label).drop("_from", "_to", "_cum")


def check_row_stochastic(matrix: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per row of a transition table: its sum, its least entry and whether it is a distribution."""
    s, m = F.sum("prob"), F.min("prob")
    return matrix.groupBy("from_label").agg(
        F.round(s, 6).alias("row_sum"), F.round(m, 6).alias("least"),
        ((F.abs(s - 1.0) <= tolerance) & (m >= 0)).cast("int").alias("valid"))


def flip_by_matrix(df: DataFrame, matrix: DataFrame, tag: str = "flip") -> DataFrame:
    """``by_matrix`` that fails on a table whose rows are not distributions."""
    bad = check_row_stochastic(matrix).filter("valid = 0").limit(1).count()
    if bad:
        raise ValueError("transition table has a row that is negative or does not sum to 1")
    return by_matrix(df, matrix, tag)


def class_dependent_matrix(preds: DataFrame, n_classes: int, axis: str = "true") -> DataFrame:
    """Transition table from a model's confusion matrix.

    ``axis='true'`` reads the row of the true class; ``axis='column'`` reads its column, as the
    benchmark does. The entries are lifted by a small constant and renormalised.
    """
    cm = confusion_matrix(preds, "label", "pred", n_classes)
    if axis == "column":
        cm = cm.select(F.col("to_label").alias("from_label"), F.col("from_label").alias("to_label"), "prob")
    elif axis != "true":
        raise ValueError(f"unknown axis {axis!r}")
    lifted = F.col("prob") + EPS
    return cm.select("from_label", "to_label", (lifted / F.sum(lifted).over(W.partitionBy("from_label"))).alias("prob"))


def class_dependent(df: DataFrame, preds: DataFrame, n_classes: int, axis: str = "true", tag: str = "classdependent") -> DataFrame:
    """Labels move as a model confuses them; the requested rate plays no part."""
    return by_matrix(df, class_dependent_matrix(preds, n_classes, axis), tag)


def random_projection(df: DataFrame, n_features: int, n_classes: int, tag: str) -> DataFrame:
    """One row holding K keyed normal weight vectors of length S."""
    row = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda s: rand.normal(tag, F.col("id"), s))
    return (
        df.sparkSession.range(n_classes).select("id", row.alias("w"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda z: z["w"]).alias("w"))
    )


def instance_scores(df: DataFrame, n_features: int, n_classes: int, rate: float, tag: str = "instance") -> DataFrame:
    """Add the flip rate ``q`` and the label distribution ``flip_probs`` of every row."""
    w = random_projection(df, n_features, n_classes, tag + "/w")
    scored = df.withColumn("_w", w.scalar()).withColumn("_s", F.transform("_w", lambda v: arrays.dot(F.col("features"), v)))
    label = F.col("label")
    weights = arrays.let(F.array_max(arrays.others("_s", "label")), lambda top: F.transform(
        "_s", lambda s, j: F.when(j == label, F.lit(0.0)).otherwise(F.exp(s - top))))
    scored = scored.withColumn("q", rand.truncated_normal_above(rate, 0.1, tag + "/q", "id")).withColumn("_e", weights)
    probs = arrays.let(arrays.total("_e"), lambda total: F.transform(
        "_e", lambda e, j: F.when(j == label, F.lit(1.0) - F.col("q")).otherwise(F.col("q") * e / total)))
    return scored.withColumn("flip_probs", probs).drop("_w", "_s", "_e")


def instance_dependent(df: DataFrame, n_features: int, n_classes: int, rate: float, tag: str = "instance") -> DataFrame:
    """A flip rate per row from a truncated normal in [rate, rate+0.1], target class by random projections."""
    scored = instance_scores(df, n_features, n_classes, rate, tag)
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    noisy = draw(running_sum(F.col("flip_probs")), classes, rand.uniform(tag + "/draw", "id")).cast("int")
    return with_flag(scored.withColumn("noisy_label", noisy)).drop("flip_probs")


def gaussian_features(df: DataFrame, mean: float = 0.0, sigma: float = 0.01, tag: str = "gauss") -> DataFrame:
    """Add an independent normal to every feature; labels stay."""
    noisy = F.transform("features", lambda x, i: x + F.lit(mean) + F.lit(sigma) * rand.normal(tag, F.col("id"), i))
    return df.withColumn("noisy_features", noisy)


def noise_rate(df: DataFrame, label: str = "label", noisy: str = "noisy_label") -> DataFrame:
    return df.agg(F.round(F.avg((F.col(label) != F.col(noisy)).cast("int")), 6).alias("noise_rate"))


def transition(df: DataFrame, given: str, seen: str, n_classes: int, digits: int = 6) -> DataFrame:
    """(given, seen, n, prob): counts normalised over ``given``, with the share of ``given``.

    ``given='noisy_label'`` is the estimate as the benchmark codes it, ``given='label'`` the usual
    P(noisy | true).
    """
    counts = df.groupBy(F.col(given).alias("_g"), F.col(seen).alias("_s")).agg(F.count("*").alias("_n"))
    full = (
        class_grid(df, n_classes, (given, seen))
        .join(F.broadcast(counts), (F.col(given) == F.col("_g")) & (F.col(seen) == F.col("_s")), "left")
        .select(given, seen, F.coalesce("_n", F.lit(0)).alias("n"))
    )
    row, everything = F.sum("n").over(W.partitionBy(given)), F.sum("n").over(W.partitionBy())
    prob = F.when(row > 0, F.col("n") / row).otherwise(F.lit(0.0))
    return full.select(given, seen, "n", F.round(prob, digits).alias("prob"), F.round(row / everything, digits).alias("share"))


def sweep(df: DataFrame, preds: DataFrame, n_classes: int, rates: list[float], n_features: int | None = None) -> DataFrame:
    """All kinds at all rates, one ``noise_type`` name per run (``classdependent`` takes no rate)."""
    keep = ["noise_type", "id", "label", "noisy_label", "is_injected_noise"]
    runs = []
    for r in rates:
        runs.append(uniform(df, n_classes, r, f"uniform-{r}").withColumn("noise_type", F.lit(f"uniform-{r}")))
        runs.append(asymmetric(df, n_classes, r, f"asymmetric-{r}").withColumn("noise_type", F.lit(f"asymmetric-{r}")))
        if n_features:
            runs.append(instance_dependent(df, n_features, n_classes, r, f"instance-{r}").withColumn("noise_type", F.lit(f"instance-{r}")))
    runs.append(class_dependent(df, preds, n_classes).withColumn("noise_type", F.lit("classdependent")))
    out = runs[0].select(*keep)
    for run in runs[1:]:
        out = out.unionByName(run.select(*keep))
    return out
