"""From run tables to result tables.

Contracts: ``long`` is (dataset, base_model, noise_type, seed, id, observed_label, noisy_label,
is_injected_noise, method, label_issue, pred_cleaned); ``results`` is (dataset, base_model,
noise_type, seed, method, cleaning_f1, downstream_f1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelq.operators.metrics import metrics

RUN = ["dataset", "base_model", "noise_type", "seed"]
RUN_METHOD = [*RUN, "method"]

# The data kind each base model is used for.
MODALITY = {
    "resnet1d": "time-series", "fcn": "time-series", "mlp": "tabular", "resnet18": "image", "mobilenet-v2": "image",
    "all-distilroberta-v1": "text", "all-MiniLM-L6-v2": "text",
}


def datacard_long(wide: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per method instead of two columns per method."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"label_issues_{m}").alias("label_issue"),
                               F.col(f"preds_cleaned_{m}").alias("pred_cleaned")) for m in methods])
    keep = [c for c in wide.columns if not c.startswith(("label_issues_", "preds_cleaned_"))]
    return wide.select(*keep, F.explode(cells).alias("_m")).select(*keep, "_m.*")


def complete_runs(long: DataFrame, n_methods: int) -> DataFrame:
    """Rows of the runs that hold results of all methods."""
    full = long.groupBy(*RUN).agg(F.count_distinct("method").alias("m")).filter(F.col("m") == n_methods)
    return long.join(full.select(*RUN), RUN, "left_semi")


def detection_metrics(long: DataFrame) -> DataFrame:
    """How well the flags of each method find the injected noise, per run and method."""
    return metrics(long, "is_injected_noise", "label_issue", RUN_METHOD)


def noisy_row_metrics(long: DataFrame) -> DataFrame:
    """Among corrupted rows: the noisy label against the prediction after cleaning."""
    return metrics(long.filter("is_injected_noise = 1"), "noisy_label", "pred_cleaned", RUN_METHOD)


def downstream_metrics(preds: DataFrame, test_labels: DataFrame) -> DataFrame:
    """Stored predictions (run, method, id, pred) against test labels (dataset, id, label)."""
    return metrics(preds.join(test_labels, ["dataset", "id"]), "label", "pred", RUN_METHOD)


def issue_counts(long: DataFrame) -> DataFrame:
    return long.groupBy(*RUN_METHOD).agg(F.sum("is_injected_noise").alias("injected"), F.sum("label_issue").alias("flagged"))


def without(df: DataFrame, **ignore: Sequence[str]) -> DataFrame:
    """Drop rows whose column takes an ignored value."""
    for column, values in ignore.items():
        df = df.filter(~F.col(column).isin(*values))
    return df


def with_rate(df: DataFrame, rates: Sequence[str]) -> DataFrame:
    """Keep the given noise rates, and kinds that carry no rate; the noise-free run goes."""
    named = F.col("noise_type").contains("-")
    rate = F.regexp_extract("noise_type", "-([^-]*)$", 1)
    return df.filter((~named | rate.isin(*rates)) & (F.col("noise_type") != "nonoise"))


def pivot_runs(df: DataFrame, value: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """dataset x (noise, method); the columns are given, so no extra job looks for them."""
    names = [f"{n}_{m}" for n, m in columns]
    return df.withColumn("_p", F.concat_ws("_", "noise_type", "method")).groupBy("dataset").pivot("_p", names).agg(F.max(value))


def results_table(detection: DataFrame, downstream: DataFrame, missing: float | None = None) -> DataFrame:
    """Detection and downstream F1 per run and method, plus the uncleaned model as a method.

    A missing downstream result is null; ``missing=0.0`` stores it as 0 instead.
    """
    down = downstream.select(*RUN_METHOD, F.col("weighted_f1").alias("downstream_f1"))
    det = detection.select(*RUN_METHOD, F.col("weighted_f1").alias("cleaning_f1"))
    out = det.join(down, RUN_METHOD, "left")
    if missing is not None:
        out = out.withColumn("downstream_f1", F.coalesce("downstream_f1", F.lit(missing)))
    plain = down.filter("method = 'nocleaning'").withColumn("cleaning_f1", F.lit(0.0))
    return out.unionByName(plain)


def noise_name(noise_type: Column | str) -> Column:
    """The noise kind without its rate."""
    c = F.col(noise_type) if isinstance(noise_type, str) else noise_type
    return F.when(c.contains("-"), F.regexp_extract(c, "^(.*)-", 1)).otherwise(c)


def with_modality(df: DataFrame, modality: Mapping[str, str] = MODALITY) -> DataFrame:
    """Look the base model up in a fixed table; an unknown model is null."""
    pairs = [F.lit(x) for kv in modality.items() for x in kv]
    return df.withColumn("modality", F.try_element_at(F.create_map(*pairs), F.col("base_model")))


def cleaning_gain(downstream: DataFrame, metric: str = "weighted_f1") -> DataFrame:
    """Downstream metric with a method against the uncleaned model of the same run."""
    base = downstream.filter("method = 'nocleaning'").select(*RUN, F.col(metric).alias("before"))
    after = downstream.filter("method <> 'nocleaning'").select(*RUN_METHOD, F.col(metric).alias("after"))
    return after.join(base, RUN).withColumn("gain", F.round(F.col("after") - F.col("before"), 6))


# Beginnings of stored columns that do not belong to a detector.
NOT_COMPARED = ("is_injected_noise", "observed_labels", "preds_cleaned", "noisy_label")


def model_consistency(a: DataFrame, b: DataFrame, suffixes: tuple[str, str], ignore: Sequence[str] = NOT_COMPARED) -> DataFrame:
    """Two runs of one data set side by side, aligned on the row id."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("id", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "id" and not c.startswith(tuple(ignore))])

    return side(a, suffixes[0]).join(side(b, suffixes[1]), "id", "full")


def param_grid(spark: SparkSession, base: Mapping[str, object], detector: Mapping[str, object]) -> DataFrame:
    """Every combination of base-model and detector parameters; an empty side counts as one setting.

    A parameter's values are a list, or a one-column table whose distinct values are the list.
    """
    grid = spark.range(1).select(F.lit(1).alias("_x"))
    names = []
    for side, params in (("base", base), ("detector", detector)):
        for name, values in params.items():
            column = f"{side}_{name}"
            if isinstance(values, DataFrame):
                v = values.agg(F.array_sort(F.collect_set(values.columns[0])).alias("v")).scalar()
            else:
                v = F.array(*[F.lit(x) for x in values])
            grid = grid.withColumn(column, F.explode(v))
            names.append(column)
    return grid.select(*names) if names else grid.select(F.lit("").alias("setting"))


def setting_name(columns: Mapping[str, str]) -> Column:
    """``key-value;key-value`` from (key -> column), commas removed from the values."""
    parts = [F.concat(F.lit(k + "-"), F.regexp_replace(F.col(c).cast("string"), ",", "")) for k, c in columns.items()]
    return F.concat_ws(";", *parts)


def grid_results(scored: DataFrame, settings: Sequence[str]) -> DataFrame:
    """dataset x setting weighted F1 of (dataset, setting, label, pred)."""
    f1 = metrics(scored, "label", "pred", ["dataset", "setting"])
    return f1.groupBy("dataset").pivot("setting", list(settings)).agg(F.max("weighted_f1"))
