"""Preparing labelled tables: cleaning, encoding, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.functions import rand
from labelq.functions.ordering import ranked
from labelq.session import materialised


def nan_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and null become 0."""
    return df.select(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def clean(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows without a label issue; an id missing from ``issues`` counts as clean."""
    return df.join(issues.filter("label_issue = 1").select("id"), "id", "left_anti")


def select_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def one_hot(df: DataFrame, label: str, classes: Sequence[int], out: str = "one_hot") -> DataFrame:
    """0/1 vector over an explicit class list, so a class absent from the data keeps its place."""
    return df.withColumn(out, F.array(*[(F.col(label) == F.lit(c)).cast("int") for c in classes]))


SPLITS = 256  # values that cut the order of all values into ranges


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted 0-based codes of the distinct values of a string column."""
    values = materialised(df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct(), "values")
    # The ranges follow the values that occur, so values with a common beginning are spread as well.
    drawn = values.orderBy(rand.hash32("split", F.col("value").cast("string")), "value").limit(SPLITS - 1).collect()
    cuts = sorted(r["value"] for r in drawn)
    below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda s: s <= F.col("value"))) if cuts else F.lit(0)
    numbered = ranked(values, [], F.col("value"), F.lit(0), out="_r", bucket=below)
    return numbered.select("value", (F.col("_r") - 1).cast("int").alias("code"))


def encode(df: DataFrame, column: str, fitted: DataFrame, out: str | None = None) -> DataFrame:
    """Replace a column by its codes; fit on train, apply to train and test."""
    out = out or column
    table = fitted.select(F.col("value").alias(column), F.col("code").alias("_code"))
    joined = df.join(table, column, "left")
    return joined.select(*[F.col("_code").alias(out) if c == out else F.col(c) for c in df.columns], *([] if out in df.columns else [F.col("_code").alias(out)]))


def low_cardinality_columns(df: DataFrame, threshold: float = 0.05) -> list[str]:
    """String columns whose distinct values are fewer than ``threshold`` of the rows; one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    sure = [c for c in names if row[c] * 1.2 < threshold * row["_n"]]
    near = [c for c in names if c not in sure and row[c] * 0.8 < threshold * row["_n"]]
    if near:  # the sketch cannot decide: count exactly
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first()
        sure += [c for c in near if exact[c] < threshold * row["_n"]]
    return [c for c in names if c in sure]


def encode_low_cardinality(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Every qualifying string column becomes sorted integer codes."""
    names = df.columns
    for c in low_cardinality_columns(df, threshold):
        df = encode(df, c, codes(df, c))
    return df.select(*names)


def standard_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column."""
    return df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("fit"))


def standard_apply(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sd with an sd of 0 counted as 1."""
    wide = df.withColumn("_fit", fit.scalar())

    def scaled(c: str) -> Column:
        f = F.col("_fit")[c]
        return ((F.col(c) - f["m"]) / F.when(f["s"] == 0, 1.0).otherwise(f["s"])).alias(c)

    return wide.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def zscore_per_record(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Scale each record's signal by its own mean and deviation.

    Aggregated first and joined back, so one very long record is never sorted or buffered whole.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return df.join(stats, list(keys)).withColumn(value, (F.col(value) - F.col("_m")) / sd).drop("_m", "_s")


def minmax_fit(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: minima and maxima of every feature position."""
    per = df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return per.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("fit"))


def minmax_apply(df: DataFrame, fit: DataFrame, features: str = "features") -> DataFrame:
    """(x - min) / (max - min), a constant position keeps width 1."""
    wide = df.withColumn("_fit", fit.scalar())
    scaled = F.zip_with(features, "_fit", lambda x, f: (x - f["lo"]) / F.when(f["hi"] == f["lo"], 1.0).otherwise(f["hi"] - f["lo"]))
    return wide.withColumn(features, scaled).drop("_fit")


def flatten_channels(channels: Column | str) -> Column:
    """[C][T] to one channel of C*T values."""
    return F.array(F.flatten(channels))


def transpose(channels: Column) -> Column:
    """[C][T] to [T][C]."""
    steps = F.sequence(F.lit(0), F.size(F.get(channels, F.lit(0))) - 1)
    return F.transform(steps, lambda t: F.transform(channels, lambda c: F.get(c, t)))


def union_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.union(t.select("id"))
    return out.distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in exactly one of two id sets, with one aggregation instead of two set differences."""
    tagged = a.select("id", F.lit(1).alias("s")).union(b.select("id", F.lit(2).alias("s")))
    return tagged.groupBy("id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo = hi").select("id")
