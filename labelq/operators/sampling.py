"""Splits, folds, samples and class shares. Exact counts, no global sort, no per-class task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.functions.ordering import flag_first, ranked, take_first


def stratified_split(df: DataFrame, label: str, test: float, tag: str = "split", drawn: str | None = None) -> DataFrame:
    """Add ``is_test``: round(n_class * test) rows of every class.

    ``drawn`` names a column that holds the draw already, for tables that are stored with it.
    """
    order = rand.hash32(tag, "id") if drawn is None else F.col(drawn)
    return flag_first(df, F.round(F.col("group_rows") * F.lit(test)), order, F.col("id"), [label], "is_test")


def random_split(df: DataFrame, share: float = 0.25, tag: str = "validation") -> DataFrame:
    """Add ``is_validation``: floor(N * share) rows."""
    return flag_first(df, F.floor(F.round(F.col("group_rows") * F.lit(share), 9)), rand.hash32(tag, "id"), F.col("id"), out="is_validation")


def half_split(df: DataFrame, tag: str = "half") -> DataFrame:
    """Add ``half``: 'A' for floor(N/2) shuffled rows, 'B' for the rest."""
    flagged = flag_first(df, F.floor(F.col("group_rows") / 2), rand.hash32(tag, "id"), F.col("id"), out="_a")
    return flagged.withColumn("half", F.when(F.col("_a") == 1, F.lit("A")).otherwise(F.lit("B"))).drop("_a")


def kfold(df: DataFrame, label: str, k: int = 5, tag: str = "fold") -> DataFrame:
    """Add ``fold``: class-balanced fold ids, by position in the hash order of each class."""
    h = rand.hash32(tag, "id")
    numbered = ranked(df, [label], h, F.lit(0), [F.col("id")], "_r", bucket=F.shiftright(h, 22))
    return numbered.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def downsample_class(df: DataFrame, label: str, value, share: float = 0.15, tag: str = "down") -> DataFrame:
    """Keep every row of the other classes and a share of one class."""
    return df.filter((F.col(label) != F.lit(value)) | (rand.uniform(tag, "id") < share))


def cap_per_class(df: DataFrame, label: str, n: int, tag: str = "cap") -> DataFrame:
    """At most n random rows of each class."""
    return take_first(df, F.least(F.lit(n), F.col("group_rows")), rand.hash32(tag, "id"), F.col("id"), [label])


def sample_rounds(df: DataFrame, n, rounds: int, tag: str = "round") -> DataFrame:
    """``rounds`` independent samples of n rows without replacement, with a ``round`` column.

    ``n`` is a number or an expression over ``group_rows``.
    """
    each = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    size = F.least(n if not isinstance(n, int) else F.lit(n), F.col("group_rows"))
    return take_first(each, size, rand.hash32(tag, "round", "id"), F.col("id"), ["round"])


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of every class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row per class


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): 1 minus the class share."""
    return class_counts(df, label).select(label, (F.lit(1.0) - F.col("share")).alias("weight"))
