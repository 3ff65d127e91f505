"""Several annotators per row: stacking, majority label and noise from dissent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.functions import rand
from labelq.functions.ordering import take_first
from labelq.operators.noise import with_flag


def stack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide annotator columns to rows (id, label, annotator, annotator_label)."""
    items = F.array(*[F.struct(F.lit(i + 1).alias("annotator"), F.col(c).alias("annotator_label")) for i, c in enumerate(columns)])
    return df.select("id", "label", F.explode(items).alias("_a")).select("id", "label", "_a.*")


def majority(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Most frequent annotator label, the lowest on ties; stays within the row."""
    votes = F.array(*columns)
    tally = F.transform(F.array_distinct(votes), lambda v: F.struct(
        F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-v).alias("low"), v.alias("v")))
    return df.withColumn(out, F.array_max(tally)["v"].cast("int"))


def crowd_majority(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The label becomes the majority of the annotators."""
    return with_flag(majority(df, columns, "noisy_label"))


def _needed(df: DataFrame, rate: float):
    """Least number of flips whose share of all rows reaches ``rate``."""
    return df.agg(F.ceil(F.round(F.lit(rate) * F.count("*"), 9)).alias("_need")).scalar()


def _apply(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Write the chosen labels; ``moves`` is (id, _to)."""
    joined = df.join(moves, "id", "left")
    return with_flag(joined.withColumn("noisy_label", F.coalesce("_to", "label").cast("int"))).drop("_to")


def dissenting_label(df: DataFrame, columns: Sequence[str], rate: float, tag: str = "dissenting_label") -> DataFrame:
    """Rows in hash order whose annotators disagree take an annotator label other than their own, until the rate is met."""
    votes = F.array_sort(F.array_distinct(F.array(*columns)))
    options = F.array_except(votes, F.array("label"))
    pick = F.get(options, F.floor(rand.uniform(tag + "/pick", "id") * F.size(options)).cast("int"))
    eligible = df.filter(F.size(votes) > 1).select("id", pick.alias("_to"))
    moves = take_first(eligible, F.least(F.col("group_rows"), _needed(df, rate)), rand.hash32(tag, "id"), F.col("id"))
    return _apply(df, moves.select("id", "_to"))


def dissenting_worker(df: DataFrame, columns: Sequence[str], rate: float, tag: str = "dissenting_worker") -> DataFrame:
    """Workers in hash order; a row takes the label of the first worker who disagrees, until the rate is met.

    The sequential rule equals: rank every row by (its first dissenting worker, a hash keyed by that
    worker) and keep the first n.
    """
    workers = F.array(*[F.struct(rand.hash32(tag + "/worker", F.lit(i + 1)).alias("h"), F.lit(i + 1).alias("w"), F.col(c).alias("l"))
                        for i, c in enumerate(columns)])
    place = F.transform(F.array_sort(workers), lambda s, i: F.struct(i.alias("place"), s["w"].alias("w"), s["l"].alias("l")))
    dissent = F.filter(place, lambda s: s["l"] != F.col("label"))
    first = df.select("id", F.get(dissent, F.lit(0)).alias("_d")).filter(F.col("_d").isNotNull())
    order = F.col("_d.place").cast("long") * F.lit(1 << 32) + rand.hash32(tag, F.col("_d.w"), F.col("id"))
    moves = take_first(first, F.least(F.col("group_rows"), _needed(df, rate)), order, F.col("id"))
    return _apply(df, moves.select("id", F.col("_d.l").alias("_to")))
