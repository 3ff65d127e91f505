"""Ranking methods over many runs: tie-averaged ranks, Friedman, signed-rank pairs, Holm, groups.

Input: one row per (block, method) with a value; a block is a run that all methods saw. Blocks may be
many, methods are few, so windows inside a block or over the method pairs stay small or are plain aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.session import materialised


def complete_groups(df: DataFrame, method: str = "method", by: Sequence[str] = ()) -> DataFrame:
    """Methods with the largest number of results."""
    counts = df.groupBy(*by, method).agg(F.count("*").alias("n"))
    if by:
        top = counts.groupBy(*by).agg(F.max("n").alias("_top"))
        return counts.join(F.broadcast(top), list(by)).filter("n = _top").drop("_top")
    return counts.filter(F.col("n") == counts.agg(F.max("n").alias("t")).scalar())


def average_rank(order, ties) -> Column:
    """Rank with ties averaged: first rank of the tie plus half its width."""
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def block_ranks(df: DataFrame, block: Sequence[str], value: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """Rank of every method inside its block, ties averaged."""
    key = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn(out, average_rank(W.partitionBy(*block).orderBy(key), W.partitionBy(*block, value)))


def average_ranks(df: DataFrame, block: Sequence[str], value: str, by: Sequence[str] = (), method: str = "method") -> DataFrame:
    """Per method: mean rank (1 is best), blocks, and how often it ranks exactly first."""
    r = block_ranks(df, [*by, *block], value)
    return r.groupBy(*by, method).agg(
        F.round(F.avg("rank"), 6).alias("average_rank"), F.count("*").alias("n_blocks"),
        F.sum((F.col("rank") == 1.0).cast("int")).alias("wins"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for a whole number of degrees of freedom, by the closed recursion in df."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    k, term, total = (2, math.exp(-h), math.exp(-h)) if df % 2 == 0 else (1, math.sqrt(h / math.pi) * 2 * math.exp(-h), math.erfc(math.sqrt(h)))
    if df % 2 == 0:
        while k < df:
            term *= h / (k / 2)
            total += term
            k += 2
        return total
    while k < df:
        total += term
        term *= h / ((k + 2) / 2)
        k += 2
    return total


def friedman(df: DataFrame, block: Sequence[str], value: str, by: Sequence[str] = (), method: str = "method", alpha: float = 0.05) -> DataFrame:
    """Friedman statistic with tie correction, its p-value, and whether it is significant."""
    # A tie of t methods adds t^3 - t, that is t^2 - 1 for each of its rows: ranks and ties come from one pass.
    r = block_ranks(df, [*by, *block], value, descending=False).withColumn("_t", F.count("*").over(W.partitionBy(*by, *block, value)))
    sums = r.groupBy(*by, method).agg(F.sum("rank").alias("_r"), F.count("*").alias("_n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_x"))
    both = sums.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.max("_n").alias("n_blocks"), F.count("*").alias("n_methods"), F.sum("_x").alias("_ties"))
    n, k = F.col("n_blocks").cast("double"), F.col("n_methods").cast("double")
    plain = F.lit(12.0) / (n * k * (k + 1)) * F.col("_rr") - F.lit(3.0) * n * (k + 1)
    correction = F.lit(1.0) - F.col("_ties") / (n * k * (k * k - 1))

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(a, int(b)) for a, b in zip(x, df)])

    stat = both.withColumn("statistic", plain / correction)
    stat = stat.withColumn("p_value", tail("statistic", (k - 1).cast("int")))
    return stat.select(*by, "n_methods", "n_blocks", F.round("statistic", 6).alias("statistic"), "p_value",
                       (F.col("p_value") < alpha).cast("int").alias("significant"))


def signed_rank_exact(t: float, n: int) -> float:
    """Two-sided p of the signed-rank statistic by counting sign patterns; no ties, no zeros."""
    ways = [1]
    for i in range(1, n + 1):
        longer = ways + [0] * i
        for s, w in enumerate(ways):
            longer[s + i] += w
        ways = longer
    return min(1.0, 2.0 * sum(ways[: int(t) + 1]) / 2.0 ** n)


def wilcoxon_pairs(df: DataFrame, block: Sequence[str], value: str, by: Sequence[str] = (), method: str = "method") -> DataFrame:
    """Signed-rank test for every pair of methods, paired by block, zeros ranked (Pratt).

    The pairs are formed inside a block, whose size is the number of methods.
    """
    keys = [*by, *block]
    cells = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(method).alias("m"), F.col(value).cast("double").alias("v")))).alias("_c"))
    pairs = cells.select(*keys, F.explode(F.flatten(F.transform("_c", lambda a, i: F.transform(
        F.filter("_c", lambda b, j: j > i),
        lambda b: F.struct(a["m"].alias("method_1"), b["m"].alias("method_2"), F.round(a["v"] - b["v"], 9).alias("d")))))).alias("_p")).select(*keys, "_p.*")
    g = [*by, "method_1", "method_2"]
    # Equal absolute differences share a rank: count them first, then rank the distinct ones.
    tied = pairs.groupBy(*g, F.abs("d").alias("a")).agg(
        F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("int")).alias("up"), F.sum((F.col("d") < 0).cast("int")).alias("down"))
    below = F.coalesce(F.sum("t").over(W.partitionBy(*g).orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = tied.withColumn("r", below + (F.col("t") + 1) / 2)
    nonzero = F.col("a") > 0
    agg = ranks.groupBy(*g).agg(
        F.sum("t").alias("n"), F.sum(F.when(~nonzero, F.col("t")).otherwise(0)).alias("n_zero"),
        F.sum(F.col("r") * F.col("up")).alias("r_plus"), F.sum(F.col("r") * F.col("down")).alias("r_minus"),
        F.sum(F.when(nonzero, F.col("t") * (F.col("t") * F.col("t") - 1)).otherwise(0)).alias("_ties"))
    n, z0 = F.col("n").cast("double"), F.col("n_zero").cast("double")
    mean = n * (n + 1) / 4 - z0 * (z0 + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - F.col("_ties") / 2) / 24
    t = F.least("r_plus", "r_minus")
    out = agg.withColumn("statistic", t).withColumn("z", F.when(var > 0, (F.col("statistic") - mean) / F.sqrt(var)).otherwise(F.lit(0.0)))

    @F.pandas_udf("double")
    def p_value(stat: pd.Series, z: pd.Series, n: pd.Series, zero: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([
            signed_rank_exact(s, int(m)) if m <= 50 and o == 0 and q == 0 else min(1.0, 2.0 * normal_tail(abs(v)))
            for s, v, m, o, q in zip(stat, z, n, zero, ties)])

    return out.select(*g, "n", "n_zero", "r_plus", "r_minus", "statistic", F.round("z", 6).alias("z"),
                      p_value("statistic", "z", "n", "n_zero", "_ties").alias("p_value"))


def holm(pairs: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Step-down correction: ascending p against alpha/(k-i), stopping at the first failure."""
    order = W.partitionBy(*by).orderBy("p_value", "method_1", "method_2")
    k = F.count("*").over(W.partitionBy(*by))
    step = pairs.withColumn("_i", F.row_number().over(order) - 1).withColumn("_ok", (F.col("p_value") <= F.lit(alpha) / (k - F.col("_i"))).cast("int"))
    return step.withColumn("significant", F.min("_ok").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_i", "_ok")


def indistinct_groups(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Maximal sets of methods no two of which differ significantly, single methods included, per slice.

    A set grows by one method a round, in a table of open sets: ``r`` is the set, ``p`` the methods that can still
    join it, ``x`` those that could but are in sets made elsewhere. Only methods that the best connected one (the
    pivot) is not alike to start a new set, so no set is made twice and none that another contains. Rounds are
    written to storage; there are as many as the largest set has methods, and one more.
    """
    both = F.array(F.struct(F.col("method_1").alias("a"), F.col("method_2").alias("b")), F.struct(F.col("method_2").alias("a"), F.col("method_1").alias("b")))
    ends = pairs.select(*by, "significant", F.explode(both).alias("_e"))
    near = ends.groupBy(*by, F.col("_e.a").alias("v")).agg(F.collect_list(F.when(F.col("significant") == 0, F.col("_e.b"))).alias("n"))
    graph = near.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("g"), F.array_sort(F.collect_list("v")).alias("p"))
    none = F.array().cast("array<string>")
    state = graph.select(*by, "g", none.alias("r"), "p", none.alias("x"))
    alike = lambda v: F.try_element_at("g", v)
    found = None
    while True:
        state = materialised(state, "groups")
        whole = state.filter((F.size("p") == 0) & (F.size("x") == 0) & (F.size("r") > 0)).select(*by, "r")
        found = whole if found is None else found.unionByName(whole)
        growing = state.filter(F.size("p") > 0)
        if growing.isEmpty():
            break
        pivot = F.array_max(F.transform(F.concat("p", "x"), lambda u: F.struct(F.size(F.array_intersect("p", alike(u))).alias("n"), u.alias("u"))))["u"]
        step = growing.withColumn("_u", pivot).withColumn("_t", F.array_except("p", alike(F.col("_u")))).select("*", F.posexplode("_t").alias("_i", "v"))
        before = F.slice("_t", F.lit(1), F.col("_i"))
        state = step.select(
            *by, "g", F.array_append("r", F.col("v")).alias("r"), F.array_intersect(F.array_except("p", before), alike(F.col("v"))).alias("p"),
            F.array_intersect(F.array_union("x", before), alike(F.col("v"))).alias("x"))
    return found.select(*by, F.array_join(F.array_sort("r"), ",").alias("methods"), F.size("r").cast("long").alias("size"))


def compare(df: DataFrame, block: Sequence[str], value: str, by: Sequence[str] = (), method: str = "method", alpha: float = 0.05) -> DataFrame:
    """The whole comparison per slice: (by, method_1, method_2, n, p_value, overall_p, significant).

    ``overall_p`` is the Friedman test of the slice. Pairs count as different only where that test is significant
    and the step-down correction of the slice's signed-rank tests says so.
    """
    df = materialised(df, "compared")
    overall = friedman(df, block, value, by, method, alpha).select(*by, F.col("p_value").alias("overall_p"), F.col("significant").alias("_open"))
    pairs = holm(wilcoxon_pairs(df, block, value, by, method), alpha, by)
    joined = pairs.join(overall, list(by), "left") if by else pairs.crossJoin(overall)  # without slices: one row
    return joined.select(*by, "method_1", "method_2", "n", "p_value", "overall_p", (F.col("significant") * F.coalesce("_open", F.lit(0))).alias("significant"))
