"""Neighbour label distributions, scores and flags; consensus counts and the transition they imply."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelq.functions import arrays
from labelq.functions.ordering import attach, quantile
from labelq.functions.rand import uniform
from labelq.operators.neighbours import Index, index
from labelq.operators.neighbours import knn as nearest_rows
from labelq.operators.noise import class_grid
from labelq.operators.sampling import class_counts, sample_rounds
from labelq.session import materialised

EPS = 1e-8
# Weight of the own loss in the score ``new``; diagonal and offset the transition solver starts from.
OWN_WEIGHT = 1.1
START_DIAGONAL, START_OFFSET = 5.0, -1.0
FEW = 100_000  # ids that are broadcast by hint once they are counted


def label_distribution(knn: DataFrame, n_classes: int, min_similarity: float = 0.45, norm: str = "l2") -> DataFrame:
    """(id, label, weights, confidence, distribution): similarity per class among the row and its neighbours.

    The row counts as its own neighbour at distance 2*d1 - d2. ``confidence`` sums the weights with the
    row at distance 0.
    """
    lists = knn.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr_label", "dist"))).alias("_n"))
    d1, d2 = F.get("_n", F.lit(0))["dist"], F.get("_n", F.lit(1))["dist"]
    base = F.lit(1.0 - min_similarity)
    own = base - (2.0 * d1 - d2)
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    weight = F.transform(classes, lambda c: F.aggregate(
        "_n", F.when(c == F.col("label"), own).otherwise(F.lit(0.0)),
        lambda s, n: s + F.when(n["nbr_label"] == c, base - n["dist"]).otherwise(F.lit(0.0))))
    w = lists.withColumn("weights", weight).withColumn(
        "confidence", base + F.aggregate("_n", F.lit(0.0), lambda s, n: s + base - n["dist"]))
    if norm == "l2":
        size = F.greatest(arrays.norm("weights"), F.lit(1e-12))
    elif norm == "l1":
        size = arrays.total("weights")
    else:
        raise ValueError(f"unknown norm {norm!r}")
    return w.withColumn("distribution", arrays.let(size, lambda s: F.transform("weights", lambda x: x / s))).drop("_n")


def scores(dist: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Add the scores ``ce``, ``cores``, ``avg``, ``new`` and, given (label, share), ``peer``."""
    loss = F.transform("distribution", lambda p: -F.log(p + EPS))
    d = dist.withColumn("_l", loss)
    own, mean = arrays.at("_l", "label"), arrays.total("_l") / F.size("_l")
    d = d.withColumn("ce", own).withColumn("cores", own - mean).withColumn("avg", -mean).withColumn("new", OWN_WEIGHT * own - mean)
    if prior is not None:
        row = prior.agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("p"))
        expect = arrays.total(F.transform("_l", lambda x, j: x * F.coalesce(F.try_element_at("_p", j), F.lit(0.0))))
        d = d.withColumn("_p", row.scalar()).withColumn("peer", own - expect).drop("_p")
    return d.drop("_l")


def majority_flags(dist: DataFrame) -> DataFrame:
    """(id, label_issue): the strongest class differs from the label."""
    return dist.select("id", (arrays.argmax("distribution") != F.col("label")).cast("int").alias("label_issue"))


def rank_fraction(posterior: Column, offset: float) -> Column:
    """Percentile position of a class's cut from P(true = c | noisy = c)."""
    rate = F.lit(1.0) - F.least(F.lit(offset) * posterior, F.lit(1.0))
    rate = F.when(rate >= 1.0, 0.95).when(rate <= 0.0, 0.05).otherwise(rate)
    return F.lit(1.0) - rate


def rank_flags(scored: DataFrame, posterior: DataFrame, offset: float = 2.5, score: str = "ce") -> DataFrame:
    """(id, label_issue): score at or above its class's cut; ``posterior`` is (label, keep)."""
    share = posterior.select("label", rank_fraction(F.col("keep"), offset).alias("fraction"))
    cuts = quantile(scored, score, share, ["label"], "_cut").select("label", "_cut")
    joined = attach(scored, cuts, ["label"])
    return joined.select("id", F.coalesce((F.col(score) >= F.col("_cut")).cast("int"), F.lit(0)).alias("label_issue"))


def both_flags(vote: DataFrame, rank: DataFrame) -> DataFrame:
    """Flagged by vote and by rank."""
    r = rank.select("id", F.col("label_issue").alias("_r"))
    return vote.join(r, "id").select("id", (F.col("label_issue") * F.col("_r")).alias("label_issue"))


def consensus_counts(df: DataFrame, sample: int | Column, rounds: int, tag: str = "consensus") -> DataFrame:
    """(l1, l2, l3, share): label of a row, its nearest and second nearest, averaged over samples.

    Every round draws exactly ``sample`` rows (all, if there are fewer) and searches inside the sample; all rounds
    are one search in groups, cut into blocks like any other. The samples are stored in these blocks only.
    """
    size = F.lit(sample) if isinstance(sample, int) else sample
    drawn = sample_rounds(df.select("id", "label", "features"), size, rounds, tag)
    found = nearest_rows(drawn, drawn, 2, query_group="round", data_group="round", keep_group=True)
    nearest = lambda r: F.max(F.when(F.col("rank") == r, F.col("nbr_label")))
    three = found.groupBy("grp", "id").agg(F.max("label").alias("l1"), nearest(1).alias("l2"), nearest(2).alias("l3"))
    counts = three.filter("l3 is not null").groupBy("grp", "l1", "l2", "l3").agg(F.count("*").alias("n"))
    # K^3 counts a round.
    counts = counts.withColumn("m", F.sum("n").over(W.partitionBy("grp")))
    return counts.groupBy("l1", "l2", "l3").agg((F.sum(F.col("n") / F.col("m")) / rounds).alias("share"))


def consensus_levels(p3: DataFrame) -> DataFrame:
    """The three grouping levels of the triple shares, as (level, l1, l2, l3, share)."""
    rolled = p3.rollup("l1", "l2", "l3").agg(F.sum("share").alias("share"), F.grouping_id().alias("_g"))
    return rolled.filter(F.col("l1").isNotNull()).select(
        F.when(F.col("_g") == 0, 3).when(F.col("_g") == 1, 2).otherwise(1).alias("level"), "l1", "l2", "l3", "share")


def predicted_consensus(t: DataFrame, p: DataFrame) -> DataFrame:
    """(l1, l2, l3, share): sum over the true class i of P_i T_ij T_ik T_il.

    ``t`` is (label, noisy_label, prob), ``p`` is (label, share); classes are few.
    """
    lists = t.groupBy("label").agg(F.collect_list(F.struct(F.col("noisy_label").alias("j"), F.col("prob").alias("q"))).alias("_t"))
    one = lists.join(F.broadcast(p), "label")
    for name in ("l1", "l2", "l3"):
        one = one.withColumn("_x", F.explode("_t")).withColumn(name, F.col("_x.j")).withColumn(f"_{name}", F.col("_x.q")).drop("_x")
    return one.groupBy("l1", "l2", "l3").agg(F.sum(F.col("share") * F.col("_l1") * F.col("_l2") * F.col("_l3")).alias("share"))


def posterior_true_given_noisy(t: DataFrame, p: DataFrame, prior: DataFrame) -> DataFrame:
    """(label, noisy_label, prob): T_ij * P_i / prior_j."""
    a = t.join(F.broadcast(p.select("label", F.col("share").alias("_p"))), "label")
    b = a.join(F.broadcast(prior.select(F.col("label").alias("noisy_label"), F.col("share").alias("_q"))), "noisy_label")
    return b.select("label", "noisy_label", (F.col("prob") * F.col("_p") / F.col("_q")).alias("prob"))


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def solve_transition(p3: np.ndarray, steps: int = 1000, rate: float = 0.1, start: tuple[np.ndarray, np.ndarray] | None = None):
    """Transition matrix and class shares whose implied consensus is closest to ``p3`` (K x K x K).

    Descent with moment estimates over row-softmax parameters; the loss is the sum of the norms of
    the differences at the three levels. Only K^3 numbers are involved.
    """
    k = p3.shape[0]
    seen = (p3.sum((1, 2)), p3.sum(2), p3)
    a, b = (START_DIAGONAL * np.eye(k) + START_OFFSET, np.zeros(k)) if start is None else (start[0].copy(), start[1].copy())
    moments = [np.zeros_like(a), np.zeros_like(a), np.zeros_like(b), np.zeros_like(b)]
    best = (np.inf, a, b)
    for step in range(1, steps + 1):
        t, p = _softmax(a, 1), _softmax(b, 0)
        made = (p @ t, np.einsum("i,ij,ik->jk", p, t, t), np.einsum("i,ij,ik,il->jkl", p, t, t, t))
        diff = [m - s for m, s in zip(made, seen)]
        size = [np.sqrt((d * d).sum()) for d in diff]
        if sum(size) < best[0]:
            best = (sum(size), a.copy(), b.copy())
        g1, g2, g3 = (d / max(s, 1e-12) for d, s in zip(diff, size))
        q2 = g2 + g2.T
        q3 = g3 + g3.transpose(1, 0, 2) + g3.transpose(2, 1, 0)
        gt = p[:, None] * (g1[None, :] + t @ q2.T + np.einsum("jkl,ik,il->ij", q3, t, t))
        gp = t @ g1 + np.einsum("jk,ij,ik->i", g2, t, t) + np.einsum("jkl,ij,ik,il->i", g3, t, t, t)
        ga = t * (gt - (gt * t).sum(1, keepdims=True))
        gb = p * (gp - (gp * p).sum())
        for i, (x, g) in enumerate(((a, ga), (b, gb))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return _softmax(best[1], 1), _softmax(best[2], 0), best[0], (best[1], best[2])


def estimate_transition(p3: DataFrame, n_classes: int, steps: int = 1000, rate: float = 0.1, start=None) -> tuple[DataFrame, DataFrame]:
    """(label, noisy_label, prob) and (label, share) estimated without knowing any true label."""
    spark: SparkSession = p3.sparkSession
    cube = np.zeros((n_classes,) * 3)
    for r in p3.collect():  # at most K^3 aggregated rows
        cube[r["l1"], r["l2"], r["l3"]] = r["share"]
    t, p, _, _ = solve_transition(cube, steps, rate, start)
    rows = [(i, j, float(t[i, j])) for i in range(n_classes) for j in range(n_classes)]
    return (spark.createDataFrame(rows, "label int, noisy_label int, prob double"),
            spark.createDataFrame([(i, float(p[i])) for i in range(n_classes)], "label int, share double"))


def cell_transitions(df: DataFrame, centres: DataFrame, n_classes: int) -> DataFrame:
    """(cell, label, noisy_label, prob): local transition mixed with the global one by the local class share.

    ``df`` has features, label and noisy_label; ``centres`` is (cell, features) with few rows. Every
    row belongs to its nearest centre.
    """
    few = centres.agg(F.array_sort(F.collect_list(F.struct("cell", F.col("features").alias("v")))).alias("c"))
    placed = df.withColumn("_c", few.scalar()).withColumn(
        "cell", F.array_min(F.transform("_c", lambda c: F.struct(F.round(arrays.distance(F.col("features"), c["v"]), 9).alias("d"), c["cell"].alias("cell"))))["cell"])
    counts = placed.groupBy("cell", "label", "noisy_label").agg(F.count("*").alias("n"))
    grid = class_grid(df, n_classes, ("label", "noisy_label"))
    cells = centres.select("cell")
    full = cells.withColumn("_k", F.explode(grid.agg(F.collect_list(F.struct("label", "noisy_label"))).scalar())).select("cell", "_k.*")
    full = full.join(counts, ["cell", "label", "noisy_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # The count table has cells x classes^2 rows; every margin is a window over it.
    over = lambda *keys: F.sum("n").over(W.partitionBy(*keys))
    m = full.select("*", over("cell", "label").alias("r"), over("cell").alias("c"), over("label", "noisy_label").alias("gn"), over("label").alias("gr"))
    local = F.when(F.col("r") > 0, F.col("n") / F.col("r")).otherwise(F.lit(0.0))
    share, average = F.col("r") / F.col("c"), F.when(F.col("gr") > 0, F.col("gn") / F.col("gr")).otherwise(F.lit(0.0))
    return m.select("cell", "label", "noisy_label", (share * local + (1 - share) * average).alias("prob"))


def cover(df: DataFrame, size: int, tag: str = "cover", packed: Index | None = None) -> DataFrame:
    """(cell, id): neighbourhoods of the ``size`` nearest rows (the centre is one) that together hold every row.

    ``cell`` is the centre's id. A round draws centres among the rows not yet held, by a keyed hash and twice as dense
    as in the round before, so after log2(size) rounds at most every row left is a centre of its own. A row can be in
    several cells; a cell has at most ``size`` rows. All rounds search one ``index`` of ``df``, the given one or its own.
    """
    data = df.select("id", "features", F.lit(0).alias("label"))
    packed = packed or index(data, size)
    if packed is None:
        data = materialised(data, "cover")
    left, held, r = None, None, 0
    while True:
        rate = min(1.0, 2.0**r / size)
        drawn = uniform(f"{tag}/{r}", "id") < rate
        centres = data.where(drawn)
        if left is not None:  # only ids of the rows left are stored, their vectors stay where they are
            chosen = materialised(left.where(drawn), "chosen")
            few = chosen.limit(FEW + 1).count() <= FEW
            centres = centres.join(F.broadcast(chosen) if few else chosen, "id", "left_semi")
        centres = materialised(centres, "centres")
        near = nearest_rows(centres, packed or data, size - 1).select(F.col("id").alias("cell"), F.col("nbr_id").alias("id"))
        cells = materialised(near.unionByName(centres.select(F.col("id").alias("cell"), "id")), "cells")
        held = cells if held is None else held.unionByName(cells)
        if rate >= 1.0:
            return held
        left = materialised((data.select("id") if left is None else left).join(cells.select("id").distinct(), "id", "left_anti"), "left")
        if left.isEmpty():
            return held
        r += 1


def cell_consensus(df: DataFrame, cells: DataFrame, packed: Index | None = None) -> DataFrame:
    """(cell, l1, l2, l3, n): label triples of a row and its two nearest rows, counted per cell in one pass.

    ``df`` is (id, features, label); the two nearest are sought among all rows, so a cell's edge has no other
    neighbours than its middle. ``packed`` is an ``index`` of ``df``.
    """
    found = nearest_rows(df, packed or df, 2)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("nbr_label")))
    three = found.groupBy("id").agg(F.max("label").alias("l1"), at(1).alias("l2"), at(2).alias("l3")).filter("l3 is not null")
    return cells.join(three, "id").groupBy("cell", "l1", "l2", "l3").agg(F.count("*").alias("n"))


def local_transitions(df: DataFrame, n_classes: int, size: int = 250, steps: int = 500, tag: str = "cover", cells: DataFrame | None = None) -> DataFrame:
    """(cell, label, noisy_label, n, share, local, prob): transitions estimated per neighbourhood, no true label known.

    Every cell of ``cover`` (or of the given (cell, id) table) has its own consensus tensor of K^3 numbers and is
    solved by a task of its own, from the global solution on. ``local`` is the cell's estimate, ``share`` its estimated
    share of the true class; ``prob`` mixes it with the global estimate, share * local + (1 - share) * global. Cells are
    as many as it takes; a task holds one tensor.
    """
    packed = index(df, max(size, 3))
    cells = cover(df, size, tag, packed) if cells is None else cells
    counts = materialised(cell_consensus(df, cells, packed), "consensus")
    total = counts.groupBy("l1", "l2", "l3").agg(F.sum("n").alias("n")).collect()  # at most K^3 rows
    cube = np.zeros((n_classes,) * 3)
    for r in total:
        cube[r["l1"], r["l2"], r["l3"]] = r["n"]
    whole, _, _, start = solve_transition(cube / max(cube.sum(), 1), 2 * steps)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros((n_classes,) * 3)
        own[rows["l1"], rows["l2"], rows["l3"]] = rows["n"]
        t, p, _, _ = solve_transition(own / own.sum(), steps, start=start)
        mixed = p[:, None] * t + (1 - p[:, None]) * whole
        i, j = (x.ravel() for x in np.indices(t.shape))
        return pd.DataFrame({"cell": rows["cell"].iloc[0], "label": i, "noisy_label": j, "n": int(own.sum()), "share": p[i], "local": t[i, j], "prob": mixed[i, j]})

    kind = dict(counts.dtypes)["cell"]
    return counts.groupBy("cell").applyInPandas(solve, f"cell {kind}, label int, noisy_label int, n long, share double, local double, prob double")


def detect(df: DataFrame, knn: DataFrame, n_classes: int, rounds: int = 10, sample: int | None = None, steps: int = 1000,
           min_similarity: float = 0.45, offset: float = 2.5, method: str = "both", tag: str = "consensus") -> DataFrame:
    """(id, label_issue) by neighbour vote (``mv``), class-wise rank (``rank``) or both.

    A round of the transition estimate draws a quarter of the rows, or ``sample`` rows if that is given and fewer.
    """
    dist = label_distribution(knn, n_classes, min_similarity)
    vote = majority_flags(dist)
    if method == "mv":
        return vote
    quarter = F.floor(F.col("group_rows") / 4)
    drawn = F.greatest(quarter if sample is None else F.least(F.lit(sample), quarter), F.lit(3))
    t, p = estimate_transition(consensus_counts(df, drawn, rounds, tag), n_classes, steps)
    keep = posterior_true_given_noisy(t, p, class_counts(df, "label")).filter("label = noisy_label").select("label", F.col("prob").alias("keep"))
    rank = rank_flags(scores(dist), keep, offset)
    return rank if method == "rank" else both_flags(vote, rank)

