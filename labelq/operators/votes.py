"""Combining several issue flags into one probability per row.

Both voters first count the distinct flag patterns (at most 2^flags rows, whatever the table size);
the model is fitted on those counts and joined back to the rows by pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FLAGS = 16


def pattern(flags: Sequence[str]) -> Column:
    """The flags as one integer, first flag in the lowest bit; a missing flag counts as 0."""
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out + F.coalesce(F.col(f), F.lit(0)).cast("int") * (1 << i)
    return out


def majority_vote(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Add ``share`` of raised flags and ``label_issue`` when more than half are raised."""
    raised = sum((F.coalesce(F.col(f), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(0)))
    return df.withColumn("share", raised / len(flags)).withColumn("label_issue", (raised * 2 > len(flags)).cast("int"))


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, prior: float, steps: int = 500, tol: float = 1e-10):
    """EM for conditionally independent flags with a fixed share of issues.

    ``patterns`` is (P, F) of 0/1, ``counts`` its weights. Returns P(flag | clean), P(flag | issue),
    and the posterior of an issue per pattern.
    """
    share = (patterns * counts[:, None]).sum(0) / counts.sum()
    clean, issue = np.clip(share * 0.5, 1e-3, 0.999), np.clip(share * 0.5 + 0.5, 1e-3, 0.999)
    post = np.zeros(len(counts))
    for _ in range(steps):
        log1 = np.log(prior) + patterns @ np.log(issue) + (1 - patterns) @ np.log1p(-issue)
        log0 = np.log1p(-prior) + patterns @ np.log(clean) + (1 - patterns) @ np.log1p(-clean)
        new = 1.0 / (1.0 + np.exp(log0 - log1))
        w1, w0 = counts * new, counts * (1 - new)
        issue = np.clip((patterns * w1[:, None]).sum(0) / max(w1.sum(), 1e-12), 1e-6, 1 - 1e-6)
        clean = np.clip((patterns * w0[:, None]).sum(0) / max(w0.sum(), 1e-12), 1e-6, 1 - 1e-6)
        if np.abs(new - post).max() < tol:
            post = new
            break
        post = new
    return clean, issue, post


def vote_model(df: DataFrame, flags: Sequence[str], prior: float = 0.1) -> DataFrame:
    """Add ``probability`` of a label issue under the fitted model."""
    if len(flags) > MAX_FLAGS:
        raise ValueError(f"at most {MAX_FLAGS} flags")
    counted = df.groupBy(pattern(flags).alias("_p")).agg(F.count("*").alias("n")).collect()
    codes = np.array([r["_p"] for r in counted], dtype=np.int64)
    counts = np.array([r["n"] for r in counted], dtype=float)
    bits = (codes[:, None] >> np.arange(len(flags))) & 1
    _, _, post = fit_accuracies(bits.astype(float), counts, prior)
    table = df.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "_p int, probability double")
    return df.withColumn("_p", pattern(flags).cast("int")).join(F.broadcast(table), "_p").drop("_p")


def top_suspicious(df: DataFrame, k: int, score: str = "probability") -> DataFrame:
    """The k rows most likely mislabelled."""
    return df.orderBy(F.col(score).desc(), "id").limit(k)
