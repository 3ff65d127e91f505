"""Keyed random draws.

A draw is a function of a tag and the row id alone, so it does not depend on partitioning, survives
a recomputed task unchanged and can be repeated in any SQL engine that has ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash32(tag: str | Column, *ids: Column | str) -> Column:
    """First 32 bits of ``md5('<tag>:<id>[:<id>..]')`` as a long."""
    head = tag if isinstance(tag, Column) else F.lit(tag)
    parts = [head] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(tag: str | Column, *ids: Column | str) -> Column:
    """Uniform on [0, 1)."""
    return hash32(tag, *ids) / F.lit(TWO32)


def normal(tag: str, *ids: Column | str) -> Column:
    """Standard normal by the Box-Muller transform of two keyed uniforms."""
    u1 = (hash32(tag + "/1", *ids) + F.lit(1.0)) / F.lit(TWO32)
    u2 = uniform(tag + "/2", *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# Coefficients of Acklam's published rational approximation of the normal quantile.
ICDF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ICDF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)


def central_normal_quantile(p: Column) -> Column:
    """Normal quantile, valid for 0.02425 <= p <= 0.97575 (relative error below 1.2e-9)."""
    q = p - F.lit(0.5)
    r = q * q

    def horner(coefs, x):
        acc = F.lit(coefs[0])
        for c in coefs[1:]:
            acc = acc * x + F.lit(c)
        return acc

    return horner(ICDF_A, r) * q / (horner(ICDF_B, r) * r + F.lit(1.0))


def truncated_normal_above(p: float, scale: float, tag: str, *ids: Column | str, high: float = 1.0) -> Column:
    """Normal(p, scale) kept to [p, p + high*scale]: standardised bounds 0..high, inverted from a uniform."""
    top = 0.5 * (1.0 + math.erf(high / math.sqrt(2.0)))
    if top > 0.97575:
        raise ValueError("upper bound lies outside the range of the quantile approximation")
    u = F.lit(0.5) + uniform(tag, *ids) * F.lit(top - 0.5)
    return F.lit(p) + F.lit(scale) * central_normal_quantile(u)
