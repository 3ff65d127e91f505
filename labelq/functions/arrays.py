"""Arithmetic on array columns; everything stays inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def total(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x * x)))


def unit(a) -> Column:
    """Vector scaled to length 1."""
    a = _col(a)
    return let(norm(a), lambda n: F.transform(a, lambda x: x / n))


def shares(a) -> Column:
    """Elements divided by their sum."""
    a = _col(a)
    return let(total(a), lambda s: F.transform(a, lambda x: x / s))


def softmax(a) -> Column:
    """Probabilities from logits, shifted by the maximum."""
    a = _col(a)
    return let(let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))), shares)


def argmax(a) -> Column:
    """0-based index of the greatest element; the first wins ties."""
    a = _col(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def at(a, i) -> Column:
    """Element at 0-based index ``i``."""
    return F.element_at(_col(a), (_col(i) + F.lit(1)).cast("int"))


def others(a, i) -> Column:
    """Array without the element at 0-based index ``i``."""
    i = _col(i)
    return F.filter(_col(a), lambda x, j: j != i)


def distance(a, b, metric: str = "euclidean") -> Column:
    """``cosine`` (1 - cos), ``euclidean``, ``sqeuclidean`` or ``cityblock`` distance of two vectors."""
    a, b = _col(a), _col(b)
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "cityblock":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    square = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "sqeuclidean":
        return square
    if metric == "euclidean":
        return F.sqrt(square)
    raise ValueError(f"unknown metric {metric!r}")
