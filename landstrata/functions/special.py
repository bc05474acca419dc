"""Scalar functions Spark SQL does not carry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation, g = 7, n = 9 (public numerical tables).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + c / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_softmax_pick(scores: Column, index: Column) -> Column:
    """Log-softmax of an array at a 0-based index."""
    m = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    return F.try_element_at(scores, index.cast("int") + 1) - m - F.ln(total)
