"""Distances between two array columns. Everything is summed in double, in array order; a null side gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences: no root is taken, so on unit vectors 0.6 stands for a cosine of 0.7."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    """Larger is nearer."""
    return _fold(a, b, lambda x, y: x * y)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Inner product over both norms; null if a norm is zero."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return inner_product(a, b) / F.nullif(norms, F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def lp(a: Column, b: Column, p: float) -> Column:
    """Sum of powers of differences; the root is left out, as with squared_l2."""
    return _fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))


def canberra(a: Column, b: Column) -> Column:
    """A pair of zeros adds nothing."""
    return _fold(a, b, lambda x, y: F.coalesce(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0)), F.lit(0.0)))


def bray_curtis(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y)) / F.nullif(_fold(a, b, lambda x, y: F.abs(x + y)), F.lit(0.0))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of vectors without negative entries; zeros add nothing to their own side."""
    side = lambda x, y: F.when(x > 0, x * F.log(x / ((x + y) / 2))).otherwise(0.0)
    return 0.5 * _fold(a, b, lambda x, y: side(x, y) + side(y, x))


def jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima, of vectors with positive entries: larger is nearer."""
    return _fold(a, b, lambda x, y: F.least(x, y)) / F.nullif(_fold(a, b, lambda x, y: F.greatest(x, y)), F.lit(0.0))


#: Metrics by name: the function, and whether larger is nearer.
METRICS: dict[str, tuple[Callable, bool]] = {
    "l2": (squared_l2, False), "inner_product": (inner_product, True), "l1": (l1, False), "linf": (linf, False), "lp": (lp, False), "canberra": (canberra, False),
    "bray_curtis": (bray_curtis, False), "jensen_shannon": (jensen_shannon, False), "jaccard": (jaccard, True), "cosine": (cosine_distance, False),
}
#: Numbers of the metrics in stored index descriptions.
METRIC_CODES = {"inner_product": 0, "l2": 1, "l1": 2, "linf": 3, "lp": 4, "canberra": 20, "bray_curtis": 21, "jensen_shannon": 22, "jaccard": 23}
