"""Column expressions over series arrays (``array<double>``); null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once a row: inside a lambda an expression would be evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column, population: bool = True) -> Column:
    return let(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m)))) / (F.size(a) - (0 if population else 1))


def z_normalise(a: Column) -> Column:
    """Zero mean and unit population deviation; a constant series gives zeros."""
    return let(F.struct(mean(a).alias("m"), F.sqrt(variance(a)).alias("sd")), lambda p: F.transform(a, lambda x: F.when(p["sd"] > 0, (x - p["m"]) / p["sd"]).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), p))), 1 / p)


def complexity(a: Column) -> Column:
    """Complexity estimate of a series: root of the summed squared steps plus 0.001."""
    return F.sqrt(squared_euclidean(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1)) + 0.001)


def complexity_invariant(a: Column, b: Column) -> Column:
    """Euclidean distance times the larger complexity over the smaller (a single root of the squared sum)."""
    ca, cb = complexity(a), complexity(b)
    return F.sqrt(squared_euclidean(a, b)) * F.greatest(ca, cb) / F.least(ca, cb)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation (absolute error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Coefficients of the published approximation (Abramowitz and Stegun 26.2.17).
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def entropy(*counts: Column) -> Column:
    """Entropy in bits of a set of counts."""
    n = sum(counts[1:], counts[0])
    return sum((F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts[1:]), F.when(counts[0] > 0, -(counts[0] / n) * F.log2(counts[0] / n)).otherwise(0.0))


def multivariate_euclidean(a: Column, b: Column, dependent: bool = True) -> Column:
    """Over channels (``array<array<double>>``, one length): the root of all squares, or the sum of each time point's root."""
    squares = F.zip_with(a, b, squared_euclidean)
    if dependent:
        return F.sqrt(total(squares))
    points = F.sequence(F.lit(0), F.size(a[0]) - 1)
    at = lambda t: total(F.zip_with(a, b, lambda x, y: (F.get(x, t) - F.get(y, t)) * (F.get(x, t) - F.get(y, t))))
    return F.when(F.size(a[0]) > 0, total(F.transform(points, lambda t: F.sqrt(at(t))))).otherwise(0.0)
