"""Estimators as aggregates: counts, normals, kernels, histograms, Poisson."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_quantiles


def discrete(df: DataFrame, column: str, given: str | None = None, laplace: float = 1.0) -> DataFrame:
    """(given, value, p): counts with a prior of ``laplace`` for each value seen."""
    keys = [given] if given else []
    known = df.where(F.col(column).isNotNull())
    c = known.groupBy(*keys, column).agg(F.count("*").alias("n"))
    d = known.select(F.count_distinct(column).alias("d"))
    return c.join(F.broadcast(d)).withColumn("p", (F.col("n") + laplace) / (F.sum("n").over(Window.partitionBy(*keys)) + laplace * F.col("d"))).drop("d")


def normal(df: DataFrame, columns: list[str], by: list[str] | None = None, least_sd: float = 1e-6) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_samp(c), F.lit(least_sd)).alias(f"{c}_sd"))))


def normal_log_density(x: Column, mean: Column, sd: Column) -> Column:
    return -F.pow((x - mean) / sd, 2) / 2 - F.log(sd) - 0.5 * math.log(2 * math.pi)


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, cov) of all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = df.agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return r.unpivot([], r.columns, "k", "cov").select(F.split("k", r"\|")[0].alias("a"), F.split("k", r"\|")[1].alias("b"), "cov")


def kernel_density(df: DataFrame, column: str, at: list[float], width: float | None = None) -> DataFrame:
    """(x, density) at stated points: a sum of normals, width range/sqrt(n)."""
    known = df.where(F.col(column).isNotNull())
    r = known.agg(F.count("*").alias("n"), (F.max(column) - F.min(column)).alias("range")).first()
    h = width or (float(r.range) / math.sqrt(r.n) or 1e-6)
    one = lambda x: F.sum(F.exp(-F.pow((F.lit(x) - F.col(column)) / h, 2) / 2)) / (r.n * h * math.sqrt(2 * math.pi))
    s = known.agg(*(one(x).alias(str(i)) for i, x in enumerate(at)))
    points = F.create_map(*(y for i, x in enumerate(at) for y in (F.lit(str(i)), F.lit(float(x)))))
    return s.unpivot([], s.columns, "i", "density").select(points[F.col("i")].alias("x"), "density")


def histogram_quantiles(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high) of equal weight, exact quantiles."""
    q = exact_quantiles(df, column, [i / bins for i in range(bins + 1)])
    return df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, q[1:], strict=False))], "bin int, low double, high double")


def poisson(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(column).alias("rate"))


def poisson_log_mass(k: Column, rate: Column) -> Column:
    return k * F.log(rate) - rate - F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def mahalanobis(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``distance``: the squared Mahalanobis distance to the mean under the sample covariance."""
    from .columns import gram_matrix

    n, mean, g = gram_matrix(df, columns)
    inverse = np.linalg.pinv(g / max(1, n - 1))
    gaps = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    terms = [gaps[i] * gaps[j] * float(inverse[i, j]) for i in range(len(columns)) for j in range(len(columns))]
    return df.withColumn("distance", sum(terms[1:], terms[0]))


def residual_intervals(df: DataFrame, actual: str, predicted: str, bucket: str, share: float) -> DataFrame:
    """(bucket, low, high): offsets that hold ``share`` of the residuals of each bucket of predictions (exact quantiles of a bucket)."""
    edge = (1 - share) / 2
    r = df.select(bucket, (F.col(actual) - F.col(predicted)).alias("r"))
    return r.groupBy(bucket).agg(F.percentile("r", F.lit(edge)).alias("low"), F.percentile("r", F.lit(1 - edge)).alias("high"))
