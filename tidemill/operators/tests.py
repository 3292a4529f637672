"""Statistical tests and power transforms as aggregates and rank windows.

Ranks count equal values first, so a window sorts distinct values only. Normal probabilities come from a rational
approximation (below 1e-7 off).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import normal_cdf
from .ordered import ranges_for, running_sums, written


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def tied_ranks(counts: DataFrame, value: str, n: str = "n", by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``rank``, the average rank of each distinct value; counts: one row a value with how often it occurs."""
    r = running_sums(counts, value, [n], by, parts=parts)
    return r.withColumn("rank", F.col(f"{n}_upto") - (F.col(n) - 1) / 2).drop(f"{n}_upto")


def one_sample_t(df: DataFrame, column: str, h0: float = 0.0) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), ((F.avg(column) - h0) / F.sqrt(F.var_samp(column) / F.count(column))).alias("t"))


def sign_test(df: DataFrame, column: str, h0: float = 0.0) -> DataFrame:
    """Counts above and below with ties shared, and the normal two-sided p-value."""
    x = F.col(column)
    s = df.where(x.isNotNull()).agg(F.count("*").alias("n"), (F.count_if(x > h0) + F.count_if(x == h0) / 2).alias("above"), (F.count_if(x < h0) + F.count_if(x == h0) / 2).alias("below"))
    return s.withColumn("z", (F.greatest("above", "below") - F.col("n") / 2) / F.sqrt(F.col("n") / 4)).withColumn("p", two_sided(F.col("z")))


def signed_rank(df: DataFrame, difference: Column) -> DataFrame:
    """Wilcoxon signed rank: zero differences dropped, larger rank sum, normal approximation."""
    d = df.select(difference.alias("d")).where("d <> 0")
    c = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    r = tied_ranks(c, "a")
    s = r.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"))
    n = F.col("n")
    return s.withColumn("z", (F.greatest("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).withColumn("p", two_sided(F.col("z")))


def two_sample_t(df: DataFrame, sample: str, value: str, a, b) -> DataFrame:
    """Unequal variances; degrees of freedom after Welch."""
    x, y = F.when(F.col(sample) == a, F.col(value)), F.when(F.col(sample) == b, F.col(value))
    s = df.agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return s.select("n1", "n2", "m1", "m2", ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("t"), ((e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))).alias("df"))


def mann_whitney(df: DataFrame, sample: str, value: str, a, b) -> DataFrame:
    """U of the first sample, rank sum, z and two-sided p (normal)."""
    c = df.where(F.col(sample).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.count_if(F.col(sample) == a).alias("k"))
    s = tied_ranks(c, value).agg(F.sum("k").alias("n1"), (F.sum("n") - F.sum("k")).alias("n2"), F.sum(F.col("rank") * F.col("k")).alias("rank_sum"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    return s.withColumn("u", u).withColumn("z", (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).withColumn("p", two_sided(F.col("z")))


def kruskal_wallis(df: DataFrame, sample: str, value: str) -> DataFrame:
    """H and H corrected for ties over k samples."""
    known = df.where(F.col(value).isNotNull() & F.col(sample).isNotNull())
    c = written(known.groupBy(value, sample).agg(F.count("*").alias("k")), "samples")
    counts = c.groupBy(value).agg(F.sum("k").alias("n"))
    r = tied_ranks(counts, value, parts=ranges_for(c))
    t = counts.agg(F.sum("n").alias("all"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    g = c.join(r.select(value, "rank"), value).groupBy(sample).agg(F.sum("k").alias("m"), F.sum(F.col("rank") * F.col("k")).alias("r"))
    n = F.col("all")
    h = g.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.count("*").alias("groups")).join(F.broadcast(t)).withColumn("h", 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1))
    return h.select("groups", "h", (F.col("h") / (1 - F.col("ties") / (n * n * n - n))).alias("h_corrected"))


def runs_test(df: DataFrame, order: list[str], value: str, by: list[str]) -> DataFrame:
    """Runs of equal sign in a stated order inside each group, against their expectation."""
    s = F.signum(value)
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.where(F.col(value) != 0).withColumn("new", (F.lag(s).over(w).isNull() | (F.lag(s).over(w) != s)).cast("int"))
    g = d.groupBy(*by).agg(F.sum("new").alias("runs"), F.count_if(F.col(value) > 0).alias("n1"), F.count_if(F.col(value) < 0).alias("n2"))
    return g.withColumn("expected", 2 * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) + 1)


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Largest gap between the empirical distribution and the fitted normal's."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(column).alias("t"))
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    e = running_sums(c, "x", ["n"]).withColumnRenamed("n_upto", "upto").join(F.broadcast(m)).withColumn("f", normal_cdf((F.col("x") - F.col("m")) / F.col("s")))
    return e.agg(F.max(F.greatest(F.abs(F.col("upto") / F.col("t") - F.col("f")), F.abs((F.col("upto") - F.col("n")) / F.col("t") - F.col("f")))).alias("d"))


def box_cox(x: Column, power: float) -> Column:
    return F.log(x) if power == 0 else (F.pow(x, power) - 1) / power


def box_cox_inverse(y: Column, power: float) -> Column:
    return F.exp(y) if power == 0 else F.pow(y * power + 1, 1 / power)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log(x + 1) if power == 0 else (F.pow(x + 1, power) - 1) / power
    down = -F.log(1 - x) if power == 2 else -(F.pow(1 - x, 2 - power) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, power: float) -> Column:
    up = F.exp(y) - 1 if power == 0 else F.pow(y * power + 1, 1 / power) - 1
    down = 1 - F.exp(-y) if power == 2 else 1 - F.pow(1 - (2 - power) * y, 1 / (2 - power))
    return F.when(y >= 0, up).otherwise(down)


def best_power(df: DataFrame, x: str, y: str, low: float = -3.0, high: float = 3.0, step: float = 0.25) -> DataFrame:
    """(power, r2) of the transform of y that is most linear in x, over a grid in one pass."""
    grid = [low + i * step for i in range(int(round((high - low) / step)) + 1)]
    r = df.where(F.col(y) > 0).agg(*(F.pow(F.corr(box_cox(F.col(y), p), F.col(x)), 2).alias(f"p{i}") for i, p in enumerate(grid)))
    long = r.unpivot([], r.columns, "i", "r2").withColumn("power", F.lit(low) + F.substring("i", 2, 9).cast("int") * step)
    return long.orderBy(F.desc("r2"), "power").limit(1).select("power", "r2")


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, explained and residual sums of squares of a line, in one pass."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)).alias("ssr"), (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)).alias("sse"))


def response(y: Column, kind: str) -> Column:
    """exp, log or reciprocal of a response."""
    return {"exp": F.exp(y), "log": F.log(y), "reciprocal": 1 / y}[kind]


def inverse_response(y: Column, kind: str) -> Column:
    return {"exp": F.log(y), "log": F.exp(y), "reciprocal": 1 / y}[kind]


def stepwise(df: DataFrame, columns: list[str], target: str, least_gain: float = 0.01) -> list[dict]:
    """Forward steps of least squares: the column that raises R squared most, while it raises it by ``least_gain``; then columns whose loss is under it go.

    One pass gathers the cross-products of all columns; every candidate fit is a small solve on them.
    """
    from .columns import gram_matrix

    _, _, g = gram_matrix(df, [*columns, target])
    total = g[-1, -1]

    def r2(chosen: list[int]) -> float:
        if not chosen or total <= 0:
            return 0.0
        x, xy = g[np.ix_(chosen, chosen)], g[chosen, -1]
        return float(xy @ np.linalg.lstsq(x, xy, rcond=None)[0] / total)

    chosen: list[int] = []
    steps = []
    while rest := [i for i in range(len(columns)) if i not in chosen]:
        now = r2(chosen)
        best = max(rest, key=lambda i: (round(r2([*chosen, i]), 12), -i))
        if r2([*chosen, best]) - now < least_gain:
            break
        chosen.append(best)
        steps.append({"column": columns[best], "r2": r2(chosen)})
        for i in list(chosen[:-1]):
            without = [j for j in chosen if j != i]
            if r2(chosen) - r2(without) < least_gain / 2:
                chosen = without
    return steps
