"""Column transforms: expressions, some after a fit that brings only statistics or cut points to the driver."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import at_positions, next_values, running_sums, value_counts
from .sampling import seeded
from .table import add_id


def arithmetic(df: DataFrame, expression: str, out: str = "expression") -> DataFrame:
    """A formula over ``aN`` (column N from 1), with + - * / ^, log abs cos exp sqrt floor ceil rint tan sin."""
    powered = re.sub(r"(\w+|\([^()]*\))\s*\^\s*(\w+|\([^()]*\))", r"power(\1, \2)", expression)
    return df.withColumn(out, F.expr(re.sub(r"\ba(\d+)\b", lambda m: f"`{df.columns[int(m[1]) - 1]}`", powered)))


UNARY = {n: getattr(F, n) for n in ("abs", "ceil", "floor", "rint", "exp", "log", "sqrt", "sin", "cos", "tan", "degrees", "radians")}


def apply_unary(df: DataFrame, columns: list[str], function: str) -> DataFrame:
    return df.withColumns({c: UNARY[function](F.col(c)) for c in columns})


class Standardizer:
    """Fit once, apply later: mean and deviation, or minimum and range, of each column."""

    def __init__(self, columns: list[str], mode: str = "standardize", scale: float = 1.0, translation: float = 0.0):
        self.columns, self.mode, self.scale, self.translation = columns, mode, scale, translation

    def fit(self, df: DataFrame) -> Standardizer:
        self.stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("avg", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max)))).first()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            avg, sd, low, high = (self.stats[f"{n}_{c}"] for n in ("avg", "sd", "min", "max"))
            x = F.col(c)
            if self.mode == "center":
                out[c] = x - F.lit(avg)
            elif self.mode == "standardize":
                out[c] = (x - F.lit(avg)) / F.lit(sd) if sd else x - F.lit(avg)
            else:
                out[c] = (x - F.lit(low)) / F.lit(float(high - low)) * self.scale + self.translation if low is not None and high > low else F.when(x.isNotNull(), 0.0)
        return df.withColumns(out)


def normalise_row(a: Column, p: float = 2.0, norm: float = 1.0) -> Column:
    length = F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), p)), 1 / p)
    return F.when(length > 0, F.transform(a, lambda x: x / length * norm)).otherwise(a)


def bin_of(x: Column, cuts: list[float]) -> Column:
    """0 below or at the first cut, and so on: the number of cuts under x. Many cuts are an array searched by halves, not a chain of conditions."""
    if len(cuts) <= 32:
        return F.when(x.isNotNull(), sum((F.when(x > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    at = F.lit([float(c) for c in sorted(cuts)])
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        over = x.cast("double") > F.get(at, mid)
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & over, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~over, mid).otherwise(s["high"]).alias("high"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), halve, lambda s: s["low"])
    return F.when(x.isNotNull(), found)


def equal_width_cuts(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    r = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
    return [] if r.a is None or r.a == r.b else [r.a + (r.b - r.a) / bins * i for i in range(1, bins)]


def equal_frequency_cuts(df: DataFrame, column: str, bins: int | None = 10) -> list[float]:
    """Cut points of about equal weight, midway between neighbouring distinct values, the nearer break chosen and the
    target computed anew from what remains after each cut; ``bins=None`` takes the root of the row count.

    The distinct values keep their running counts in Spark; every cut asks for the values next to its target alone.
    """
    counts = next_values(running_sums(value_counts(df, column), column, ["n"]), column).select(F.col(column).cast("double").alias("v"), F.col("next").cast("double").alias("next"), "n", F.col("n_upto").alias("upto")).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        bins, cuts, base = bins or int(total**0.5), [], 0
        while len(cuts) < bins - 1:
            target = (total - base) / (bins - len(cuts))
            inside = counts.where(F.col("next").isNotNull() & (F.col("upto") > base))
            side = F.when(F.col("upto") - base >= target, F.struct(F.lit(1).alias("s"), F.col("upto").alias("k"))).otherwise(F.struct(F.lit(0).alias("s"), (-F.col("upto")).alias("k")))
            near = inside.groupBy(side["s"].alias("s")).agg(F.min_by(F.struct("v", "next", "upto"), side["k"]).alias("x")).collect()
            near = {r.s: r.x for r in near}
            if 1 not in near:
                break
            at, low = near[1], near.get(0)
            if low is not None and target - (low.upto - base) < at.upto - base - target:
                at = low
            cuts.append((at.v + at.next) / 2)
            base = at.upto
        return cuts
    finally:
        counts.unpersist()


def mdl_cuts(df: DataFrame, column: str, label: str, kononenko: bool = False) -> list[float]:
    """Fayyad-Irani cuts: best entropy split of each segment, kept while the gain passes the MDL criterion (or Kononenko's).

    Class counts of distinct values are summed up once in Spark. Each round scores every cut of all open segments in one job,
    as differences of those sums, and only a segment's best cut comes to the driver.
    """
    known = df.where(F.col(column).isNotNull() & F.col(label).isNotNull())
    classes = [r[0] for r in known.select(label).distinct().orderBy(label).collect()]
    names = [f"c{i}" for i in range(len(classes))]
    each = known.groupBy(F.col(column).cast("double").alias("v")).agg(*(F.count_if(F.col(label) == c).alias(n) for c, n in zip(classes, names, strict=True)), F.lit(1).alias("d"))
    table = next_values(running_sums(each, "v", [*names, "d"]), "v").select("v", "next", F.col("d_upto").alias("d"), F.array(*(F.col(f"{n}_upto").cast("double") for n in names)).alias("c")).persist()
    try:
        top = table.orderBy(F.desc("v")).first()
        if top is None:
            return []
        #: open segments: (values before, class counts before, values with its own, class counts with its own)
        open_, cuts = [(0, [0.0] * len(names), top.d, list(top.c))], []
        while open_:
            segments = df.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(open_)], "seg int, d0 long, c0 array<double>, d1 long, c1 array<double>")
            x = table.where("next is not null").join(F.broadcast(segments), (F.col("d") > F.col("d0")) & (F.col("d") < F.col("d1")))
            gap = lambda a, b: F.zip_with(a, b, lambda u, v: u - v)
            total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
            bits = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log2(v)).otherwise(0.0))
            split = x.select("seg", "v", "next", "d", "c", gap(F.col("c"), F.col("c0")).alias("a"), gap(F.col("c1"), F.col("c")).alias("b"))
            na, nb = total("a"), total("b")
            cost = bits("a") + na * F.log2(na) + bits("b") + nb * F.log2(nb)
            best = split.groupBy("seg").agg(F.min_by(F.struct("v", "next", "d", "c", "a", "b"), F.struct(F.round(cost, 9), "v")).alias("x")).collect()
            later = []
            for r in best:
                d0, c0, d1, c1 = open_[r.seg]
                if _split_pays(np.array(r.x.a), np.array(r.x.b), d1 - d0 - 1, kononenko):
                    cuts.append((r.x.v + r.x.next) / 2)
                    later += [s for s in ((d0, c0, r.x.d, list(r.x.c)), (r.x.d, list(r.x.c), d1, c1)) if s[2] - s[0] > 1]
            open_ = later
        return sorted(cuts)
    finally:
        table.unpersist()


def _bits(x: np.ndarray) -> float:
    p = x[x > 0] / x.sum() if x.sum() else x[:0]
    return float(-(p * np.log2(p)).sum())


def _split_pays(before: np.ndarray, after: np.ndarray, candidates: int, kononenko: bool) -> bool:
    """Whether the class counts on both sides of a cut pass the stopping rule; ``candidates``: how many cuts the segment has."""
    whole = before + after
    n, k = whole.sum(), int((whole > 0).sum())
    if kononenko:
        choose = lambda m, c: math.lgamma(m + c) - math.lgamma(c) - math.lgamma(m + 1)
        many = lambda x: (math.lgamma(x.sum() + 1) - sum(math.lgamma(v + 1) for v in x)) / math.log(2) + choose(x.sum(), k) / math.log(2)
        return many(whole) > math.log2(max(candidates, 1)) + many(before) + many(after)
    gain = _bits(whole) - (before.sum() * _bits(before) + after.sum() * _bits(after)) / n
    k1, k2 = int((before > 0).sum()), int((after > 0).sum())
    delta = math.log2(3.0**k - 2) - (k * _bits(whole) - k1 * _bits(before) - k2 * _bits(after))
    return gain > (math.log2(max(candidates, 1)) + delta) / n


def one_hot(df: DataFrame, column: str, labels: list[str] | None = None) -> DataFrame:
    labels = labels or [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.withColumns({f"{column}={v}": F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("int")) for v in labels})


def supervised_one_hot(df: DataFrame, column: str, target: str) -> DataFrame:
    """k-1 cumulative indicators, labels ordered by the mean of a numeric class."""
    order = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("m")).orderBy("m", column).collect()]
    return df.withColumns({f"{column}>{i}": F.col(column).isin(*order[i:]).cast("int") for i in range(1, len(order))})


def to_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), (F.col(c) != 0).cast("int")) for c in columns})


def indicator(df: DataFrame, column: str, labels: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.col(column).isin(*labels).cast("int")))


def merge_labels(df: DataFrame, column: str, labels: list[str], to: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(*labels), F.lit(to)).otherwise(F.col(column)))


def merge_infrequent(df: DataFrame, column: str, least: int, to: str = "other") -> DataFrame:
    rare = df.groupBy(column).count().where(F.col("count") < least).select(F.col(column).alias("__rare"))
    return df.join(rare, F.col(column) == F.col("__rare"), "left").withColumn(column, F.when(F.col("__rare").isNotNull(), F.lit(to)).otherwise(F.col(column))).drop("__rare")


def impute(df: DataFrame, numeric: list[str], nominal: list[str] | None = None) -> DataFrame:
    """Null to the mean or to the most frequent label (smallest on ties), found in one pass each."""
    r = df.agg(*(F.avg(c).alias(c) for c in numeric)).first() if numeric else {}
    fill = {c: r[c] for c in numeric if r[c] is not None}
    for c in nominal or []:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        if top:
            fill[c] = top[0]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def impute_constant(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def impute_neighbours(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Long form: a missing point becomes the mean of the last known before and the first known after it."""
    w = Window.partitionBy(series).orderBy(t)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(F.col(value), (before + after) / 2, before, after))


def clean_numbers(x: Column, low: float, low_default: float, high: float, high_default: float, close_to: float | None = None, close_default: float = 0.0, decimals: int | None = None) -> Column:
    c = F.when(x < low, low_default).when(x > high, high_default)
    c = c.when(F.abs(x - close_to) <= 1e-6, close_default) if close_to is not None else c
    c = c.otherwise(x)
    return F.round(c, decimals) if decimals is not None else c


def quartiles(df: DataFrame, column: str, id_col: str) -> tuple[float, float]:
    """First and third quartile at whole positions of the sorted values: n/2 halved, the mean of two where the half is even."""
    known = df.where(F.col(column).isNotNull())
    n = known.count()
    half = n // 2
    quarter = half // 2
    wanted = {quarter, n - quarter - 1} if half % 2 else {quarter - 1, quarter, n - quarter, n - quarter - 1}
    got = at_positions(known, column, sorted(wanted))
    if half % 2:
        return got[quarter], got[n - quarter - 1]
    return (got[quarter - 1] + got[quarter]) / 2, (got[n - quarter - 1] + got[n - quarter]) / 2


def outlier_flags(x: Column, q1: float, q3: float, outlier: float = 3.0, extreme: float = 6.0) -> tuple[Column, Column]:
    iqr = q3 - q1
    ext = (x > q3 + extreme * iqr) | (x < q1 - extreme * iqr)
    return ((x > q3 + outlier * iqr) | (x < q1 - outlier * iqr)) & ~ext, ext


def obfuscate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Labels become V1, V2, ... in sorted order and columns A1, A2, ...; the dictionary is joined, not collected."""
    out = df
    for i, c in enumerate(columns, 1):
        names = add_id(df.where(F.col(c).isNotNull()).select(F.col(c).alias("__k")).distinct(), ["__k"], "__n").select("__k", F.concat(F.lit("V"), "__n").alias(f"A{i}"))
        out = out.join(names, out[c] == names["__k"], "left").drop("__k", c)
    return out


def label_noise(df: DataFrame, column: str, percent: float, id_col: str, seed: int = 1) -> DataFrame:
    """Change the label of about ``percent`` of the rows to another one, chosen by a hash of the id and the seed."""
    labels = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
    known = F.array(*map(F.lit, labels))
    u = F.pmod(seeded(seed, id_col), F.lit(10_000)) / 100.0
    others = F.array_remove(known, F.col(column))
    pick = F.element_at(others, (F.pmod(seeded(seed + 1, id_col), F.lit(max(1, len(labels) - 1))) + 1).cast("int"))
    return df.withColumn(column, F.when((u < percent) & F.col(column).isNotNull() & F.lit(len(labels) > 1), pick).otherwise(F.col(column)))


def projection_matrix(dims: int, size: int, seed: int = 42, kind: str = "sparse1") -> np.ndarray:
    rng = np.random.default_rng(seed)
    return {"sparse1": lambda: rng.choice([-(3**0.5), 0.0, 3**0.5], (dims, size), p=[1 / 6, 2 / 3, 1 / 6]), "sparse2": lambda: rng.choice([-1.0, 1.0], (dims, size)), "gaussian": lambda: rng.normal(size=(dims, size))}[kind]()


def random_projection(a: Column, dims: int, size: int, seed: int = 42, kind: str = "sparse1") -> Column:
    """Project an array of ``size`` numbers to ``dims``: sqrt(3)*{-1,0,1}, {-1,1} or normal entries."""
    m = projection_matrix(dims, size, seed, kind)
    return F.array(*(F.aggregate(F.zip_with(a, F.array(*map(F.lit, row.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in m))


def principal_components(df: DataFrame, columns: list[str], share: float = 0.95, standardise: bool = True, most: int | None = None) -> DataFrame:
    """``df`` with ``components array<double>``: as many as reach a share of the variance."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df)
    x = StandardScaler(withMean=True, withStd=standardise, inputCol="__x", outputCol="__z").fit(x).transform(x)
    model = PCA(k=most or len(columns), inputCol="__z", outputCol="__c").fit(x)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share - 1e-12) + 1)
    return model.transform(x).withColumn("components", F.slice(vector_to_array("__c"), 1, min(k, len(columns)))).drop("__x", "__z", "__c")


def label_list(df: DataFrame, column: str, by: str = "name") -> list:
    """The distinct labels of a nominal column (few by nature), by name or by falling count."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in c.orderBy(*([F.desc("count"), column] if by == "count" else [column])).collect()]


def label_place(x: Column, labels: list) -> Column:
    """The place from 0 of a label in the list; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), x).cast("int"), F.lit(0)) - 1


def nominal_to_numeric(df: DataFrame, column: str, labels: list, out: str) -> DataFrame:
    return df.withColumn(out, label_place(F.col(column), labels).cast("double"))


def numeric_to_nominal(df: DataFrame, column: str, labels: list, out: str) -> DataFrame:
    return df.withColumn(out, F.get(F.array(*map(F.lit, labels)), F.col(column).cast("int")))


def to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def swap_labels(x: Column, a, b) -> Column:
    return F.when(x == a, F.lit(b)).when(x == b, F.lit(a)).otherwise(x)


def date_text(x: Column, pattern: str) -> Column:
    """A date at the precision of a pattern."""
    return F.date_format(x, pattern)


def random_columns(df: DataFrame, count: int | float, keep: list[str] | None = None, seed: int = 1) -> DataFrame:
    """``count`` columns (a share of them, if under 1) chosen by a hash of their names and the seed, besides ``keep``."""
    keep = keep or []
    names = sorted((c for c in df.columns if c not in keep), key=lambda c: zlib.crc32(f"{seed}:{c}".encode()))
    n = int(round(count * len(names))) if count < 1 else int(count)
    chosen = set(names[:n])
    return df.select(*keep, *(c for c in df.columns if c in chosen))


def chi_squared_p(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution: the regularised incomplete gamma function by its series or fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def merge_by_chaid(df: DataFrame, column: str, label: str, significance: float = 0.05) -> DataFrame:
    """Merge the pair of labels whose class counts differ least, while the chi-squared p-value of the pair is over ``significance``.

    Only the counts of labels and classes come to the driver. Merged labels are joined by "_or_"; ties go to the smaller names.
    """
    rows = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(column, label).count().collect()
    classes = sorted({str(r[label]) for r in rows})
    counts: dict[tuple, np.ndarray] = {}
    for r in rows:
        counts.setdefault((str(r[column]),), np.zeros(len(classes)))[classes.index(str(r[label]))] = r["count"]

    def p_value(a, b) -> float:
        t = np.stack([counts[a], counts[b]])
        t = t[:, t.sum(0) > 0]
        e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
        return chi_squared_p(float(((t - e) ** 2 / e).sum()), t.shape[1] - 1)

    while len(counts) > 2:
        keys = sorted(counts)
        p, a, b = max(((p_value(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]), key=lambda x: (x[0], [-ord(c) for c in "".join(x[1] + x[2])]))
        if p <= significance:
            break
        counts[tuple(sorted(a + b))] = counts.pop(a) + counts.pop(b)
    names = {v: "_or_".join(k) for k in counts for v in k if len(k) > 1}
    if not names:
        return df
    to = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return df.withColumn(column, F.coalesce(to[F.col(column).cast("string")], F.col(column).cast("string")))


def gram_matrix(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross-products of the rows without nulls in ``columns``, in one pass."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = known.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = (r[f"c{i}_{j}"] or 0.0) * r.n
    return r.n, np.array([r[f"m{i}"] or 0.0 for i in range(len(columns))]), out


def linear_columns(df: DataFrame, columns: list[str], mean: np.ndarray, weights: np.ndarray, out: str = "scores") -> DataFrame:
    """``df`` with an array of linear combinations of centred columns; a row of ``weights`` for each column."""
    one = lambda w: sum(((F.col(c) - float(m)) * float(x) for c, m, x in zip(columns, mean, w, strict=True)), F.lit(0.0))
    return df.withColumn(out, F.array(*(one(w) for w in weights.T)))


def partial_least_squares(df: DataFrame, columns: list[str], target: str, components: int) -> DataFrame:
    """``df`` with ``scores``: directions of largest covariance with the target, one after the other.

    One pass gathers the cross-products; each direction and what it leaves is a small solve on them.
    """
    _, mean, g = gram_matrix(df, [*columns, target])
    x, xy = g[:-1, :-1], g[:-1, -1]
    p = len(columns)
    weights, rest = [], np.eye(p)
    for _ in range(components):
        w = rest.T @ xy
        if np.linalg.norm(w) < 1e-12:
            break
        w = rest @ (w / np.linalg.norm(w))
        tt = w @ x @ w
        if tt < 1e-12:
            break
        weights.append(w)
        load = x @ w / tt
        rest = rest - np.outer(w, load @ rest)
    return linear_columns(df, columns, mean[:-1], np.stack(weights, 1) if weights else np.zeros((p, 0)))


def latent_semantics(df: DataFrame, id_col: str, features: str, size: int, rank: int) -> DataFrame:
    """(id, scores): rows on the leading right singular vectors of the (uncentred) table; signs make each vector's largest entry positive."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = df.select(array_to_vector(F.col(features)).alias("v")).rdd.map(lambda r: Vectors.fromML(r.v))
    v = RowMatrix(rows, numCols=size).computeSVD(rank).V.toArray()
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    one = lambda w: F.aggregate(F.zip_with(features, F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.select(id_col, F.array(*(one(w) for w in v.T)).alias("scores"))
