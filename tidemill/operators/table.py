"""Relational core on a labelled table: projection, row filters, summaries, nested aggregates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)


def keep_columns(df: DataFrame, columns: list[str], invert: bool = False) -> DataFrame:
    return df.drop(*columns) if invert else df.select(*columns)


def drop_matching(df: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    """Drop columns whose whole name matches a regular expression (keep only those with ``invert``)."""
    hit = [c for c in df.columns if re.fullmatch(pattern, c)]
    return df.select(*hit) if invert else df.drop(*hit)


def drop_type(df: DataFrame, kind: type[T.DataType] | tuple[type[T.DataType], ...]) -> DataFrame:
    return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, kind)))


def drop_useless(df: DataFrame, most_distinct: float = 99.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop constant columns, and string columns with distinct values in more than ``most_distinct`` percent of the rows, in one pass."""
    names = [c for c in df.columns if c not in keep]
    r = df.agg(F.count("*").alias("__n"), *(F.count_distinct(c).alias(c) for c in names)).first()
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.drop(*(c for c in names if r[c] <= 1 or (c in strings and r[c] > r["__n"] * most_distinct / 100)))


def redundant_columns(df: DataFrame) -> list[str]:
    """Columns whose values equal an earlier column's in all rows: equal order-free hashes first, an exact count after."""
    h = df.agg(*(F.sum(F.xxhash64(F.col(c).cast("string")) % (1 << 40)).alias(c) for c in df.columns)).first()
    pairs = [(a, b) for i, b in enumerate(df.columns) for a in df.columns[:i] if h[a] == h[b]]
    if not pairs:
        return []
    r = df.agg(*(F.count_if(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    return sorted({b for i, (_, b) in enumerate(pairs) if r[str(i)] == 0})


def rename_matching(df: DataFrame, pattern: str, to: str) -> DataFrame:
    return df.toDF(*(re.sub(pattern, to, c) for c in df.columns))


def add_id(df: DataFrame, order: list, name: str = "id", partition: list[str] | None = None) -> DataFrame:
    """Number rows from 1 in a stated order. Without ``partition`` rows are dealt to written ranges of the order and numbered inside
    them, after the ranges before: no single task sorts all rows.

    The ranges are written before they are counted: sorted again for the result, rows may be dealt otherwise.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    from .ordered import written

    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a range
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__s"))
    inside = dealt.withColumn("__m", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return inside.join(F.broadcast(start), "__p").withColumn(name, F.col("__s") + F.col("__m")).select(*df.columns, name)


def filter_value(df: DataFrame, column: str, below: float | None = None, labels: list[str] | None = None, keep_missing: bool = False, invert: bool = False) -> DataFrame:
    """Keep rows under a split point or in a label set; nulls only where asked for."""
    c = F.col(column)
    hit = c < below if below is not None else c.isin(*labels)
    return df.where(F.when(c.isNull(), F.lit(keep_missing)).otherwise(~hit if invert else hit))


def filter_rank(df: DataFrame, order: list[str], first: int, last: int, invert: bool = False) -> DataFrame:
    """Keep rows whose position (from 1) in a stated order lies in a range."""
    n = add_id(df, order, "__n")
    hit = F.col("__n").between(first, last)
    return n.where(~hit if invert else hit).drop("__n")


def sorted_rows(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Ascending, missing last; ``name`` is each row's place from 1, as a table's rows have no order of their own."""
    return add_id(df, [F.col(c).asc_nulls_last() for c in order], name)


def sub_range(df: DataFrame, order: list, first: int, count: int) -> DataFrame:
    """``count`` rows after the ``first`` ones of a stated order."""
    return df.orderBy(*order).offset(first).limit(count)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of tables with the same columns, in any order of the columns; different columns raise."""
    names = {frozenset(f.columns) for f in frames}
    if len(names) > 1:
        raise ValueError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), frames)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def keep_frequent(df: DataFrame, column: str, n: int, least: bool = False) -> DataFrame:
    """Rows whose value is among the n most (least) frequent, ties by value."""
    count = df.where(F.col(column).isNotNull()).groupBy(column).count()
    top = count.orderBy(F.asc("count") if least else F.desc("count"), column).limit(n).select(column)
    return df.join(F.broadcast(top), column, "left_semi") if n <= 100_000 else df.join(top, column, "left_semi")


def kth_smallest(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value, nulls apart: a distributed top-k, not a global sort in one task."""
    return df.where(F.col(column).isNotNull()).select(column).orderBy(column).offset(k - 1).limit(1)


def merge_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns side by side, by key and never by position."""
    return left.join(right, key)


def weighted_stats(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Sum of weights, weighted mean and weighted sample variance by group."""
    w, x = F.col(weight), F.col(value)
    sums = df.where(x.isNotNull()).groupBy(*by).agg(F.sum(w).alias("sum_weights"), F.sum(w * x).alias("__s"), F.sum(w * x * x).alias("__q"))
    m = F.col("__s") / F.col("sum_weights")
    return sums.select(*by, "sum_weights", m.alias("weighted_mean"), ((F.col("__q") - F.col("__s") * m) / (F.col("sum_weights") - 1)).alias("weighted_variance"))


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None, name: str = "attribute", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in keep or []], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def summarise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: rows, missing, distinct, seen once, whole numbers, min, max, mean, deviation. One shuffle of value counts."""
    counts = unpivot(df, columns).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    known = F.when(v.isNotNull(), n).otherwise(0)
    s = counts.groupBy("attribute").agg(
        F.sum(n).alias("total"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("missing"), F.count(v).alias("distinct_values"), F.count_if((n == 1) & v.isNotNull()).alias("unique_values"),
        F.sum(F.when(v == F.floor(v), n).otherwise(0)).alias("whole"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), (F.sum(v * n) / F.sum(known)).alias("mean_value"),
        F.sum(known).alias("__k"), F.sum(v * n).alias("__s"), F.sum(v * v * n).alias("__q"),
    )
    sd = F.sqrt(F.greatest((F.col("__q") - F.col("__s") * F.col("__s") / F.col("__k")) / (F.col("__k") - 1), F.lit(0.0)))
    return s.withColumn("sd_value", sd).drop("__k", "__s", "__q")


def paired_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and deviation of the differences, correlation, and the paired t statistic."""
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"), F.corr(a, b).alias("correlation")).withColumn("t", F.col("mean_difference") / (F.col("sd_difference") / F.sqrt("n")))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def propositionalise(df: DataFrame, key: list[str], numeric: list[str], nominal: dict[str, list[str]]) -> DataFrame:
    """One row a bag: min, max, mean, deviation and sum of numbers, and counts of the stated labels (skip labels over the allowed cardinality before)."""
    aggs: list[Column] = []
    for c in numeric:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_avg"), F.stddev_samp(c).alias(f"{c}_sd"), F.sum(c).alias(f"{c}_sum")]
    for c, labels in nominal.items():
        aggs += [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for v in labels]
    return df.groupBy(*key).agg(*aggs)


def to_bags(df: DataFrame, key: list[str], columns: list[str], name: str = "bag") -> DataFrame:
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def from_bags(df: DataFrame, name: str = "bag") -> DataFrame:
    return df.select(*(c for c in df.columns if c != name), F.inline(name))


def binary_relabel(df: DataFrame, label: str, own: str, out: str = "label2") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == own, F.lit(own)).otherwise(F.lit("rest")))


def apply_all(df: DataFrame, *steps) -> DataFrame:
    """Filters one after another; each takes and returns a DataFrame."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def apply_parts(df: DataFrame, key: str, parts: dict[tuple[str, ...], object]) -> DataFrame:
    """Different filters on different column subsets, put together again by key."""
    done = [df.select(key, *cols).transform(f) for cols, f in parts.items()]
    return reduce(lambda a, b: a.join(b, key), done)


def roughly_equal(a: Column, b: Column, small: float = 1e-6) -> Column:
    return F.abs(a - b) < small
