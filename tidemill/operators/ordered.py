"""Prefix sums, ranks and quantiles of one ordered column without a task that sees all rows.

Values are dealt to ranges whose borders are approximate quantiles, fixed before anything is summed. A range's rows are summed by a
window inside it, and the sums of the ranges before it (one row a range) are added.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what is read more than once is computed once, and later plans start there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a range is meant to have.
RANGE = 100_000


def ranges_for(table: DataFrame) -> int:
    """How many ranges a written table is dealt to: few rows need no borders."""
    return max(1, min(2000, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // RANGE)))


def _ranges(df: DataFrame, by: str, parts: int | None) -> DataFrame:
    """``df`` with ``__range``, the number of the range that ``by`` lies in (null in the first)."""
    parts = parts or min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = df.agg(F.percentile_approx(F.col(by).cast("double"), asked, F.lit(10 * parts)).alias("q")).first().q if parts > 1 else None
    borders = sorted({x for x in found or [] if x == x})
    if not borders:
        return df.withColumn("__range", F.lit(0.0))
    value = F.coalesce(F.col(by).cast("double"), F.lit(float("-inf")))
    split = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="__value", outputCol="__range", handleInvalid="keep")
    return split.transform(df.withColumn("__value", value)).drop("__value")


def running_sums(df: DataFrame, by: str, columns: list[str], keys: list[str] | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``<c>_upto`` for each column: its sum over the rows up to and with this one in the order of ``by`` (inside ``keys``).

    ``by`` is a number or a time. Rows of equal ``by`` get the same sums, those of all of them. The order of rows is not kept.
    """
    keys = keys or []
    dealt = _ranges(df, by, parts)
    of = dealt.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = Window.partitionBy(*keys).orderBy(turn("__range")).rowsBetween(Window.unboundedPreceding, -1)
    of = of.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__of"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(turn(by))
    summed = dealt.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in columns}).join(F.broadcast(of) if not keys else of, same)
    return summed.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"__{c}") for c in columns}).drop("__range", "__of", *(f"__{c}" for c in columns), *(f"__k_{k}" for k in keys))


def next_values(df: DataFrame, by: str, name: str = "next", parts: int | None = None) -> DataFrame:
    """``df`` of distinct values with the next larger one of each (null for the largest)."""
    dealt = _ranges(df, by, parts)
    first = dealt.groupBy("__range").agg(F.min(by).alias("__first"))
    after = first.select(F.col("__range").alias("__of"), F.lead("__first").over(Window.partitionBy().orderBy("__range")).alias("__first"))
    inside = F.lead(by).over(Window.partitionBy("__range").orderBy(by))
    return dealt.withColumn(name, inside).join(F.broadcast(after), F.col("__range") == F.col("__of")).withColumn(name, F.coalesce(name, "__first")).drop("__range", "__of", "__first")


def value_counts(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """(column, n) of the known values."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n))


def at_positions(df: DataFrame, column: str, positions: list[int]) -> dict[int, float]:
    """The values at the stated places (from 0) of the sorted known values."""
    r = running_sums(value_counts(df, column), column, ["n"])
    places = df.sparkSession.createDataFrame([(int(p),) for p in sorted(set(positions))], "p long")
    hit = r.join(F.broadcast(places), (F.col("p") < F.col("n_upto")) & (F.col("p") >= F.col("n_upto") - F.col("n")))
    return {x.p: x.v for x in hit.select("p", F.col(column).cast("double").alias("v")).collect()}


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbouring values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return []
    spots = [s * (n - 1) for s in shares]
    got = at_positions(df, column, [p for s in spots for p in (int(s), min(n - 1, int(s) + 1))])
    return [got[int(s)] + (s - int(s)) * (got[min(n - 1, int(s) + 1)] - got[int(s)]) for s in spots]
