"""Row sampling, rebalancing and splitting by seeded hashes of an id: the same rows on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seeded numbers lie in [0, KEYS).
KEYS = 1 << 60


def seeded(seed: int, *columns: str) -> Column:
    """A number in [0, KEYS): the first 15 hex digits of the MD5 of the seed and the columns, joined by colons. Any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))), 1, 15), 16, 10).cast("long")


def order_key(id_col: str, seed: int) -> Column:
    return seeded(seed, id_col)


def hash_rank(df: DataFrame, label: str, id_col: str, seed: int, name: str = "__r") -> DataFrame:
    """``df`` with ``name``: the place from 1 of each row in its class in hash order.

    The hash's leading bits deal each class to 1,024 ranges; a row's place is its place in its range and the rows of the ranges before.
    """
    dealt = df.withColumn("__b", F.shiftright(order_key(id_col, seed), 50))
    counts = dealt.groupBy(label, "__b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(label).alias("__l"), F.col("__b").alias("__of"), before.alias("__before"))
    inside = Window.partitionBy(label, "__b").orderBy(order_key(id_col, seed), id_col)
    ranked = dealt.withColumn(name, F.row_number().over(inside)).join(counts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__of")))
    return ranked.withColumn(name, F.col(name) + F.col("__before")).drop("__b", "__l", "__of", "__before")


def randomise(df: DataFrame, id_col: str, seed: int = 1) -> DataFrame:
    """The rows in a seeded order."""
    return df.orderBy(order_key(id_col, seed), id_col)


def random_places(df: DataFrame, id_col: str, seed: int = 1, name: str = "place") -> DataFrame:
    """``df`` with ``name``: each row's place from 1 in the order of :func:`randomise`, without sorting the table in one task."""
    return hash_rank(df.withColumn("__one", F.lit(1)), "__one", id_col, seed, name).drop("__one")


def resample(df: DataFrame, id_col: str, percent: float, seed: int = 1, invert: bool = False) -> DataFrame:
    """Rows without replacement whose hash falls under a share (the others, if inverted): no sort, no shuffle."""
    hit = F.pmod(order_key(id_col, seed), F.lit(1_000_000)) < percent * 10_000
    return df.where(~hit if invert else hit)


def resample_with_replacement(df: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    return df.sample(True, percent / 100, seed)


def stratified_sample(df: DataFrame, label: str, id_col: str, fractions: dict, seed: int = 1) -> DataFrame:
    u = F.pmod(order_key(id_col, seed), F.lit(1_000_000)) / 1e6
    keep = F.lit(False)
    for v, f in fractions.items():
        keep = keep | ((F.col(label) == v) & (u < f))
    return df.where(keep)


def spread_subsample(df: DataFrame, label: str, id_col: str, spread: float = 1.0, most: int = 0, seed: int = 1) -> DataFrame:
    """At most ``spread`` times the smallest class (0: no limit) and ``most`` (0: no limit) rows of each class."""
    counts = df.groupBy(label).count().collect()  # one row a class
    least = min((r["count"] for r in counts), default=0)
    cap = min(x for x in (spread * least or float("inf"), most or float("inf")))
    if cap == float("inf"):
        return df
    return hash_rank(df, label, id_col, seed).where(F.col("__r") <= int(cap)).drop("__r")


def supervised_resample(df: DataFrame, label: str, id_col: str, percent: float, bias: float = 0.0, seed: int = 1) -> DataFrame:
    """``percent`` of the rows without replacement; each class's share lies between its own (bias 0) and an equal one (bias 1).

    A class can give no more rows than it has.
    """
    size = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    every = Window.partitionBy()
    want = F.round(percent / 100 * (bias * F.sum("__n").over(every) / F.count("*").over(every) + (1 - bias) * F.col("__n")))
    ranked = hash_rank(df, label, id_col, seed).join(F.broadcast(size.select("__l", want.alias("__want"))), F.col(label).eqNullSafe(F.col("__l")))
    return ranked.where(F.col("__r") <= F.col("__want")).drop("__r", "__want", "__l")


def stratified_amount(df: DataFrame, label: str, id_col: str, amount: int, seed: int = 1) -> DataFrame:
    """About ``amount`` rows in the proportions of the classes, at least one of each."""
    size = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    want = F.greatest(F.lit(1.0), F.round(amount * F.col("__n") / F.sum("__n").over(Window.partitionBy())))
    ranked = hash_rank(df, label, id_col, seed).join(F.broadcast(size.select("__l", want.alias("__want"))), F.col(label).eqNullSafe(F.col("__l")))
    return ranked.where(F.col("__r") <= F.col("__want")).drop("__r", "__want", "__l")


def remove_misclassified(df: DataFrame, label: str, predict, rounds: int = 10) -> DataFrame:
    """Rows that a model gets right, until it gets all of them right or ``rounds`` are over; ``predict`` adds ``predicted`` to a table."""
    for _ in range(rounds):
        said = predict(df)
        wrong = said.where(~F.col("predicted").eqNullSafe(F.col(label))).limit(1).count()
        if not wrong:
            break
        df = said.where(F.col("predicted").eqNullSafe(F.col(label))).select(*df.columns).checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else said.where(F.col("predicted").eqNullSafe(F.col(label))).select(*df.columns)
    return df


def reservoir(df: DataFrame, id_col: str, k: int, seed: int = 1) -> DataFrame:
    """A fixed-size sample: the k smallest hashes, found by a mergeable top-k."""
    return df.orderBy(order_key(id_col, seed), id_col).limit(k)


def folds(df: DataFrame, id_col: str, k: int, seed: int = 1) -> DataFrame:
    return df.withColumn("fold", F.pmod(order_key(id_col, seed), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, seed: int = 1) -> DataFrame:
    """Deal each class round-robin to the folds in hash order."""
    return hash_rank(df, label, id_col, seed).withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r")


def train_test(df: DataFrame, label: str, id_col: str, share: float, seed: int = 1) -> DataFrame:
    """``is_train``: the first ceil(share * n) rows of each class in hash order."""
    size = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    ranked = hash_rank(df, label, id_col, seed).join(F.broadcast(size), F.col(label).eqNullSafe(F.col("__l")))
    return ranked.withColumn("is_train", F.col("__r") <= F.ceil(F.col("__n") * share)).drop("__r", "__n", "__l")


def resample_split(df: DataFrame, label: str, id_col: str, is_train: str, seed: int) -> DataFrame:
    """A new split with each class's original number of training rows; seed 0 keeps the original."""
    if seed == 0:
        return df
    size = df.groupBy(F.col(label).alias("__l")).agg(F.count_if(is_train).alias("__n"))
    ranked = hash_rank(df, label, id_col, seed).join(F.broadcast(size), F.col(label).eqNullSafe(F.col("__l")))
    return ranked.withColumn(is_train, F.col("__r") <= F.col("__n")).drop("__r", "__n", "__l")


def weighted_sample(df: DataFrame, id_col: str, weight: str, k: int, seed: int = 1) -> DataFrame:
    """k rows without replacement in proportion to weight: smallest exponential clocks, one top-k."""
    u = (F.pmod(order_key(id_col, seed), F.lit(2**31 - 1)) + 1) / float(2**31)
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), id_col).limit(k)


def smote(df: DataFrame, label: str, minority, id_col: str, features: str, percent: int = 100, k: int = 5, seed: int = 1) -> DataFrame:
    """Synthetic minority rows (id null): row + u * (neighbour - row), neighbours by Euclidean distance inside the class."""
    from .distances import knn_join

    own = df.where(F.col(label) == minority)
    near = knn_join(own, own, k, id_col, features, label).select(F.col("query").alias("q"), F.col("neighbour").alias("nb"), "rank")
    per = max(1, percent // 100)
    picks = own.select(F.col(id_col).alias("q"), F.col(features).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(per))).alias("i")).withColumn("rank", (F.pmod(seeded(seed, "q", "i"), F.lit(k)) + 1).cast("int"))
    both = picks.join(near, ["q", "rank"]).join(own.select(F.col(id_col).alias("nb"), F.col(features).alias("b")), "nb")
    u = F.pmod(seeded(seed + 1, "q", "i"), F.lit(10_000)) / 10_000.0
    return both.select(F.lit(None).cast(dict(df.dtypes)[id_col]).alias(id_col), F.zip_with("a", "b", lambda x, y: x + u * (y - x)).alias(features), F.lit(minority).alias(label))


def to_sparse(a: Column) -> Column:
    """array -> map of the non-zero entries by position from 0."""
    return F.map_filter(F.map_from_arrays(F.sequence(F.lit(0), F.size(a) - 1), a), lambda _, v: v != 0)


def to_dense(m: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
