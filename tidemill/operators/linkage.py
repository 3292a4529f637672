"""Agglomerative clustering by single, complete, average and Ward links, in rounds of merges that are each other's nearest.

A round finds every cluster's nearest (ties by the ends' ids), merges all pairs that are nearest to each other, and updates the table of distances by
the Lance-Williams rule: a join with the merges, first for one end, then for the other. For these links merging such pairs at
once gives the tree that merging one pair after the other gives. The table has a row for every pair of rows: quadratic, as
the clustering is; large tables are first brought down to centres or representatives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .distances import all_pairs
from .graphs import _written, component_labels

LINKS = ("single", "complete", "average", "ward")


def _joined(link: str, h: Column, n1: Column, n2: Column, n: Column, one: Column, two: Column) -> Column:
    """Distance to a cluster of size n once clusters of sizes n1 and n2 are one; ``one``, ``two``: theirs to it, ``h``: between them."""
    if link == "single":
        return F.least(one, two)
    if link == "complete":
        return F.greatest(one, two)
    if link == "average":
        return (n1 * one + n2 * two) / (n1 + n2)
    return ((n1 + n) * one + (n2 + n) * two - n * h) / (n1 + n2 + n)


def pair_distances(df: DataFrame, id_col: str, features: str, link: str) -> DataFrame:
    """(x, y, d) for every ordered pair of different rows: Euclidean distances, for Ward half their squares (what merging adds to the squared error)."""
    side = lambda a, b: df.where(F.col(features).isNotNull()).select(F.col(id_col).alias(a), F.col(features).alias(b))
    squared = A.squared_euclidean(F.col("__a"), F.col("__b"))
    return all_pairs(side("x", "__a"), side("y", "__b")).where("x <> y").select("x", "y", (squared / 2 if link == "ward" else F.sqrt(squared)).alias("d"))


def agglomerate(distances: DataFrame, link: str, height: float | None = None) -> DataFrame:
    """(x, y, height, size): the merges of the tree; x and y are the smallest members of the two clusters, x the smaller; size is that of both.

    ``distances``: (x, y, d), see :func:`pair_distances`; equal distances are those equal to nine digits. With ``height`` merges above it are left out,
    and rounds stop there. A table without pairs has no merges.
    """
    if link not in LINKS:
        raise ValueError(f"link is one of {LINKS}")
    half = _written(distances.where("x < y").select("x", "y", F.round("d", 9).alias("d")), "pairs")
    now = half.union(half.select("y", "x", "d"))
    sizes = _written(now.select(F.col("x").alias("c"), F.lit(1).cast("long").alias("n")).distinct(), "sizes")
    done = []
    while True:
        pair = F.struct("d", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        near = now.groupBy("x").agg(F.min(pair).alias("p"))
        both = near.groupBy("p").count().where("count = 2").select("p.*")
        if height is not None:
            both = both.where(F.col("d") <= height)
        n = sizes.select(F.col("c").alias("lo"), F.col("n").alias("n1")), sizes.select(F.col("c").alias("hi"), F.col("n").alias("n2"))
        merges = _written(both.join(n[0], "lo").join(n[1], "hi").select("lo", "hi", F.col("d").alias("h"), "n1", "n2"), "merges")
        if not merges.limit(1).count():
            break
        done.append(merges)
        to = merges.select(F.col("hi").alias("from"), F.col("lo").alias("to"))
        sizes_now = _written(sizes.join(to, sizes["c"] == to["from"], "left").groupBy(F.coalesce("to", "c").alias("c")).agg(F.sum("n").alias("n")), "sizes")
        # one end, against the other end's cluster before the round, then the other end, against the first's cluster after it
        half = _written(_merge_end(_merge_end(now, merges, link, "x", "y", sizes), merges, link, "y", "x", sizes_now).where("x < y"), "pairs")
        now, sizes = half.union(half.select("y", "x", "d")), sizes_now
    if not done:
        return half.sparkSession.createDataFrame([], merges.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("h").alias("height"), F.col("n1").alias("size")).schema)
    tree = reduce(DataFrame.union, done)
    return tree.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("h").alias("height"), (F.col("n1") + F.col("n2")).alias("size"))


def _merge_end(pairs: DataFrame, merges: DataFrame, link: str, end: str, other: str, sizes: DataFrame) -> DataFrame:
    """``pairs`` with the clusters at ``end`` merged; pairs inside a new cluster go."""
    part = merges.select(F.col("lo").alias(end), F.col("lo").alias("to"), F.lit(True).alias("is_lo"), F.col("h"), "n1", "n2").union(merges.select("hi", "lo", F.lit(False), "h", "n1", "n2"))
    rows = pairs.join(part, end, "left").where(f"to is null or {other} <> to")
    stay = rows.where("to is null").select("x", "y", "d")
    moved = rows.where("to is not null").groupBy("to", other).agg(
        F.max(F.when(F.col("is_lo"), F.col("d"))).alias("one"), F.max(F.when(~F.col("is_lo"), F.col("d"))).alias("two"), F.first("h").alias("h"), F.first("n1").alias("n1"), F.first("n2").alias("n2")
    ).where("one is not null and two is not null").join(sizes.select(F.col("c").alias(other), "n"), other)
    d = _joined(link, *(F.col(c) for c in ("h", "n1", "n2", "n", "one", "two")))
    return stay.unionByName(moved.select(F.col("to").alias(end), other, F.round(d, 9).alias("d")))


def cut_tree(ids: DataFrame, merges: DataFrame, clusters: int | None = None, height: float | None = None) -> DataFrame:
    """(id, component) of the tree of ``merges`` cut at a height or into a number of clusters (the lowest merges stay, ties by ends)."""
    if height is not None:
        merges = merges.where(F.col("height") <= height)
    else:
        merges = merges.orderBy("height", "x", "y").limit(max(0, ids.count() - clusters))
    return component_labels(ids, merges.select("x", "y"))
