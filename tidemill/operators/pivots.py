"""Exact nearest neighbours with few distances: rows are dealt to pivots, and the triangle inequality leaves out whole groups.

A row lies in the cell of its nearest pivot, and in a ring of that cell by its distance to the pivot. A query first searches its own ring; the
distance of its k-th row there bounds the answer. Then it visits only rings that hold a point within that distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distances import _near, _sides
from .graphs import _written

#: Rows of a ring; most pivots, so that what is broadcast is bounded.
RING, MOST_PIVOTS = 1024, 1024
#: Most rows of a bundle of rings and of the queries that meet it in a task, so that a query is sent to few tasks; most rings of a bundle.
BUNDLE, BUNDLE_RINGS = 16_384, 60


def choose_pivots(df: DataFrame, id_col: str, series: str, count: int) -> np.ndarray:
    """Series of ``count`` rows, by the hash of the id."""
    rows = df.where(F.col(series).isNotNull()).orderBy(F.xxhash64(id_col, F.lit("pivot")), id_col).limit(count).select(series).collect()
    return np.unique(np.array([r[0] for r in rows], float), axis=0) if rows else np.zeros((0, 0))


def _far(df: DataFrame, series: str, pivots: np.ndarray) -> DataFrame:
    """``df`` with ``far``, its Euclidean distances to the pivots, and ``cell``, the nearest one's number."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def run(s: pd.Series) -> pd.Series:
        x, p = np.stack(s.to_list()).astype(float), sent.value
        return pd.Series([r for a in range(0, len(x), 1024) for r in np.sqrt(((x[a : a + 1024, None] - p[None]) ** 2).sum(2))])

    far = df.withColumn("far", F.pandas_udf(run, "array<double>")(F.col(series)))
    return far.withColumn("cell", F.array_position("far", F.array_min("far")).cast("int") - 1)


def _ringed(rows: DataFrame, ring: int) -> DataFrame:
    """``rows`` (neighbour, label, b, cell, r) with ``ring``, its place among at most 64 ranges of r in its cell, and ``part``, a share of a large ring."""
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / 64 for i in range(1, 64)], 2000).alias("cuts"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(64 * ring) / F.col("n"))).cast("int")
    cuts = _written(cells.select("cell", F.array_distinct(F.filter("cuts", lambda v, i: (i + 1) % step == 0)).alias("cuts")), "cuts")
    dealt = _written(rows.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda v: v < F.col("r")))).drop("cuts"), "rings")
    parts = dealt.groupBy("cell", "ring").agg(F.ceil(F.count("*") / (4 * ring)).cast("int").alias("parts"))
    return _written(dealt.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int")).drop("parts"), "rings")


def _bundled(borders: DataFrame, size: int) -> DataFrame:
    """``borders`` (a row a ring) with ``bundle``, about ``size`` rows of neighbouring rings, and ``slot``, the ring's number in it (under 64)."""
    share = F.sum(F.greatest(F.col("n"), F.lit(-(-size // BUNDLE_RINGS)))).over(Window.orderBy("cell", "ring"))
    x = borders.withColumn("bundle", F.floor((share - 1) / size).cast("int"))
    return _written(x.withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("cell", "ring")) - 1), "bundles")


def _visit(visits: DataFrame, asked: DataFrame, rows: DataFrame, bundles: DataFrame, k: int, schema: str, most: int) -> DataFrame:
    """The k nearest rows of each bundle for each query that visits a ring of it. ``visits``: (query, cell, ring), written.

    A query is sent once to each part of a bundle, with the slots of the rings that it visits, and meets the rows of these. A bundle's queries are dealt
    to blocks of about ``most``, so a task holds a block of queries and a part of each of a bundle's rings.
    """
    of = F.broadcast(bundles.select("cell", "ring", "bundle", "slot", "parts"))
    sent = visits.select("query", "cell", "ring").join(of, ["cell", "ring"]).groupBy("query", "bundle").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("slots"), F.max("parts").alias("parts"))
    sent = _written(sent, "sent")
    blocks = sent.groupBy("bundle").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    left = sent.join(F.broadcast(blocks), "bundle").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left = left.join(asked.select("query", "actual", "a"), "query")
    right = rows.join(of.drop("parts"), ["cell", "ring"]).join(F.broadcast(blocks), "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("cell", "ring", "r", "blocks")
    names = ["query", "actual", "neighbour", "label", "distance"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in names})
        a, b, out = np.stack(x["a"].to_list()).astype(float), np.stack(y["b"].to_list()).astype(float), []
        slots, own, query, neighbour = x["slots"].to_numpy(), y["slot"].to_numpy(), x["query"].to_numpy(), y["neighbour"].to_numpy()
        for slot in np.unique(own):
            i, j = np.flatnonzero((slots >> slot) & 1), np.flatnonzero(own == slot)
            if len(i):
                row, col, d = _near(a[i], b[j], query[i][:, None] == neighbour[j], k, "euclidean", {})
                out.append((i[row], j[col], d))
        if not out:
            return pd.DataFrame({c: [] for c in names})
        row, col, d = (np.concatenate(v) for v in zip(*out, strict=True))
        f = pd.concat([x[["query", "actual"]].iloc[row].reset_index(drop=True), y[["neighbour", "label"]].iloc[col].reset_index(drop=True)], axis=1).assign(distance=d)
        f = f.sort_values(["query", "distance", "neighbour"])
        return f[f.groupby("query").cumcount() < k]

    group = ["bundle", "part", "block"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, schema)


def pivot_knn(queries: DataFrame, train: DataFrame, k: int, id_col: str, series: str, label: str, pivots: int | None = None, ring: int = RING) -> tuple[DataFrame, DataFrame]:
    """(query, actual, neighbour, label, distance, rank) as :func:`distances.knn_join` finds them with the Euclidean kernel, and (query, met): rows met by each.

    ``pivots``: by default the root of the number of rows, at most MOST_PIVOTS. A ring that no query visits costs nothing. Ids are not repeated; null series are left
    out, other series are of one length; an empty side gives an empty result.
    """
    q, t = _sides(queries, train, id_col, series, label)
    t = t.select(*(F.col(c).alias(c) for c in t.columns))
    count = t.count()
    size = max(ring, min(BUNDLE, count // 8))
    p = choose_pivots(train, id_col, series, min(MOST_PIVOTS, pivots or math.isqrt(count) + 1))
    kinds = dict(q.dtypes) | dict(t.dtypes)
    schema = f"query {kinds['query']}, actual {kinds['actual']}, neighbour {kinds['neighbour']}, label {kinds['label']}, distance double"
    if not len(p):
        empty = q.sparkSession.createDataFrame([], schema)
        return empty.withColumn("rank", F.lit(1)), empty.select("query", F.lit(0).cast("long").alias("met"))
    rows = _ringed(_written(_far(t, "b", p).select("neighbour", "label", "b", "cell", F.element_at("far", F.col("cell") + 1).alias("r")), "cells"), ring)
    borders = _written(rows.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), (F.max("part") + 1).alias("parts")), "borders")
    bundles = _bundled(borders, size)
    asked = _written(_far(q, "a", p), "asked")
    # the nearest ring of the query's own cell that has rows
    own = F.element_at("far", F.col("cell") + 1)
    home = asked.select("query", "cell", own.alias("r")).join(borders, "cell").withColumn("gap", F.greatest(F.col("low") - F.col("r"), F.col("r") - F.col("high"), F.lit(0.0)))
    first = _written(home.groupBy("query", "cell").agg(F.min(F.struct("gap", "ring")).alias("s")).select("query", "cell", "s.ring"), "first")
    found = _written(_visit(first, asked, rows, bundles, k, schema, max(2 * ring, size)), "found")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    kth = found.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.sqrt("distance").alias("reach"))
    # where the own ring has too few rows, k + 1 rows of the cell's nearest rings bound the answer
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("high", "ring"))
    enough = borders.withColumn("upto", upto).where(F.col("upto") > k).groupBy("cell").agg(F.min("high").alias("enough"))
    reach = asked.join(kth, "query", "left").join(F.broadcast(enough), "cell", "left").select("query", "cell", "far", F.coalesce("reach", own + F.col("enough"), F.lit(float("inf"))).alias("reach"))
    span = borders.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # a row a pivot
    low, high = np.full(len(p), np.inf), np.full(len(p), -np.inf)
    low[span["cell"]], high[span["cell"]] = span["low"], span["high"]
    sent = q.sparkSession.sparkContext.broadcast((low, high, np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))))

    def near_cells(far: pd.Series, cell: pd.Series, reach: pd.Series) -> pd.Series:
        low, high, apart = sent.value
        d, r = np.stack(far.to_list()), (reach.to_numpy() * (1 + 1e-9) + 1e-9)[:, None]
        between = apart[cell.to_numpy()]
        beyond = (d * d - d.min(1, keepdims=True) ** 2) / np.where(between > 0, 2 * between, 1)  # to the plane between the pivots
        return pd.Series([np.flatnonzero(x) for x in (d - high <= r) & (low - d <= r) & (beyond <= r)])

    wide = reach.withColumn("reach", F.col("reach") * (1 + 1e-9) + 1e-9).withColumn("cells", F.pandas_udf(near_cells, "array<int>")("far", "cell", "reach"))
    each = wide.select("query", "reach", "far", F.explode("cells").alias("cell")).select("query", "reach", "cell", F.element_at("far", F.col("cell") + 1).alias("r"))
    more = each.join(borders, "cell").where("low - reach <= r and r - high <= reach").select("query", "cell", "ring")
    more = _written(more.join(first, ["query", "cell", "ring"], "left_anti"), "more")
    both = found.unionByName(_visit(more, asked, rows, bundles, k, schema, max(2 * ring, size)))
    met = first.select("query", "cell", "ring").union(more.select("query", "cell", "ring")).join(borders, ["cell", "ring"]).groupBy("query").agg(F.sum("n").alias("met"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k), met
