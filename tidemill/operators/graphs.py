"""Connected components of a table of edges, and the clusterings that are components: density, single link, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch
from .distances import knn_join, radius_join


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: the next round's plan starts there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every id: the smallest id reachable over ``edges`` (x, y), in either direction.

    Each round takes the smallest label of a node and its neighbours, then the label of that label, so chains shorten by halves.
    """
    both = _written(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    now = _written(nodes.select(F.col("id"), F.col("id").alias("c")).distinct(), "labels")
    while True:
        near = both.join(now.select(F.col("id").alias("y"), "c"), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("m"))
        low = now.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("l"))
        low = _written(low, "labels")
        jump = low.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        later = _written(low.join(jump, "l").select("id", F.least("l", "ll").alias("c"), F.col("c").alias("old")), "labels")
        if not later.where("c <> old").limit(1).count():
            return later.select("id", F.col("c").alias("component"))
        now = later.select("id", "c")


def density_clusters(df: DataFrame, id_col: str, features: str, epsilon: float, least: int) -> DataFrame:
    """(id, core, cluster): DBSCAN. A core row has ``least`` rows within ``epsilon``, itself included; cores within it share a cluster, named by its
    smallest core; another row joins the cluster of its nearest core within ``epsilon`` (smallest id on ties); the rest is noise (null)."""
    near = _written(radius_join(df, df, id_col, features, epsilon), "near")
    ids = df.select(F.col(id_col).alias("id"))
    counts = near.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("n"))
    cores = _written(ids.join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= least).select("id"), "cores")
    c = cores.select(F.col("id").alias("x")), cores.select(F.col("id").alias("y"))
    labels = component_labels(cores, near.join(c[0], "x", "left_semi").join(c[1], "y", "left_semi"))
    border = near.join(c[1], "y", "left_semi").join(c[0], "x", "left_anti").groupBy(F.col("x").alias("id")).agg(F.min(F.struct(F.round("distance", 9).alias("d"), "y"))["y"].alias("y"))
    of = border.join(labels.select(F.col("id").alias("y"), "component"), "y").select("id", F.lit(False).alias("core"), F.col("component").alias("cluster"))
    named = labels.select("id", F.lit(True).alias("core"), F.col("component").alias("cluster")).union(of)
    return ids.join(named, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), "cluster")


def core_distances(df: DataFrame, id_col: str, features: str, label: str, least: int) -> DataFrame:
    """(id, core_distance): how far a row's ``least``-th row is, itself the first."""
    n = knn_join(df, df, least - 1, id_col, features, label)
    return n.where(F.col("rank") == least - 1).select(F.col("query").alias("id"), F.sqrt("distance").alias("core_distance"))


def epsilon_sweep(df: DataFrame, id_col: str, features: str, epsilons: list[float], least: int) -> DataFrame:
    """(epsilon, clusters, noise): density clusters at each of a grid of distances."""
    out = None
    for e in epsilons:
        r = density_clusters(df, id_col, features, e, least).agg(F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise")).select(F.lit(float(e)).alias("epsilon"), "clusters", "noise")
        out = r if out is None else out.union(r)
    return out


def single_link(df: DataFrame, id_col: str, features: str, height: float) -> DataFrame:
    """(id, component): the single-link tree cut at a height."""
    return component_labels(df.select(F.col(id_col).alias("id")), radius_join(df, df, id_col, features, height))


def cluster_sizes(labels: DataFrame, cluster: str) -> DataFrame:
    """(size, clusters): how many clusters have each size."""
    return labels.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def minimum_forest(df: DataFrame, edges: DataFrame) -> DataFrame:
    """(x, y, distance) of a minimum spanning forest of ``edges`` by rounds in which every component takes its least edge out (ties by ends)."""
    nodes = df.select("id")
    chosen, labels = None, nodes.select("id", F.col("id").alias("component"))
    edges = _written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.round("distance", 9).alias("distance")).distinct(), "edges")
    while True:
        a, b = labels.select(F.col("id").alias("x"), F.col("component").alias("cx")), labels.select(F.col("id").alias("y"), F.col("component").alias("cy"))
        out = edges.join(a, "x").join(b, "y").where("cx <> cy")
        ends = out.select(F.col("cx").alias("c"), "distance", "x", "y").union(out.select(F.col("cy").alias("c"), "distance", "x", "y"))
        best = ends.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("distance", "x", "y"))).where("r = 1").select("x", "y", "distance").distinct()
        best = _written(best, "forest")
        if not best.limit(1).count():
            return chosen if chosen is not None else best
        chosen = _written(best if chosen is None else chosen.union(best), "forest")
        labels = component_labels(nodes, chosen)
