"""Local descriptors of series and bags of their words: key points of a scale space, gradient histograms around them, a k-means codebook."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Rows smoothed by a normal kernel, ends repeated."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (r, r)), mode="edge"), 2 * r + 1, axis=1) @ (k / k.sum())


def scale_space(x: np.ndarray, sigma: float = 1.6, factor: float = 2**0.5, scales: int = 6) -> np.ndarray:
    """Smoothed rows at each scale: (scale, row, point)."""
    return np.stack([_gaussian(x, sigma * factor**i) for i in range(scales)])


def key_points(space: np.ndarray) -> np.ndarray:
    """(scale, row, point) of the extrema of differences of neighbouring scales, over the two points beside and the three each above and below."""
    d = np.diff(space, axis=0)
    s, n, t = d.shape
    if s < 3 or t < 3:
        return np.zeros((0, 3), int)
    mid = d[1:-1, :, 1:-1]
    around = [d[1 + i : s - 1 + i, :, 1 + j : t - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    top, low = np.max(around, axis=0), np.min(around, axis=0)
    return np.argwhere((mid > top) | (mid < low)) + [1, 0, 1]


def descriptors(x: np.ndarray, blocks: int = 8, width: int = 4, dense: bool = False, **space) -> list[np.ndarray]:
    """For each row its descriptors: around a key point (every fourth point of every scale, if ``dense``) the sums of rising and of falling gradients in
    ``blocks`` blocks of ``width`` points, weighted by a normal curve over all of them; outside the series there is no gradient."""
    s = scale_space(x, **space)
    g = np.gradient(s, axis=2) if x.shape[1] > 1 else np.zeros_like(s)
    half = blocks * width // 2
    g = np.pad(g, ((0, 0), (0, 0), (half, half)))
    at = np.stack(np.meshgrid(np.arange(len(s)), np.arange(len(x)), np.arange(0, x.shape[1], 4), indexing="ij"), -1).reshape(-1, 3) if dense else key_points(s)
    w = np.lib.stride_tricks.sliding_window_view(g, 2 * half, axis=2)[at[:, 0], at[:, 1], at[:, 2]]
    w = w * np.exp(-0.5 * ((np.arange(2 * half) - half + 0.5) / (blocks * width / 2)) ** 2)
    w = w.reshape(len(at), blocks, width)
    both = np.stack([np.maximum(w, 0).sum(2), np.maximum(-w, 0).sum(2)], 2).reshape(len(at), 2 * blocks)
    order = np.argsort(at[:, 1], kind="stable")
    edge = np.searchsorted(at[order, 1], np.arange(len(x) + 1))
    return [both[order[a:b]] for a, b in zip(edge, edge[1:], strict=False)]


#: Series whose descriptors are held at once.
SLICE = 256


def descriptor_batches(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """Batches of the kept columns and the series (the last column) to batches with a row a descriptor; only a slice's are held."""
    for batch in batches:
        values = batch.column(batch.num_columns - 1)
        sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes):
            places = np.flatnonzero(sizes == n)
            for a in range(0, len(places) if n else 0, SLICE):
                at = places[a : a + SLICE]
                taken = batch.take(pa.array(at))
                x = taken.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
                d = descriptors(x, **how)
                many = [len(v) for v in d]
                if sum(many):
                    rows = taken.take(pa.array(np.repeat(np.arange(len(at)), many)))
                    flat = np.concatenate(d)
                    each = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], each], [*rows.schema.names[:-1], "d"])


def local_descriptors(df: DataFrame, keep: list[str], series: str, blocks: int = 8, width: int = 4, dense: bool = False, scales: int = 6) -> DataFrame:
    """``keep`` and ``d array<double>``, a row a descriptor; series without key points have no row, null series neither."""
    known = df.where(F.col(series).isNotNull()).select(*keep, F.col(series).alias("d"))
    schema = StructType([*(known.schema[c] for c in keep), StructField("d", ArrayType(DoubleType()))])
    return known.mapInArrow(lambda batches: descriptor_batches(batches, blocks=blocks, width=width, dense=dense, scales=scales), schema)


class DescriptorWords:
    """A codebook of ``k`` words, and the bags of series: root of the shares of their words, brought to length one."""

    def __init__(self, k: int = 32, seed: int = 1, **how):
        self.k, self.seed, self.how = k, seed, how

    def fit(self, df: DataFrame, series: str) -> DescriptorWords:
        d = local_descriptors(df, [], series, **self.how).select(array_to_vector("d").alias("features"))
        self.model: KMeansModel = KMeans(k=self.k, seed=self.seed, maxIter=20).fit(d)
        return self

    def transform(self, df: DataFrame, id_col: str, series: str, *keep: str) -> DataFrame:
        """(id, keep, bag array<double>): zeros for a series without key points."""
        d = local_descriptors(df, [id_col], series, **self.how).withColumn("features", array_to_vector("d"))
        words = self.model.transform(d).groupBy(id_col, "prediction").agg(F.count("*").alias("n"))
        bags = words.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("prediction", "n"))).alias("m"))
        n = F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: F.sqrt(F.coalesce(F.get(F.array(F.col("m")), F.lit(0))[i], F.lit(0)).cast("double")))
        size = F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, v: a + v * v))
        rows = df.select(id_col, *keep).join(bags, id_col, "left").withColumn("r", n)
        return rows.withColumn("size", size).select(id_col, *keep, F.transform("r", lambda v: F.when(F.col("size") > 0, v / F.col("size")).otherwise(0.0)).alias("bag"))
