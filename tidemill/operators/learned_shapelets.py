"""Learned shapelets: soft-minimum distances to a few shapelets feed a logistic model, and both are fitted by gradients.

An epoch is one Spark job: every task sums loss and gradient over its series, a groupBy adds the sums, and the driver gets one number a
parameter. The model (shapelets, weights) is bounded by its own sizes and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .series import sliding_windows

#: Sharpness of the soft minimum, Adagrad's rate, penalty of the weights.
SHARPNESS, RATE, PENALTY = -30.0, 0.1, 0.01
_ROWS = 256


@dataclass
class ShapeletModel:
    """Shapelets by length (rows of a matrix each), and a weight for every class and shapelet with a bias for every class."""

    shapelets: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray
    classes: list

    def packed(self) -> np.ndarray:
        return np.concatenate([*(s.ravel() for s in self.shapelets), self.weights.ravel(), self.bias])

    def unpacked(self, flat: np.ndarray) -> ShapeletModel:
        out, at = [], 0
        for part in (*self.shapelets, self.weights, self.bias):
            out.append(flat[at : at + part.size].reshape(part.shape))
            at += part.size
        return ShapeletModel(out[:-2], out[-2], out[-1], self.classes)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """All windows of length n of each row, z-normalised."""
    w = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)
    sd = w.std(2, keepdims=True)
    return np.where(sd > 0, (w - w.mean(2, keepdims=True)) / np.where(sd > 0, sd, 1), 0)


def _soft_minima(w: np.ndarray, s: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances (row, shapelet, window), the share of each window in the soft minimum, and the soft minima."""
    d = ((w * w).sum(2)[:, None, :] - 2 * np.einsum("bjl,kl->bkj", w, s) + (s * s).sum(1)[None, :, None]) / s.shape[1]
    share = np.exp(sharpness * (d - d.min(2, keepdims=True)))
    share /= share.sum(2, keepdims=True)
    return d, share, (share * d).sum(2)


def soft_minima(x: np.ndarray, shapelets: list[np.ndarray], sharpness: float = SHARPNESS) -> np.ndarray:
    return np.concatenate([_soft_minima(_windows(x, s.shape[1]), s, sharpness)[2] for s in shapelets], axis=1)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, model: ShapeletModel, sharpness: float = SHARPNESS) -> tuple[float, np.ndarray]:
    """Logistic loss of one against the rest, summed over the rows of ``x`` and the classes, and its gradient. ``y``: places in ``classes``."""
    parts = [(_windows(x, s.shape[1]), s) for s in model.shapelets]
    soft = [_soft_minima(w, s, sharpness) for w, s in parts]
    m = np.concatenate([p[2] for p in soft], axis=1)
    z = m @ model.weights.T + model.bias
    hot = np.eye(len(model.classes))[y]
    loss = float((np.logaddexp(0, z) - hot * z).sum())
    dz = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - hot
    dm = dz @ model.weights
    out, at = [], 0
    for (w, s), (d, share, low) in zip(parts, soft, strict=True):
        dd = dm[:, at : at + len(s), None] * share * (1 + sharpness * (d - low[:, :, None]))
        out.append((2 / s.shape[1] * (dd.sum((0, 2))[:, None] * s - np.einsum("bkj,bjl->kl", dd, w))).ravel())
        at += len(s)
    return loss, np.concatenate([*out, (dz.T @ m).ravel(), dz.sum(0)])


def soft_transform(df: DataFrame, keep: list[str], series: str, shapelets: list[np.ndarray], sharpness: float = SHARPNESS) -> DataFrame:
    """``distances array<double>``: the soft minimum over all windows of the mean squared distance to each shapelet."""
    sent = df.sparkSession.sparkContext.broadcast(shapelets)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([r for a in range(0, len(s), _ROWS) for r in soft_minima(np.stack(s.iloc[a : a + _ROWS].to_list()).astype(float), sent.value, sharpness)])

    return df.select(*keep, F.pandas_udf(run, "array<double>")(F.col(series)).alias("distances"))


def start_shapelets(df: DataFrame, series: str, lengths: list[int], k: int, seed: int = 1) -> list[np.ndarray]:
    """For each length the k centres (fewer where there are fewer distinct windows) of a k-means over all z-normalised windows."""
    out = []
    for n in lengths:
        w = sliding_windows(df.select(series), series, n).select(array_to_vector(A.z_normalise(F.col("window"))).alias("features"))
        out.append(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(w).clusterCenters()))
    return out


def _total(df: DataFrame, model: ShapeletModel, sharpness: float) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows of ``df`` (__y, __x)."""
    size = model.packed().size
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1)
        for f in frames:
            for a in range(0, len(f), _ROWS):
                g = f.iloc[a : a + _ROWS]
                loss, gradient = loss_and_gradient(np.stack(g["__x"].to_list()).astype(float), g["__y"].to_numpy(), sent.value, sharpness)
                total += np.r_[gradient, loss]
        yield pd.DataFrame({"slot": np.arange(size + 1), "value": total})

    got = df.mapInPandas(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).orderBy("slot").toPandas()["value"].to_numpy()
    sent.unpersist()
    return float(got[-1]), got[:-1]


def learn_shapelets(df: DataFrame, series: str, label: str, lengths: list[int], k: int, epochs: int = 30, rate: float = RATE, sharpness: float = SHARPNESS, penalty: float = PENALTY, seed: int = 1) -> tuple[ShapeletModel, list[float]]:
    """The fitted model and its loss (a row and class, with the penalty) at the start and after each epoch.

    Series are of one length; null series and null labels are left out, and without a row or with one class there is nothing to fit: that
    raises. The loss never rises: an epoch that would raise it is taken back and the rate halved.
    """
    known = df.where(F.col(series).isNotNull() & F.col(label).isNotNull())
    classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(10_001).collect()]
    if not 2 <= len(classes) <= 10_000:
        raise ValueError(f"{label}: shapelets are learned for 2 to 10000 classes")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    rows = known.select(place.cast("int").alias("__y"), F.col(series).alias("__x"))
    n = rows.count()
    starts = start_shapelets(known, series, lengths, k, seed)
    width = sum(len(s) for s in starts)
    model = ShapeletModel(starts, np.random.default_rng(seed).normal(0, 0.01, (len(classes), width)), np.zeros(len(classes)), classes)
    flat = model.packed()
    is_weight = np.zeros(flat.size, bool)
    is_weight[sum(s.size for s in starts) : flat.size - len(classes)] = True

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _total(rows, model.unpacked(x), sharpness)
        return loss / (n * len(classes)) + penalty * float((x[is_weight] ** 2).mean()), gradient / (n * len(classes)) + np.where(is_weight, 2 * penalty * x / is_weight.sum(), 0)

    loss, gradient = at(flat)
    losses, squares = [loss], np.zeros(flat.size)
    for _ in range(epochs):
        more = squares + gradient * gradient
        later = flat - rate * gradient / np.sqrt(more + 1e-12)
        now, slope = at(later)
        if now > loss:
            rate /= 2
        else:
            flat, loss, gradient, squares = later, now, slope, more
        losses.append(loss)
    return model.unpacked(flat), losses


def shapelet_predict(df: DataFrame, keep: list[str], series: str, model: ShapeletModel, sharpness: float = SHARPNESS) -> DataFrame:
    """``keep``, ``predicted`` (the class of the largest score, the first of equals) and ``probs``, the scores scaled to sum to one."""
    x = soft_transform(df, keep, series, model.shapelets, sharpness)
    score = [sum((F.col("distances")[j] * float(w) for j, w in enumerate(row)), F.lit(float(b))) for row, b in zip(model.weights, model.bias, strict=True)]
    x = x.withColumn("probs", F.transform(F.array(*score), lambda z: 1 / (1 + F.exp(-z)))).withColumn("probs", F.transform("probs", lambda p: p / F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)))
    best = (F.array_position("probs", F.array_max("probs"))).cast("int")
    return x.select(*keep, F.element_at(F.array(*map(F.lit, model.classes)), best).alias("predicted"), "probs")
