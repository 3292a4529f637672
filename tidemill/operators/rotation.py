"""Rotation forest: every tree sees the attributes turned by the principal components of random groups of them.

One job sums the products that all groups of all trees need, each over its own random classes and half of the rows; the driver gets a small matrix
a group. A tree is then an MLlib tree on the turned attributes, and the trees' probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import seeded


@dataclass
class Turn:
    """The attributes of each group of a tree, and the classes that its components are taken from."""

    groups: list[list[int]]
    classes: list[list[int]]


def random_turns(size: int, classes: int, trees: int, group: int = 3, seed: int = 1) -> list[Turn]:
    """Attributes dealt to groups of ``group`` (the last filled up with attributes drawn again), each with a random non-empty set of classes."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        order = rng.permutation(size).tolist()
        while len(order) % min(group, size):
            order.append(int(rng.choice([i for i in range(size) if i not in order[len(order) // group * group :]])))
        parts = [sorted(order[i : i + group]) for i in range(0, len(order), min(group, size))]
        picks = [np.flatnonzero(rng.random(classes) < 0.5).tolist() or [int(rng.integers(classes))] for _ in parts]
        out.append(Turn(parts, picks))
    return out


def group_sums(rows: DataFrame, turns: list[Turn], keep: float = 0.5, seed: int = 1) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """(n, sums, products) of every group of every tree, over the rows (__x, __y, __u) that it draws.

    A row is drawn for tree t and group g if its class is the group's and a number hashed from __u, t and g is under ``keep``.
    """
    sent = rows.sparkSession.sparkContext.broadcast(turns)
    limit = np.uint64(int(keep * (1 << 32)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            x, y, u = np.stack(f["__x"].to_list()).astype(float), f["__y"].to_numpy(), f["__u"].to_numpy().astype(np.uint64)
            for t, turn in enumerate(sent.value):
                for g, (at, classes) in enumerate(zip(turn.groups, turn.classes, strict=True)):
                    h = (u ^ np.uint64((t << 20 | g) + seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = x[((h >> np.uint64(32)) < limit) & np.isin(y, classes)][:, at]
                    z = np.c_[np.ones(len(z)), z]
                    held[t, g] = held.get((t, g), 0) + z.T @ z
        if held:
            yield pd.DataFrame([(t, g, i, float(v)) for (t, g), m in held.items() for i, v in enumerate(m.ravel())], columns=["t", "g", "i", "v"])

    got = rows.mapInPandas(run, "t int, g int, i int, v double").groupBy("t", "g", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for (t, g), f in got.groupby(["t", "g"]):
        m = f.sort_values("i")["v"].to_numpy()
        m = m.reshape(int(len(m) ** 0.5), -1)
        out[int(t), int(g)] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def rotations(turns: list[Turn], sums: dict, size: int) -> list[np.ndarray]:
    """For each tree the matrix (size x turned attributes) of its groups' components, largest variance first; a group without two rows is not turned."""
    out = []
    for t, turn in enumerate(turns):
        blocks = []
        for g, at in enumerate(turn.groups):
            n, s, q = sums.get((t, g), (0.0, np.zeros(len(at)), np.zeros((len(at), len(at)))))
            block = np.zeros((size, len(at)))
            c = (q - np.outer(s, s) / n) / (n - 1) if n >= 2 else np.zeros_like(q)
            v = np.linalg.eigh(c)[1][:, ::-1] if np.abs(c).max(initial=0) > 0 else np.eye(len(at))
            block[at] = v * np.where(v[np.abs(v).argmax(0), np.arange(len(at))] < 0, -1, 1)
            blocks.append(block)
        out.append(np.concatenate(blocks, axis=1))
    return out


def _turned(df: DataFrame, features: str, matrix: np.ndarray) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(matrix)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_list()).astype(float) @ sent.value))

    return df.withColumn("__v", array_to_vector(F.pandas_udf(run, "array<double>")(F.col(features))))


class RotationForest:
    """``fit`` then ``predict``. Columns are brought to unit variance first; rows with a null label or null features are not learned from."""

    def __init__(self, trees: int = 10, group: int = 3, keep: float = 0.5, depth: int = 5, seed: int = 1):
        self.trees, self.group, self.keep, self.depth, self.seed = trees, group, keep, depth, seed

    def fit(self, df: DataFrame, id_col: str, features: str, label: str) -> RotationForest:
        known = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
        size = known.select(F.size(features).alias("n")).first()
        if size is None:
            raise ValueError("there is no row to learn from")
        size = size.n
        at = known.agg(*(f(F.col(features)[i]).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.mean = np.array([at[f"m{i}"] for i in range(size)])
        self.scale = np.array([at[f"s{i}"] or 1.0 for i in range(size)])
        self.classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(1001).collect()]
        if len(self.classes) > 1000:
            raise ValueError(f"{label} has over 1000 classes")
        place = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)) - 1
        rows = self._scaled(known, features).select("__x", place.cast("double").alias("__y"), seeded(self.seed, id_col).alias("__u"))
        self.turns = random_turns(size, len(self.classes), self.trees, self.group, self.seed)
        self.matrices = rotations(self.turns, group_sums(rows, self.turns, self.keep, self.seed), size)
        self.models = [DecisionTreeClassifier(featuresCol="__v", labelCol="__y", maxDepth=self.depth, seed=self.seed).fit(_turned(rows, "__x", m)) for m in self.matrices]
        return self

    def _scaled(self, df: DataFrame, features: str) -> DataFrame:
        mean, scale = (F.array(*(F.lit(float(v)) for v in x)) for x in (self.mean, self.scale))
        return df.withColumn("__x", F.zip_with(F.zip_with(features, mean, lambda a, b: a - b), scale, lambda a, b: a / b))

    def predict(self, df: DataFrame, keep: list[str], features: str) -> DataFrame:
        """``keep``, ``predicted`` (ties to the first class) and ``probs``, the mean of the trees' probabilities."""
        x = self._scaled(df.where(F.col(features).isNotNull()), features)
        for i, (m, tree) in enumerate(zip(self.matrices, self.models, strict=True)):
            x = tree.transform(_turned(x, "__x", m)).withColumn(f"__p{i}", vector_to_array("probability")).drop("__v", "rawPrediction", "probability", "prediction")
        mean = F.array(*(sum((F.col(f"__p{i}")[c] for i in range(len(self.models))), F.lit(0.0)) / len(self.models) for c in range(len(self.classes))))
        x = x.select(*keep, F.transform(mean, lambda v: F.round(v, 12)).alias("probs"))
        best = F.array_position("probs", F.array_max("probs")).cast("int")
        return x.select(*keep, F.element_at(F.array(*map(F.lit, self.classes)), best).alias("predicted"), "probs")
