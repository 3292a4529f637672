"""Toxicity: logistic regression fitted by FTRL-proximal over hashed words, word pairs and skip pairs.

Per-coordinate rates and an L1 penalty leave few weights; those are broadcast and every whole text is scored by the
distinct features it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MARKS, fold, grams, mix, slices, small_batches, words

BITS = 20
#: At most so many labelled rows of each label are learned from (those with the smallest hash of the id).
SAMPLE_PER_LABEL = 4096
ALPHA, BETA, L1, L2, EPOCHS, THRESHOLD = 2.0, 1.0, 10.0, 1.0, 6, 0.7


def _features(w) -> tuple[np.ndarray, np.ndarray]:
    """Document and feature of all words, neighbours and pairs with one word between."""
    doc, feature = [w.doc], [mix(w.hash + np.uint64(1))]
    for k, step in ((2, 1), (2, 2)):
        h = grams(w.hash, k, step)
        same = w.doc[: len(h)] == w.doc[step : step + len(h)]
        doc.append(w.doc[: len(h)][same])
        feature.append(h[same])
    return np.concatenate(doc), np.concatenate(feature) >> np.uint64(64 - BITS)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.uint64) << np.uint64(BITS) | feature)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], l1: float = L1) -> tuple[np.ndarray, float]:
    """Weights of FTRL-proximal after EPOCHS passes over (distinct features, label) in the order given; the last is the free bias."""
    z, n, bias_z, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    weight = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for f, label in rows:
            zf, nf = z[f], n[f]
            w = weight(zf, nf, l1)
            wb = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - label
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
            n[f] = nf + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * wb
            bias_n += g * g
    return weight(z, n, l1), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int = 3, held_out_is: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero features, their weights and the bias, from a bounded sample of labelled rows that aren't held out.

    The sample (SAMPLE_PER_LABEL of each label) is chosen by ids alone, its texts are read by a broadcast of those
    ids, and one task learns from it; a sampled id that repeats counts as often as it does.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % held_out_mod != held_out_is)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True, between=MARKS)
                doc, feature = _distinct(*_features(w))
                edge = np.searchsorted(doc, np.arange(w.n_docs + 1))
                feature = feature.astype(np.int32)
                rows += [(int(i), feature[edge[k] : edge[k + 1]], int(y)) for k, (i, y) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("toxic").to_pylist(), strict=True))]
        order = np.argsort(mix(np.array([r[0] for r in rows], np.int64).view(np.uint64)), kind="stable")
        w, bias = ftrl([rows[i][1:] for i in order])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int64)), pa.array(np.r_[bias, w[at]])], ["feature", "weight"])

    got = texts.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "feature long, weight double").toPandas()
    f, w = got["feature"].to_numpy(), got["weight"].to_numpy()
    return f[f >= 0], w[f >= 0], float(w[f < 0].sum())


def score(docs: DataFrame, labels: DataFrame, held_out_mod: int = 3, held_out_is: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; score is the probability that a reader marks the text as toxic.

    Only words count: A-Z lower-cased runs without ASCII white space and marks. Null and empty texts get the score of no
    feature. Rows with a null id are scored and never held out; rows that repeat get equal scores; without usable
    labels of both kinds every score is the prior's. Labels that are null or other than 0 and 1 are ignored.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features, weights, bias = fit(docs, labels, held_out_mod, held_out_is)
    sent = docs.sparkSession.sparkContext.broadcast((features, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = w
        for batch in batches:
            for part in slices(batch):
                x = words(part.column("text"), lower=True, between=MARKS)
                doc, feature = _features(x)
                hit = table[feature] != 0
                doc, feature = _distinct(doc[hit], feature[hit])
                s = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, table[feature], x.n_docs), -35, 35)))
                held = fold(part.column("doc_id"), held_out_mod) == held_out_is
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held), pa.array(s.astype(np.float64)), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
