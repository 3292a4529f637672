"""Quality classifier by co-training: one view reads the text's characters and words, the other the page's metadata.

Both views start from labelled rows. In each round both score all other documents, and those of which one view is surest get that
view's label and join the other view's training rows. The two calibrated views are combined to score all documents.
Features are computed once and written; rounds and scores read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, drop_cut, free_name, mix, slices, small_batches, words

#: Labelled rows that are learned from at most (those with the smallest hash of the id), rounds, rows that a view adds a round and label.
LABELLED, ROUNDS, ADDED = 6000, 4, 250
GRAMS, DENSE, METAS = 512, 10, 256
#: Parts that the surest rows of a view and label are first found in.
PARTS = 8
SURE, REJECT_BELOW = 0.95, 0.5


def _text_view(w, at: np.ndarray) -> np.ndarray:
    """Shares of character kinds, of repeated words and of hashed two-byte sequences, for every document of a slice."""
    n, raw = w.n_docs, w.data
    doc = np.repeat(np.arange(n), np.diff(at))
    size = np.maximum(np.diff(at), 1)
    share = lambda m: np.bincount(doc, m, n) / size
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    digit, wide = (raw >= 48) & (raw <= 57), raw >= 128
    mark = ~(upper | lower | digit | wide | SPACE[raw])
    twice = np.zeros(len(raw))
    if len(raw) > 1:
        twice[1:] = (raw[1:] == raw[:-1]) & mark[1:] & (doc[1:] == doc[:-1])
    n_words = np.maximum(np.bincount(w.doc, minlength=n), 1)
    both = np.unique(np.stack([w.doc.astype(np.uint64), w.hash]), axis=1)[0] if len(w.hash) else np.zeros(0)
    distinct = np.bincount(both.astype(np.int64), minlength=n) / n_words
    length = np.bincount(w.doc, w.end - w.start, n) / n_words
    dense = np.stack([share(upper), share(lower), share(digit), share(mark), share(wide), share(twice), share(raw == 10), distinct, np.log1p(n_words) / 10, length / 10], 1)
    grams = np.zeros((n, GRAMS))
    if len(raw) > 1:
        same = doc[1:] == doc[:-1]
        g = mix(raw[:-1].astype(np.uint64) << np.uint64(8) | raw[1:])[same] % np.uint64(GRAMS)
        grams = np.bincount(doc[1:][same] * GRAMS + g.astype(np.int64), minlength=n * GRAMS).reshape(n, GRAMS) / size[:, None]
    return np.c_[dense * 4, np.sqrt(grams) * 2]


def _metas() -> Column:
    """Places of the hashed source, language, their pair and length class: what is known of a page without reading its text."""
    source, lang = (F.coalesce(F.col(c), F.lit("None")) for c in ("source", "lang"))
    step = F.when(F.col("n_chars") >= 0, F.floor(2 * F.log2(1.0 + F.col("n_chars")))).otherwise(-1).cast("string")
    step = F.coalesce(step, F.lit("-1"))
    keys = (F.concat(F.lit("s"), source), F.concat(F.lit("l"), lang), F.concat(F.lit("sl"), source, F.lit("|"), lang), F.concat(F.lit("n"), step), F.concat(F.lit("ln"), lang, F.lit("|"), step))
    return F.array(*((F.crc32(k) % METAS).cast("int") for k in keys))


PLACES = 5


def _meta_view(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), METAS))
    np.add.at(out, (np.arange(len(places))[:, None], places), 1)
    return out


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The text view, and the places of the metadata view, of a slice of (text, metas)."""
    text = part.column("text")
    w = words(text)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), np.int64)
    places = np.asarray(part.column("metas").flatten(), np.int64).reshape(-1, PLACES)
    return _text_view(w, np.r_[0, np.cumsum(lengths)]), places


_WIDTH = 2 * (GRAMS + DENSE) + PLACES


def _packed(text: np.ndarray, places: np.ndarray) -> pa.Array:
    """Both views as one binary value a row: half floats, then a byte for each place."""
    rows = np.ascontiguousarray(np.c_[text.astype("<f2").view(np.uint8), places.astype(np.uint8)])
    ends = np.arange(len(rows) + 1, dtype=np.int32) * _WIDTH
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(values), np.uint8).reshape(-1, _WIDTH)
    text = np.ascontiguousarray(rows[:, : _WIDTH - PLACES]).view("<f2").astype(np.float32)
    return text, _meta_view(rows[:, _WIDTH - PLACES :].astype(np.int64))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient steps; the last number is the bias."""
    x = np.c_[x, np.ones(len(x))]
    step = 1 / (0.25 * (x * x).sum(1).max() + l2)
    w = before = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for k in range(steps):
        v = w + k / (k + 3) * (w - before)
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ v, -35, 35))) - y)) + l2 * np.r_[v[:-1], 0]
        before, w = w, v - 8 * step * g
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -35, 35)


def _platt(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _logistic(logit[:, None] / 4, y, np.ones(len(y)), 1e-4)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, confident: Callable) -> dict:
    """The two views' weights, their calibrations and the weights of the combination.

    ``confident(models)`` gives the rows of the pool that a view is surest of, as (view, label, text rows, metadata rows). A third
    of the labelled rows is kept from the fits and used to calibrate and to combine.
    """
    own = np.arange(len(y))
    hold = own[own % 3 == 0] if len(own) >= 30 else own
    learn = np.setdiff1d(own, hold) if len(own) >= 30 else own
    views = [text, meta]
    rows, given = [text[learn], meta[learn]], [y[learn].astype(float)] * 2
    models: list = [None, None]
    for r in range(ROUNDS + 1):
        for k in (0, 1):
            balance = np.where(given[k] == 1, 0.5 / max(given[k].sum(), 1), 0.5 / max((1 - given[k]).sum(), 1))
            models[k] = _logistic(rows[k], given[k], balance)
        new = confident(models) if r < ROUNDS else []
        if not new:
            break
        for view, label, *both in new:
            rows[1 - view] = np.concatenate([rows[1 - view], both[1 - view]])
            given[1 - view] = np.r_[given[1 - view], np.full(len(both[0]), float(label))]
    scale = [_platt(_logit(v[hold], m), y[hold].astype(float)) for v, m in zip(views, models, strict=True)]
    both = np.stack([_logit(_logit(v[hold], m)[:, None] / 4, s) for v, m, s in zip(views, models, scale, strict=True)], 1)
    return {"models": models, "scale": scale, "both": _logistic(both / 4, y[hold].astype(float), np.ones(len(hold)), 1e-4)}


def _combined(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    each = [_logit(_logit(v, m)[:, None] / 4, s) for v, m, s in zip((text, meta), model["models"], model["scale"], strict=True)]
    sure = lambda z: 1 / (1 + np.exp(-z))
    return sure(each[0]), sure(each[1]), sure(_logit(np.stack(each, 1) / 4, model["both"]))


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """(doc_id, text, metas)."""
    types = dict(zip(_COLUMNS, ("long", "string", "string", "string", "long"), strict=True))
    known = small_batches(docs).select(*(F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
    return known.select("doc_id", "text", _metas().alias("metas"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): both views of every row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _packed(*_views(part))], ["doc_id", "x"])

    return _plain(docs).mapInArrow(run, "doc_id long, x binary")


def _sure(views: tuple[np.ndarray, np.ndarray], models: list) -> Iterator[tuple[int, np.ndarray]]:
    """For each view how likely it holds label 1, to six decimals."""
    for k in (0, 1):
        yield k, np.round(1 / (1 + np.exp(-_logit(views[k], models[k]))), 6)


def _confident(feats: DataFrame, known: list[int]) -> Callable:
    """The rows of ``feats`` that a view is surest of, ADDED at most a view and label, of all that aren't known; what is returned becomes known."""
    spark = feats.sparkSession
    known = list(known)

    def pick(models: list) -> list:
        sent = spark.sparkContext.broadcast((models, np.sort(np.array(known, np.int64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, gone = sent.value
            for batch in batches:
                ids = np.asarray(batch.column("doc_id").fill_null(0))
                free = batch.column("doc_id").is_valid().to_numpy(False) & ~np.isin(ids, gone)
                views = _unpacked(batch.column("x").to_pylist())
                for k, p in _sure(views, models):
                    for label, far in ((1, np.round(1 - p, 6)), (0, p)):
                        at = np.flatnonzero(free & (far <= 1 - SURE))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(np.full(len(at), label)), pa.array(far[at]), pa.array(ids[at])], ["view", "label", "far", "doc_id"])

        found = feats.mapInArrow(run, "view long, label long, far double, doc_id long")
        # first inside some parts of each view and label, so that the last choice has a fixed number of rows however many tasks there are
        turn = lambda *keys: F.row_number().over(Window.partitionBy("view", "label", *keys).orderBy("far", F.xxhash64("doc_id"), "doc_id"))
        few = found.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS))).withColumn("r", turn("part")).where(F.col("r") <= ADDED)
        chosen = cut(few.withColumn("r", turn()).where(F.col("r") <= ADDED).select("view", "label", "doc_id").distinct())
        got = feats.join(F.broadcast(chosen), "doc_id").groupBy("view", "label", "doc_id").agg(F.min("x").alias("x")).toPandas().sort_values(["view", "label", "doc_id"])
        known.extend(int(i) for i in got["doc_id"].unique())
        return [(int(view), int(label), *_unpacked(list(g["x"]))) for (view, label), g in got.groupby(["view", "label"])]

    return pick


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict | None, DataFrame | None]:
    """The model and the written features of ``docs``; None for both without labels of both kinds.

    At most LABELLED labelled documents, chosen by ids, are learned from; the pool is all the others.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).groupBy("doc_id").agg(F.min("y").alias("y"))
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    own = cut(by_hash(known.where("y = 1"), LABELLED // 2).union(by_hash(known.where("y = 0"), LABELLED // 2)))
    if own.select("y").distinct().count() < 2:
        return None, None
    feats = cut(features(docs))
    got = feats.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    y = got["y"].to_numpy(int)
    if not ((y == 0).any() and (y == 1).any()):
        return None, None
    return co_train(*_unpacked(list(got["x"])), y, _confident(feats, got["doc_id"].tolist())), feats


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` for every row: probabilities that quality is 1, and score >= REJECT_BELOW.

    ``docs`` has doc_id and text; lang, source and n_chars are used where present, and null is a value of its own.
    Null texts count as empty. Rows with a null id and rows that repeat are scored like any others. Without labels of
    both kinds every score is 1 and everything is kept. Other columns are not read.
    """
    model, feats = fit(docs, labels)
    names = ["doc_id", "text_score", "meta_score", "score", "keep"]
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(1.0).alias(c) for c in names[1:4]), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = _combined(sent.value, *_unpacked(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (a, b, c, c >= REJECT_BELOW))], names)

    return feats.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that the classifier keeps; scored in place, without a join."""
    model, feats = fit(docs, labels)
    if model is None:
        return docs
    drop_cut(feats)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    missing = [c for c in _COLUMNS if c not in docs.columns]
    types = dict(zip(_COLUMNS, ("long", "string", "string", "string", "long"), strict=True))
    filled = small_batches(docs).select("*", *(F.lit(None).cast(types[c]).alias(c) for c in missing))
    names, plain = docs.columns, dict(docs.dtypes).get("text") == "string"
    metas, text = free_name("__metas", filled), "text" if plain else free_name("__text", filled)
    seen = filled.select(*names, *([] if plain else [F.col("text").cast("string").alias(text)]), _metas().alias(metas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                view, places = _views(pa.RecordBatch.from_arrays([part.column(text), part.column(metas)], ["text", "metas"]))
                keep = _combined(sent.value, view.astype("<f2").astype(np.float32), _meta_view(places))[2] >= REJECT_BELOW
                yield part.filter(pa.array(keep)).select(names)

    return seen.mapInArrow(run, docs.schema)
