"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles: 0.8 or more, no pair missed.

A candidate is verified on the complete sets. The first candidates are SimHash links: fingerprints of the shingles at most two
bits apart. Sets at 0.8 may differ in more bits than a fingerprint's balls reach; those that are still in different components
are found by their shingles. Every set's shingles are put in one global order, those common in a sample last. Two sets at 0.8
share a shingle among the first fifth (and one) of each, so only these prefixes are joined: every member of a prefix shingle is
held against a few hubs, which joins large groups of copies in linear time; then the pairs of a shingle against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, components, cut, drop_cut, free_name, grams, join_split, mix, slices, small_batches, words
from .simhash import fingerprints, links

#: Shingles of one in ``SAMPLED`` documents are counted for the order, the ``RANKED`` most common go last. The order costs time, never a pair.
SAMPLED, RANKED = 16, 100_000
ODD = [f"odd{i}" for i in range(16)]
#: Members of a shingle that all its others are held against in the first round.
HUBS = 8
#: More rows than this are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the document and the hash of each distinct shingle; fewer words than ``k`` make one shingle of them all."""
    first = w.first[:-1]
    n = np.diff(w.first)
    g = grams(w.hash, k)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    doc, h = [w.doc[at]], [g[at]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            doc.append(short)
            h.append(grams(w.hash, m)[first[short]])
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str, common: np.ndarray | None = None, prefix: bool = False) -> DataFrame:
    """``(doc_id, sid, n, shingles, odd0..odd15)``: a hash of the whole set, its size, its hashes in the global order (its prefix
    only, if asked), and which of 1,024 classes hold an odd number of them: two sets differ in as many hashes at least as classes."""
    rank = np.zeros(0, np.uint64) if common is None else common
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(rank), np.argsort(rank)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        for batch in batches:
            for part in slices(batch):
                doc, h = _sets(words(part.column("text"), lower=True), shingle)
                n = np.bincount(doc, minlength=len(part)).astype(np.int64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
                ends = np.concatenate([[0], np.cumsum(n)])
                sid = mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64))
                odd = np.bincount(doc * 1024 + (h >> np.uint64(54)).astype(np.int64), minlength=1024 * len(part)).reshape(-1, 1024) & 1
                odd = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                late = np.zeros(len(h), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = np.where(known[i] == h, len(known) - place[i], 0)
                h = h[np.lexsort((h, late, doc))]
                if prefix:
                    most = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                    h = h[np.arange(len(h)) - np.repeat(ends[:-1], n) < np.repeat(most, n)]
                    ends = np.concatenate([[0], np.cumsum(most)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sid.view(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64))), *(pa.array(odd[:, i].copy()) for i in range(len(ODD)))], ["doc_id", "sid", "n", "shingles", *ODD])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, sid long, n long, shingles array<long>, " + ", ".join(f"{c} long" for c in ODD))


def _common(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> np.ndarray:
    """The most common shingles of a sample, the most common first."""
    some = shingle_sets(docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLED)) == 0), shingle, id_col, text_col)
    c = some.select(F.explode("shingles").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(RANKED).select("h").collect()
    return np.array([r.h for r in c], np.int64).view(np.uint64)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` of set hashes whose complete sets reach 0.8."""
    found = cut(pairs.distinct())
    # a hub is in many pairs, so its sketch is joined apart
    sketches = {s: cut(distinct.select(F.col("sid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", *ODD))).join(found.groupBy(s).agg(F.count("*").alias("hits")), s)) for s in "ab"}
    pairs = join_split(join_split(found, sketches["a"], ["a"], "hits"), sketches["b"], ["b"], "hits")
    pairs = cut(pairs.where("9 * (" + " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in ODD) + ") <= a_n + b_n").select("a", "b"))
    for done in (found, *sketches.values()):
        drop_cut(done)
    asked = cut(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    name = free_name("__asked", docs)
    ids = cut(distinct.join(asked, "sid", "left_semi").select(F.col("first").alias(name)).distinct())
    full = shingle_sets(docs.join(_few(ids), docs[id_col] == F.col(name), "left_semi"), shingle, id_col, text_col)
    full = cut(full.join(_few(asked), "sid", "left_semi").select("sid", "shingles"))
    x = _few(pairs).join(full.select(F.col("sid").alias("a"), F.col("shingles").alias("s")), "a").join(full.select(F.col("sid").alias("b"), F.col("shingles").alias("t")), "b")
    good = cut(x.where("9 * size(array_intersect(s, t)) >= 4 * (size(s) + size(t))").select("a", "b").distinct())
    for done in (pairs, asked, ids, full):
        drop_cut(done)
    return good


def _fingerprint_pairs(distinct: DataFrame, docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``(a, b)`` of set hashes that connect all sets whose SimHash fingerprints are at most two bits apart."""
    sets = distinct.where("first is not null").select("sid", "first")
    fps = cut(sets.join(fingerprints(docs, shingle, id_col, text_col), F.col("first") == F.col("doc_id")).select("sid", "fp").distinct())
    least = cut(fps.groupBy("fp").agg(F.min("sid").alias("first"), F.count("*").alias("hits")))
    same = join_split(fps, least, ["fp"], "hits").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    return same.union(links(least.select("fp", "first")).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_components(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` for every row: the smallest id reachable over pairs of Jaccard similarity 0.8 or more.

    Equal sets are linked, and so are texts without a word. Rows with a null id never name or link a component.
    """
    every = cut(shingle_sets(docs, shingle, id_col, text_col, _common(docs, shingle, id_col, text_col), True))
    distinct = cut(every.groupBy("sid").agg(F.min("doc_id").alias("first"), *(F.any_value(c).alias(c) for c in ("n", "shingles", *ODD))))
    keys = distinct.where("first is not null").select("sid", "n", F.posexplode("shingles").alias("pos", "key"))
    keys = cut(keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key"))
    alike = _verified(_fingerprint_pairs(distinct, docs, shingle, id_col, text_col), distinct, docs, shingle, id_col, text_col)
    before, keys = keys, cut(keys.join(components(alike, "a", "b").withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    drop_cut(before)
    hubs = keys.groupBy("key").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("sid", F.lit(i)).alias("by"), "sid", "n", "pos", "component")).dropFields("by") for i in range(HUBS)))).alias("hubs"))
    # at a pair's first common shingle the rest of either set bounds what they share
    near = "9 * least({0}n - {0}pos, {1}n - {1}pos) >= 4 * ({0}n + {1}n)"
    star = keys.join(hubs, "key").select("sid", "n", "pos", "component", F.explode("hubs").alias("hub")).where("component <> hub.component").where(near.format("", "hub."))
    one = _verified(star.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")), distinct, docs, shingle, id_col, text_col).union(alike)
    found = components(one, "a", "b").withColumnRenamed("node", "sid")
    before, keys = keys, cut(keys.drop("component").join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    drop_cut(before)
    mixed = keys.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.mode("component").alias("main")).where("x < y").select("key", "main")
    before, keys = keys, cut(keys.join(mixed, "key").join(distinct.select("sid", *ODD), "sid"))
    drop_cut(before)
    # two members of the largest component need no comparison, so only those outside it are held against all
    rest = keys.where("component <> main").alias("u").join(keys.alias("v"), "key").where("u.component <> v.component and (v.component = v.main or u.sid < v.sid)").where(near.format("u.", "v.")).where("9 * (" + " + ".join(f"bit_count(u.{c} ^ v.{c})" for c in ODD) + ") <= u.n + v.n")
    two = _verified(rest.select(F.least("u.sid", "v.sid").alias("a"), F.greatest("u.sid", "v.sid").alias("b")), distinct, docs, shingle, id_col, text_col)
    drop_cut(keys)
    found = components(one.union(two), "a", "b").withColumnRenamed("node", "sid")
    labels = cut(distinct.select("sid", "first").join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    return every.select("doc_id", "sid").join(labels.join(least, "component").select("sid", "component_id"), "sid").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all its columns, one document of each near-duplicate group: the one with the smallest id.

    Rows with a null id stay. Rows that repeat the kept id stay.
    """
    name = free_name("__drop", docs)
    drop = near_components(docs, shingle, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs[id_col] == F.col(name), "left_anti")
