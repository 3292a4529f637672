"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

A fingerprint has two 32-bit segments, and each segment a table from its value to the fingerprints that have it. Two
fingerprints that differ in at most two bits differ in at most one bit of some segment, so each fingerprint looks up the
ball of radius one around each of its segments and the matches are verified on the complete distance. Of two values one
bit apart one has that bit set, so it is enough that every fingerprint clears its own bits one by one.

A bucket with many distinct fingerprints is not fetched. Fingerprints that look into one, its own included, are looked up by
the ball of radius one around the complete fingerprint instead: two of them share such a key exactly when they are at most two
bits apart, a key has at most 65 members, and these link to its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, cut, join_split, slices, small_batches, words

MAX_BITS, SEGMENT = 2, 32
#: Distinct fingerprints of a bucket that are fetched; larger buckets are split by complete fingerprints.
BUCKET = 256


def _fingerprints(w, k: int) -> np.ndarray:
    """Fingerprints of the documents of ``w``; a bit is one if set in over half of the shingles' XXH64 hashes (seed 42)."""
    text, start, end = w.squeezed()
    first = w.first
    n = np.diff(first)
    many = np.maximum(n - k + 1, np.minimum(n, 1))
    out = np.zeros(w.n_docs, np.uint64)
    if not many.sum():
        return out
    doc = np.repeat(np.arange(w.n_docs), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    last = np.minimum(at + k - 1, first[doc + 1] - 1)
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(text[a:b], 42) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    full = np.flatnonzero(many)
    begins = (np.cumsum(many) - many)[full]
    ones = np.empty((len(full), 64), np.int64)
    for j in range(8):  # a byte of the hashes at a time keeps the unpacked bits small
        bits = np.unpackbits(((h >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        ones[:, 8 * j : 8 * j + 8] = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    over = (2 * ones > many[full][:, None]).astype(np.uint64)
    out[full] = (over << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the SimHash of each whole text as a signed 64-bit integer.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than ``shingle`` make one shingle of
    them all; no word (null, empty) makes fingerprint 0. Rows that repeat an id each get a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = _fingerprints(words(part.column("text"), lower=True, hashed=False), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment_keys(ball: bool) -> str:
    """SQL: the (segment, value) keys of ``fp``, each packed in one long; with ``ball`` also those with one of its set bits cleared."""
    out = []
    for k in range(64 // SEGMENT):
        low, high = k * SEGMENT, k * SEGMENT + SEGMENT - 1
        value = f"shiftrightunsigned(fp, {low}) & {(1 << SEGMENT) - 1}L"
        out.append(f"array(({value}) | {k << SEGMENT}L)")
        if ball:
            set_bits = f"filter(sequence({low}, {high}), i -> getbit(fp, i) = 1)"
            out.append(f"transform({set_bits}, i -> (({value}) ^ shiftleft(1L, i - {low})) | {k << SEGMENT}L)")
    return f"concat({', '.join(out)})"


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of ids that connect fingerprints at most two bits apart. ``distinct``: ``(fp, first)``, one row a fingerprint.

    Every pair outside the split buckets has an edge; in those, members of a key are linked to the key's smallest: the components
    are those of all pairs.
    """
    table = distinct.select("fp", "first", F.explode(F.expr(_segment_keys(False))).alias("key"))
    probes = distinct.select("fp", "first", F.explode(F.expr(_segment_keys(True))).alias("key"))
    large = cut(table.groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
    split = large.count() > 0
    if split:
        crowded = cut(probes.join(large, "key", "left_semi").select("fp", "first").distinct())
        table, probes = (x.join(large, "key", "left_anti") for x in (table, probes))
    other = table.select("key", F.col("fp").alias("fp2"), F.col("first").alias("first2"))
    near = probes.join(other, "key").where(f"fp <> fp2 and bit_count(fp ^ fp2) <= {MAX_BITS}").select(F.col("first").alias("a"), F.col("first2").alias("b"))
    if not split:
        return near
    ball = crowded.select("fp", "first", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("key"))
    hub = F.min("first").over(Window.partitionBy("key"))
    return near.union(ball.select(F.col("first").alias("a"), hub.alias("b")).where("a <> b"))


def simhash_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: component_id is the smallest id reachable over links of at most two bits.

    Null, empty and equal texts are linked like any others. Rows with a null id get the component of their
    fingerprint and never name one; an empty table gives an empty result. Other columns are not read.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = components(links(distinct.where("first is not null")), "a", "b")
    labels = distinct.join(found, distinct["first"] == found["node"], "left").select("fp", "n", F.coalesce("component", "first").alias("component_id"))
    labels = cut(labels)
    return join_split(fps, labels, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
