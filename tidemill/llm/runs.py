"""Periodic runs of words, found by uniting the suffixes of a text in the order of decreasing common prefixes.

The suffixes of a text are sorted, with the length of the longest common prefix (LCP) of neighbours. Going down from the largest LCP,
neighbours are united with union-find, whose classes are kept as ordered sets of positions. Where a union makes two positions
neighbours in such a set, their LCP is that of the union; at a distance d of at most LCP / (exponent - 1) they seed the run of
period d that starts at the first of them, if the word before does not carry the period on. Each run is seeded exactly once: between its start
and the position one period later no other position has so long a prefix in common, as the repeated words are primitive.

Unions below the least LCP that a run needs are left out, and so are texts in which no stretch of repeated word sequences is long
enough for its distances; both are proven to hold no run.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import grams, mix, slices, small_batches, word_array, words

MIN_LENGTH, EXPONENT = 6, 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def least_lcp(min_length: int, exponent: int) -> int:
    """The smallest LCP of a run's start and the position one period later, over all periods."""
    return min(max((exponent - 1) * d, min_length - d) for d in range(1, min_length + 1))


def _may_have_runs(h: np.ndarray, doc: np.ndarray, k: int, times: int) -> np.ndarray:
    """Documents in which a stretch of positions, all starting k words that come again, is long enough for their distances.

    A run of period q has (times * q) - k + 1 such positions at least in a row, and each comes again within q words.
    """
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64)
    g = mix(grams(h, k) ^ (doc[: n - k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    order = at[np.argsort(g[at], kind="stable")]
    same = g[order[1:]] == g[order[:-1]]
    far = np.zeros(n + 1, np.int64)  # 0: does not come again
    far[order[:-1][same]] = order[1:][same] - order[:-1][same]
    while True:
        on = far > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        stretch = np.repeat(end - begin, end - begin)
        where = np.flatnonzero(on)
        bad = where[far[where] * times > stretch + k - 1]
        if not len(bad):
            return np.unique(doc[where])
        far[bad] = 0


def _suffixes(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all documents in order, and the LCP of each with the one before it. ``ids`` tells documents apart."""
    n = len(ids)
    rank, levels, step = ids.astype(np.int64), [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if n == 0 or rank.max() == n - 1:
            break
        after = np.zeros(n, np.int64)
        if step < n:
            inside = doc[step:] == doc[:-step]
            after[: n - step][inside] = rank[step:][inside] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        padded = np.concatenate([levels[level], [-1]])
        i, j = np.minimum(a + shared, n), np.minimum(b + shared, n)
        equal = (padded[i] == padded[j]) & (i < n) & (j < n)
        shared[equal] += 1 << level
    lcp[1:] = shared
    return order, lcp


def _unite(order: np.ndarray, lcp: np.ndarray, ids: np.ndarray, first: np.ndarray, low: int, min_length: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in positions of the whole slice. ``first`` is true at the first word of a document."""
    edges = np.flatnonzero(lcp >= low)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    word, opens = ids.tolist(), first.tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for p, q, common in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist(), strict=True):
        for x in (p, q):
            if x not in parent:
                parent[x], members[x] = x, [x]
        a, b = root(p), root(q)
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        spots = [bisect_left(large, x) for x in small]
        for i, (x, spot) in enumerate(zip(small, spots, strict=True)):
            # neighbours of x that come from the other set: unless another member of the small one lies between
            if spot and (i == 0 or spots[i - 1] != spot):
                y = large[spot - 1]
                if common >= times * (x - y) and common + x - y >= min_length and (opens[y] or word[y - 1] != word[x - 1]):
                    found.append((y, common + x - y, x - y))
            if spot < len(large) and (i + 1 == len(small) or spots[i + 1] != spot):
                y = large[spot]
                if common >= times * (y - x) and common + y - x >= min_length and (opens[x] or word[x - 1] != word[y - 1]):
                    found.append((x, common + y - x, y - x))
        if len(small) > 8:
            large += small
            large.sort()
        else:
            for x, spot in zip(reversed(small), reversed(spots), strict=True):
                large.insert(spot, x)
        parent[b] = a
        del members[b]
    return found


def find_runs(h: np.ndarray, doc: np.ndarray, n_docs: int, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each document its runs (start, length, period) by start and period. ``h``: hash of each word, ``doc``: its document."""
    low, out = least_lcp(min_length, exponent), [[] for _ in range(n_docs)]
    asked = _may_have_runs(h, doc, low, exponent - 1)
    at = np.flatnonzero(np.isin(doc, asked))
    if not len(at):
        return out
    h, doc = h[at], doc[at]
    ids = np.unique(h, return_inverse=True)[1]
    ids = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True)[1]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    begin = np.flatnonzero(first)
    start_of = begin[np.cumsum(first) - 1]
    order, lcp = _suffixes(ids, doc)
    for start, length, period in _unite(order, lcp, ids, first, low, min_length, exponent - 1):
        out[doc[start]].append((start - int(start_of[start]), length, period))
    for runs in out:
        runs.sort()
    return out


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row: the maximal runs (start, length, period) of the whole text's words and the text without them.

    A run is a stretch of words with smallest period q that is at least ``min_length`` and ``exponent`` * q long (exponent at least
    2) and that no neighbouring word carries on. ``collapsed`` holds the words, joined by one space, that no run contains
    after its first q words. Null and empty texts have no words; null and repeated ids each keep their rows; an empty table gives an
    empty result; other columns are not read. Words are told apart by 64-bit hashes. A text is searched in one task, in
    about 200 bytes a byte of text.
    """
    if exponent < 2:
        raise ValueError("the exponent of a run is at least 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                found = find_runs(w.hash, w.doc, w.n_docs, min_length, exponent)
                joined, start, end = w.squeezed()
                first = w.first.tolist()
                texts = []
                for k, runs in enumerate(found):
                    a, b = first[k], first[k + 1]
                    if not runs:
                        texts.append(joined[start[a] : end[b - 1]] if b > a else b"")
                        continue
                    keep = np.flatnonzero(_kept(b - a, runs)) + a
                    texts.append(b" ".join(joined[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)))
                spans = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), spans, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with a periodic end: the query's own test pattern.

    With h the CRC32 of the decimal id and g = h div 10, a text of n words whose h is divisible by 10 repeats its p words from word
    a = g mod n on, where p = 1 + (n - a) div (3 + g mod 8). Null ids leave the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def tail(v: Column) -> Column:
        n = F.size(v).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        again = F.flatten(F.array_repeat(F.slice(v, (a + 1).cast("int"), p.cast("int")), (F.floor((n - a) / p) + 1).cast("int")))
        return F.array_join(F.concat(F.slice(v, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")

    one = F.transform(F.array(word_array(F.coalesce(text, F.lit("")))), lambda v: F.when(F.size(v) > 0, tail(v)).otherwise(""))[0]
    return F.when(h % 10 == 0, one).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query: how many runs, the longest (smallest start, then period, of equals), and SHA-256 digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(best["length"] * 1000 / -best["period"]).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
