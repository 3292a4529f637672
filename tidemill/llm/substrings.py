"""Substring dedup: prefix-partitioned suffix trees over word sequences.

Every window of ``WINDOW`` words has one anchor, its five-word sequence of smallest hash (leftmost on ties). The trees hold
the suffixes that start at anchors: equal windows have equal anchors at equal places, so such a suffix and the words
left of it stand for all windows around its anchor. Suffixes whose anchor is in one document only repeat nothing and are left out.

Suffixes are dealt by prefix, and prefixes vary in length by exact counts: the anchor's five words, or, where more than HOT_ROWS
suffixes begin with them, all words of a window (such a prefix is a whole repeat, so its group needs no more than a minimum). A task
takes groups up to a bounded number of suffixes, sorts them, and measures what neighbours share: runs that share d words are the inner
nodes of depth d. A window with j words left of its anchor repeats where suffixes meet in a node of depth ``WINDOW`` - j and their j
words to the left are equal too; the smallest document there is the window's first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_ROWS, cut, drop_cut, grams, join_split, mix, slices, small_batches, words

WINDOW = 13
ANCHOR = 5
#: Suffixes that one tree is built from at a time (whole prefix groups), distinct segments that a task keeps before it sends them.
CHUNK, HELD = 20_000, 100_000


def _anchored(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's first word, its anchor's word and its anchor's hash."""
    n = len(w.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(w.hash, ANCHOR)
    spread = WINDOW - ANCHOR + 1
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, spread):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        at[less] = j
    whole = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
    return whole, whole + at[whole], best[whole]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"))
            first, at, h = _anchored(w)
            new = np.ones(len(first), bool)
            new[1:] = (at[1:] != at[:-1]) | (w.doc[first[1:]] != w.doc[first[:-1]])
            ids = part.column("doc_id").take(pa.array(w.doc[first[new]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[new].view(np.int64))], ["doc_id", "anchor"])


def _two_hashes(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each run of n words from first."""
    out = []
    for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.zeros(len(first), np.uint64)
        for j in range(int(n.max(initial=0))):
            more = j < n
            total[more] = mix(total[more] * np.uint64(k) + h[first[more] + j])
        out.append((total + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _segments(part: pa.RecordBatch):
    """The segments of a slice of (text, anchors, whole): a suffix with the windows around its anchor, or one window where the anchor is frequent.

    Words, first word, number of windows, the anchor's place in it, whether it is one whole window, its prefix and its 128-bit hash.
    """
    w = words(part.column("text"))
    first, at, h = _anchored(w)
    of, whole = part.column("anchors"), part.column("whole")
    lists, flat, long = np.asarray(of.offsets), np.asarray(of.values, dtype=np.int64), np.asarray(whole.values)
    doc = np.repeat(np.arange(len(of)), np.diff(lists))
    known = mix(flat[lists[0] : lists[-1]].view(np.uint64) + mix(doc.astype(np.uint64)))
    order = np.argsort(known)
    known, long = known[order], long[lists[0] : lists[-1]][order]
    if not len(known):
        first, at, h, is_whole = first[:0], at[:0], h[:0], np.zeros(0, bool)
    else:
        key = mix(h + mix(w.doc[first].astype(np.uint64)))
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        good = known[place] == key
        first, at, h, is_whole = first[good], at[good], h[good], long[place[good]]
    new = np.ones(len(first), bool)
    new[1:] = is_whole[1:] | (at[1:] != at[:-1]) | (w.doc[first[1:]] != w.doc[first[:-1]]) | (first[1:] != first[:-1] + 1)
    begins = np.flatnonzero(new)
    runs = np.diff(np.r_[begins, len(first)])
    head = first[begins]
    a, b = _two_hashes(w.hash, head, runs + WINDOW - 1)
    return w, head, runs, (at - first)[begins], is_whole[begins], np.where(is_whole[begins], a, h[begins].view(np.int64)), a, b


_SENT = ["prefix", "s1", "s2", "doc_id", "n", "anchor_at", "words"]


def _emit_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a task's documents with how often they occur and the smallest id that holds them; a whole window needs no words."""
    seen: dict[tuple[int, int], list] = {}

    def out() -> pa.RecordBatch:
        keys, values = zip(*seen.items(), strict=True)
        s1, s2 = zip(*keys, strict=True)
        p, i, n, at, text = zip(*values, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.string())], _SENT)

    for batch in batches:
        for part in slices(batch):
            w, head, runs, at, whole, prefix, a, b = _segments(part)
            if not len(head):
                continue
            text, start, end = w.squeezed()
            ids = np.asarray(part.column("doc_id"))[w.doc[head]]
            rows = zip(prefix.tolist(), a.tolist(), b.tolist(), ids.tolist(), at.tolist(), whole.tolist(), start[head].tolist(), end[head + runs + WINDOW - 2].tolist(), strict=True)
            for p, x, y, i, k, one, s, e in rows:
                old = seen.get((x, y))
                if old is None:
                    seen[x, y] = [p, i, 1, k, None if one else text[s:e].decode()]
                else:
                    old[1] = min(old[1], i)
                    old[2] += 1
            if len(seen) > HELD:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w, head, _, _, _, _, a, b = _segments(part)
            ids = part.column("doc_id").take(pa.array(w.doc[head]))
            text = part.column("text_hash").take(pa.array(w.doc[head]))
            yield pa.RecordBatch.from_arrays([ids, text, pa.array((head - w.first[w.doc[head]]).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "text_hash", "at", "s1", "s2"])


def _merged(part: pa.RecordBatch, lists: pa.Array) -> pa.RecordBatch:
    """(s1, s2, least, n), once a segment: several tasks may have sent it."""
    pairs = np.stack([np.asarray(part.column("s1")), np.asarray(part.column("s2"))])
    _, once, back = np.unique(pairs, axis=1, return_index=True, return_inverse=True)
    count = np.bincount(back.ravel(), np.asarray(part.column("n")), len(once)).astype(np.int64)
    out = pa.RecordBatch.from_arrays([part.column("s1"), part.column("s2"), lists], ["s1", "s2", "least"]).take(pa.array(once))
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(count)], ["s1", "s2", "least", "n"])


def _leaves(part: pa.RecordBatch) -> pa.RecordBatch:
    """Groups whose prefix is a whole window: the smallest document of each."""
    prefix, ids = np.asarray(part.column("prefix")), np.asarray(part.column("doc_id"))
    order = np.lexsort((np.asarray(part.column("s2")), prefix))
    s2 = np.asarray(part.column("s2"))[order]
    begins = np.flatnonzero(np.r_[True, (prefix[order][1:] != prefix[order][:-1]) | (s2[1:] != s2[:-1])])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.r_[begins, len(ids)]))
    return _merged(part, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), pa.array(least)))


def _subtrees(part: pa.RecordBatch) -> pa.RecordBatch:
    """The subtrees of whole prefix groups: for every segment the smallest document that has each of its windows."""
    w = words(part.column("words"))
    head = w.first[:-1]
    windows = np.diff(w.first) - WINDOW + 1
    anchor_at = np.asarray(part.column("anchor_at"), dtype=np.int64)
    ids = np.asarray(part.column("doc_id"))
    n = len(head)
    anchor = head + anchor_at
    # the suffixes from the anchors, as far as a window can reach, in the order of their words
    within = anchor[:, None] + np.arange(WINDOW) < w.first[1:][:, None]
    suffix = np.where(within, w.hash[np.minimum(anchor[:, None] + np.arange(WINDOW), len(w.hash) - 1)], np.uint64(0))
    order = np.lexsort(suffix.T[::-1])
    suffix = suffix[order]
    common = np.r_[0, np.logical_and.accumulate(suffix[1:] == suffix[:-1], axis=1).sum(axis=1)]
    left = np.zeros(n, np.uint64)  # hash of the j words left of the anchor
    least = np.full((n, WINDOW - ANCHOR + 1), np.iinfo(np.int64).max)
    for j in range(WINDOW - ANCHOR + 1):
        node = np.empty(n, np.int64)
        node[order] = np.cumsum(common < WINDOW - j)  # the node of depth WINDOW - j above each suffix
        has = np.flatnonzero((anchor_at >= j) & (anchor_at - j < windows))
        if len(has):
            by = has[np.lexsort((left[has], node[has]))]
            begins = np.flatnonzero(np.r_[True, (node[by][1:] != node[by][:-1]) | (left[by][1:] != left[by][:-1])])
            least[by, j] = np.repeat(np.minimum.reduceat(ids[by], begins), np.diff(np.r_[begins, len(by)]))
        more = np.flatnonzero(anchor_at > j)
        left[more] = mix(left[more] * np.uint64(0xA0761D6478BD642F) + w.hash[anchor[more] - 1 - j])
    seg = np.repeat(np.arange(n), windows)
    i = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(windows)].astype(np.int32)), pa.array(least[seg, anchor_at[seg] - i]))
    return _merged(part, lists)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by prefix: whole prefixes are gathered to groups of about CHUNK segments, one tree after another."""
    rest: list[pa.RecordBatch] = []

    def grown(final: bool):
        nonlocal rest
        table = pa.Table.from_batches(rest).combine_chunks()
        prefix = np.asarray(table.column("prefix").chunk(0))
        stop = len(prefix) if final else int(np.searchsorted(prefix, prefix[-1], side="left"))
        rest = [] if final else table.slice(stop).to_batches()
        done = 0
        while done < stop:
            to = min(stop, done + CHUNK)
            to = max(to, int(np.searchsorted(prefix[:stop], prefix[to - 1], side="right")))
            some = table.slice(done, to - done).combine_chunks().to_batches()[0]
            whole = pc.is_null(some.column("words"))
            for part, of in ((some.filter(pc.invert(whole)), _subtrees), (some.filter(whole), _leaves)):
                if part.num_rows:
                    yield of(part)
            done = to

    held = 0
    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
            held += batch.num_rows
            if held >= CHUNK:
                yield from grown(False)
                held = sum(x.num_rows for x in rest)
    if rest:
        yield from grown(True)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words(part.column("text"), hashed=False)
            text, start, end = w.squeezed()
            starts = part.column("starts").to_pylist()
            copy = part.column("copy").to_pylist()
            n, removed, digest, kept = [], [], [], []
            for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
                gone = np.zeros(b - a, bool)
                if copy[i]:
                    gone[:] = b - a >= WINDOW
                elif starts[i]:
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, starts[i], 1)
                    np.add.at(edge, np.asarray(starts[i]) + WINDOW, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                if gone.any():
                    left = b" ".join(text[x:y] for x, y in zip(start[a:b][~gone].tolist(), end[a:b][~gone].tolist(), strict=True))
                else:
                    left = text[start[a] : end[b - 1]] if b > a else b""
                n.append(b - a)
                removed.append(int(gone.sum()))
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for every row: ``kept`` is the text without words that a 13-word window covers whose sequence also starts in a document of smaller id.

    Words are runs without ASCII white space, unchanged; windows are judged on the input. A null text has no words;
    a row with a null id loses nothing and takes nothing from others; rows that repeat an id are one document and
    take nothing from each other. Fewer than 13 words stay whole. Other columns are not read.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = docs.where("doc_id is not null")

    # a document equal to an earlier one repeats it whole
    ids = cut(keyed.select("doc_id", F.unhex(F.md5("text")).alias("md5"), F.hash("text").alias("text_hash")))
    same = cut(ids.groupBy("md5").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("md5", "least", "n"))
    copies = cut(join_split(ids, same, ["md5"]).where("doc_id > least").select("doc_id", "text_hash").distinct())

    pairs = cut(keyed.mapInArrow(_anchors, "doc_id long, anchor long"))
    counts = pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    counts = cut(counts.select("anchor", (F.col("n") > HOT_ROWS).alias("whole"), "n"))
    wanted = join_split(pairs, counts, ["anchor"]).groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "whole")).alias("anchors"))
    wanted = cut(wanted.select("doc_id", F.col("anchors.anchor").alias("anchors"), F.col("anchors.whole").alias("whole")))
    drop_cut(pairs)

    few = copies.select(F.col("doc_id"), F.col("text_hash").alias("copy_hash")).groupBy("doc_id").agg(F.collect_set("copy_hash").alias("copy_hashes"))
    texts = keyed.join(wanted, "doc_id").join(few, "doc_id", "left").withColumn("text_hash", F.hash("text"))
    texts = texts.where("copy_hashes is null or not array_contains(copy_hashes, text_hash)").select("doc_id", "text", "text_hash", "anchors", "whole")
    suffixes = texts.mapInArrow(_emit_suffixes, "prefix long, s1 long, s2 long, doc_id long, n long, anchor_at int, words string")
    trees = cut(suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees, "s1 long, s2 long, least array<long>, n long"))
    at = texts.mapInArrow(_emit_places, "doc_id long, text_hash int, at int, s1 long, s2 long")
    later = join_split(at, trees, ["s1", "s2"]).select("doc_id", "text_hash", F.expr("filter(transform(least, (x, i) -> if(x < doc_id, at + i, null)), x -> x is not null)").alias("starts")).where("size(starts) > 0")
    covered = later.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    gone = covered.select("doc_id", F.struct("text_hash", "starts", F.lit(False).alias("copy")).alias("x")).union(copies.select("doc_id", F.struct("text_hash", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))))
    gone = cut(gone.groupBy("doc_id").agg(F.collect_list("x").alias("xs")))
    marked = docs.join(gone, "doc_id", "left").select("doc_id", "text", F.expr("filter(xs, x -> x.text_hash = hash(text))[0]").alias("x")).select("doc_id", "text", F.col("x.starts").alias("starts"), F.coalesce("x.copy", F.lit(False)).alias("copy"))
    return marked.mapInArrow(_cover, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
