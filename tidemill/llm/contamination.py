"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search.

An item with n distinct shingles is contained when at least T of them occur in a document, T = ceil(0.8 n). Items are
partitioned by size; in a partition with most u shingles an item's sketch is its k = u - ceil(0.8 u) + 1 smallest shingle
hashes (all of them if it has fewer). A document that contains the item misses at most n - T <= k - 1 shingles, so it
holds at least one hash of the sketch: the search loses nothing. Documents that hit a sketch are then verified by the
exact containment of shingle texts. Documents are read once: what they share with any item is kept for the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name

SHINGLE, CONTAINMENT = 5, 0.8
#: Bytes of benchmark shingles that may be broadcast; more are joined by a shuffle. Nothing that grows with the documents is broadcast.
BROADCAST_BYTES = 64 << 20


def _words(text: str) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.expr(f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')")


def _shingles(w: str, k: str) -> str:
    """SQL: the shingles of ``k`` words of the array ``w``."""
    return f"if(size({w}) >= {k}, transform(sequence(0, size({w}) - {k}), i -> array_join(slice({w}, i + 1, {k}), ' ')), array())"


def _fixed_shingles(w: str, k: int) -> str:
    joined = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return f"if(size({w}) >= {k}, transform(sequence(0, size({w}) - {k}), i -> concat_ws(' ', {joined})), array())"


def contained_items(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)``: each document and item of which it holds the given share or more.

    Shingles are ``shingle`` consecutive words (lower-case letters and digits), as sets; an item with fewer words is
    one shingle of them all. Items without a word and null texts match nothing; equal items each match; rows with a
    null id are left out; rows that repeat an id are one document. Documents without a match have no row.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("w")).where("size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(shingle)))
    own = items.select("item_id", F.explode(F.expr(_shingles("w", "k"))).alias("s")).groupBy("item_id").agg(F.collect_set("s").alias("s")).withColumn("n", F.size("s"))
    # size partitions [2^j, 2^(j+1)): the sketch's length is that of the largest size
    top = (F.pow(2.0, F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1).cast("int")
    length = (top - F.ceil(top * F.lit(containment) - 1e-9) + 1).cast("int")
    ordered = F.expr("array_sort(transform(s, s -> struct(xxhash64(s) as h, s as s)))")
    index = cut(own.select("item_id", "n", length.alias("length"), F.posexplode(ordered).alias("pos", "x")).select("item_id", "n", "x.h", "x.s", (F.col("pos") < F.col("length")).alias("in_sketch")))
    volume = index.agg(F.sum(F.octet_length("s") + 48)).first()[0] or 0
    small = F.broadcast if volume <= BROADCAST_BYTES else lambda df: df
    sizes = [r.k for r in items.select("k").distinct().collect()]  # at most ``shingle`` values
    keys = index.groupBy("h", "s").agg(F.max("in_sketch").alias("in_sketch"))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("w"))
    every = F.expr("concat(" + ", ".join(_fixed_shingles("w", k) for k in sizes or [shingle]) + ")")
    shingles = docs.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s", F.xxhash64("s").alias("h"))
    hits = shingles.join(small(keys.select("h").distinct()), "h", "left_semi").join(small(keys), ["h", "s"])
    hits = cut(hits.select("doc_id", "h", "s", "in_sketch").distinct())
    sketches = index.where("in_sketch").select("h", "s", "item_id")
    pairs = hits.where("in_sketch").join(small(sketches), ["h", "s"]).select("doc_id", "item_id").distinct()
    asked = pairs.join(small(index.select("item_id", "n", "s")), "item_id")
    shared = asked.join(hits.select("doc_id", "s"), ["doc_id", "s"]).groupBy("doc_id", "item_id", "n").agg(F.count("*").cast("int").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(F.col("n") * containment - 1e-9)).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text contains no benchmark item; rows with a null id or text stay."""
    name = free_name("__bad", docs)
    bad = contained_items(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == F.col(name), "left_anti")
