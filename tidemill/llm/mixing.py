"""Mixing sources to target weights: capped water-filling over the sources, then seeded repetitions of their documents.

A source's target is its weight's share of the words that the mix may take, but no more than ``most`` times its own words: sources
above that are clamped there and what they leave is shared by weight among the others, until none is above. Every document is taken
as many whole times as the target holds its source; for the fraction that is left, documents follow each other in a
seeded order until the next one would pass the target, and one more document, the best fit, closes the gap.

A source may hold a third of all rows. Its order is cut into ranges of the seeded key, whose sums are added up; only the range
in which the fraction ends is put in order row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop_cut, join_split, word_array

SEED = "mix-1"


def document_sizes(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, key)``: words of the whole text (null: 0) and the seeded place of the document in its source's order."""
    words = F.size(word_array(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long")
    i = F.col(id_col).cast("long")
    return docs.select(i.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(i.cast("string"), F.lit("")))).alias("key"))


def in_turn(sources: DataFrame, weights: list[float]) -> DataFrame:
    """``sources`` with ``weight``: the weights, repeating, in the order of the sources' code points, null last.

    Sources are numbered range by range; a range adds the number of sources in the ranges before it.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    values = F.array(*(F.lit(float(w)) for w in weights))
    return dealt.join(F.broadcast(of), "__part").withColumn("weight", values[(place % len(weights)).cast("int")]).drop("__part", "before")


def water_level(sources: DataFrame, share: float, most: float) -> float:
    """Words for each unit of weight once no source is above ``most`` times its size. ``sources``: ``(source_size, weight)``.

    A round clamps every source above its limit and shares the rest by weight again; the driver sees two sums a round. Without
    words, or with every source clamped, the level is 0 and infinity.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size").alias("s")).first().s or 0
    level, clamped = 0.0, -1
    while True:
        above = cap < F.col("weight") * level
        r = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n")).first()
        if r.n == clamped or not total:
            return level
        clamped = r.n
        level = (total * share - r.taken) / r.weight if r.weight else math.inf


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, in words: ``share`` of all words by weight, at most ``most`` times the source."""
    level = water_level(sources, share, most)
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.lit(level)))


def plan(sizes: DataFrame, sources: DataFrame, digits: int | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for every row of ``sizes``: how often the mix takes each document.

    ``sizes``: (doc_id, source, size, key), a written table; ``sources``: (source, source_size, target, n), a row a source. A source's
    words taken differ from its target by less than the document at which the fraction ends, mostly by far less. Rows that repeat an id and a size
    are taken equally often. ``digits``: hex digits of the key that make a range; by default their number grows with the
    root of the number of rows, so both the ranges and the rows of one range do.
    """
    digits = digits or max(3, math.ceil(math.log(max(1, sizes.count()), 16) / 2))
    named = lambda df: df.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # noqa: E731  a null source is a source
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    of = named(sources).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = named(sizes).withColumn("range", F.substring("key", 1, digits)).withColumn("place", F.struct("key", "doc_id", "size"))
    ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("words"))
    upto = ranges.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("range")))
    ends = upto.join(of.select("s", "rest"), "s").where("upto > rest").groupBy("s").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    of = cut(of.join(ends, "s", "left").select("s", "source_size", "target", "whole", "rest", "n", "end.*"))
    last = join_split(rows, of.where("range is not null").select("s", F.col("range").alias("in_range"), "before", "rest", "n"), ["s"]).where("range = in_range")
    inside = last.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    edge = inside.groupBy("s").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("edge"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("filled"))
    known = cut(of.join(edge, "s", "left").select("*", (F.col("rest") - F.coalesce("filled", "before", "rest")).alias("gap")).drop("filled", "before"))
    joined = join_split(rows.withColumnRenamed("range", "own"), known, ["s"])
    once = (F.col("rest") > 0) & (F.col("range").isNull() | (F.col("own") < F.col("range")) | F.coalesce((F.col("own") == F.col("range")) & (F.col("place") <= F.col("edge")), F.lit(False)))
    joined = cut(joined.select("doc_id", "source", "s", "size", "source_size", "target", "key", "whole", "gap", once.cast("long").alias("once")))
    fit = F.abs(F.col("size") - F.col("gap"))
    best = joined.where((F.col("once") == 0) & (fit < F.col("gap"))).groupBy("s").agg(F.min(F.struct(fit.alias("fit"), "key", "doc_id", "size")).alias("b")).select("s", "b.key", "b.size", F.lit(1).cast("long").alias("fills"))
    filled = joined.join(best, ["s", "key", "size"], "left")
    return filled.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("once") + F.coalesce("fills", F.lit(0))).alias("copies"))


def mix_plan(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """:func:`plan` of ``docs`` (doc_id, text, source): sources in the order of their code points get ``weights`` in turn.

    Null texts have no words; the null source is a source, the last; rows with a null id are planned like others. A source without
    words has target 0 and an empty table gives an empty result; other columns are not read. The result depends on rows and seed alone.
    """
    sizes = cut(document_sizes(docs, seed))
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut(in_turn(found, weights))
    out = plan(sizes, targets(sources, share, most))
    drop_cut(sources)
    return out


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` that have an id, each as often as planned, with ``copy`` numbered from 1 (replacing a column so named)."""
    planned = mix_plan(docs, weights, share, most, seed).where("doc_id is not null and copies > 0").groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    names = [c for c in docs.columns if c != "copy"]
    return docs.join(planned, docs["doc_id"].cast("long") == planned["doc_id"]).select(*(docs[c] for c in names), F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))
