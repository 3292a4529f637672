"""Filter interaction audit: which filter of a chain removes what, for every order of the filters.

Repeated texts are found behind a counting Bloom sketch: every text adds one to four counters of one bucket, the counts of all
tasks are merged, and a text one of whose counters stays at one is unique for certain. Only what is left, the possible repeats, is shuffled
as whole text for the exact smallest id. The flags of a document make a mask of one bit a filter; all figures of all orders are
sums over the counts of the masks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, word_array

FILTERS = "ABCDE"
#: Counters of a bucket (what one bitmap of Spark holds), counters a text adds to, counters for each text.
BUCKET, PROBES, ROOM = 32768, 4, 8
#: Most buckets, so that what is broadcast (4 KB a bucket) is bounded: 64 MB. Above 67 million texts more possible repeats are left, never fewer.
MAX_BUCKETS = 16384


def failures(text: Column) -> Column:
    """The bits of A (under 50 words), B (few distinct words), C (many capitals) and D (marks) of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = word_array(text)
    few = F.size(words) < 50
    alike = F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long")
    shouting = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(5).cast("long")
    marked = text.rlike("[#$%&*|]")
    return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, alike, shouting, marked))), F.lit(0))


def _places(h: str, buckets: int) -> tuple[Column, list[Column]]:
    """The bucket of a hashed text and its counters there."""
    other = F.xxhash64(h, F.lit("slot"))
    return F.pmod(F.col(h), F.lit(buckets)), [F.shiftrightunsigned(other, 15 * k).bitwiseAND(F.lit(BUCKET - 1)) for k in range(PROBES)]


def sketch(hashed: DataFrame, buckets: int, h: str = "h") -> DataFrame:
    """``(bucket, bits)``: a bit for each counter that two texts or more add to; buckets without any are left out.

    Tasks count on their own first, the shuffle merges their counts.
    """
    bucket, slots = _places(h, buckets)
    counts = hashed.select(bucket.alias("bucket"), F.explode(F.array_distinct(F.array(*slots))).alias("slot")).groupBy("bucket", "slot").count()
    return counts.where("count > 1").groupBy("bucket").agg(F.bitmap_construct_agg("slot").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame, buckets: int, h: str = "h") -> DataFrame:
    """``rows`` with ``maybe``: true where all counters are over one. The broadcast of ``bits`` is bounded, so ``rows`` stay where they are."""
    bucket, slots = _places(h, buckets)
    byte = lambda s: F.conv(F.hex(F.col("bits").substr((s / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.lit(True)
    for s in slots:
        hit = hit & (F.getbit(byte(s), (s % 8).cast("int")) == 1)
    joined = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("bucket", "bits")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(doc_id, part, mask)`` for every row of ``docs``: bit k of mask is set where filter k of FILTERS fails.

    E fails where a row of smaller id has the same text; a null id is neither smaller nor larger than another, and rows that
    repeat an id and its text do not remove each other. Null texts are empty, a null part is the empty string; an empty table
    gives no rows; other columns are not read. Texts are read twice and shuffled only where a repeat is possible; all else works on
    (id, part, hash, mask).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = cut(known.select("doc_id", "part", F.xxhash64("text").alias("h"), failures(F.col("text")).alias("mask")))
    buckets = max(1, min(MAX_BUCKETS, -(-narrow.count() * ROOM // BUCKET)))
    bits = cut(sketch(narrow, buckets))
    texts = marked(known.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text"), bits, buckets).where("maybe")
    first = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h")).select("doc_id", "h", F.lit(True).alias("is_first"))
    seen = marked(narrow, bits, buckets)
    unique = seen.where("not maybe or doc_id is null").select("doc_id", "part", "mask")
    later = F.when(F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    again = seen.where("maybe and doc_id is not null").join(first, ["doc_id", "h"], "left").select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    return unique.unionByName(again)


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many rows, how many of quality 1 and how many of toxic 1 each mask has in each part.

    A document counts as good or toxic if any row of ``labels`` with its id says so; a null id has no labels.
    """
    is_one = lambda c: F.max((F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1).cast("long"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    both = flags.join(known, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))


def interactions(counts: DataFrame) -> DataFrame:
    """For every part and every order of the filters a row a step: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, all sums over the part's at most 32 mask counts.

    What a step removes depends only on which filters come before it, so 80 sums a part serve all 600 rows. A document that
    fails m filters is removed by each of them in 120 / m of the 120 orders.
    """
    k = len(FILTERS)
    cases = [(before, 1 << f) for before in range(1 << k) for f in range(k) if not before >> f & 1]
    at = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("own")) for b, f in cases)))
    each = counts.select("*", at.alias("at")).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, earlier = F.expr("mask & own <> 0"), F.expr("mask & before <> 0")
    total = lambda case, c="n": F.sum(F.when(case, F.col(c)).otherwise(0)).cast("long")
    sums = each.groupBy("part", "before", "own").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.expr("n * (120 div bit_count(mask))")).otherwise(0)).cast("long").alias("shapley"),
    )
    steps = []
    for order in itertools.permutations(range(k)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((name, step, before, 1 << f))
            before |= 1 << f
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    return sums.join(F.broadcast(orders), ["before", "own"]).drop("before", "own").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
