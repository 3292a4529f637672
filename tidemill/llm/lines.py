"""Line dedup with DataFrame functions only: windows of three lines, found globally, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_name

WINDOW = 3


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, starts)``: the sorted starts of a row's windows that occur earlier, in a smaller id or higher up.

    ``docs``: (doc_id, text). A window is known by two 64-bit hashes of its lines.
    """
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("l")).where(f"size(l) >= {WINDOW}")
    each = lines.select("doc_id", "text_hash", F.expr("transform(l, x -> xxhash64(x))").alias("a"), F.expr("transform(l, x -> xxhash64('line', x))").alias("b"))
    at = each.select("doc_id", "text_hash", F.explode(F.expr(
        f"transform(sequence(0, size(a) - {WINDOW}), i -> struct(i as at, xxhash64(a[i], a[i + 1], a[i + 2]) as h1, xxhash64(b[i], b[i + 1], b[i + 2]) as h2))"
    )).alias("w")).select("doc_id", "text_hash", "w.*")
    first = at.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.max(F.struct("doc_id", "text_hash", "at")).alias("last")).where("first <> last").select("h1", "h2", "first")
    first = cut(first)  # so that both sides of the join are shuffled for it, and a hot window can be split
    later = at.join(first, ["h1", "h2"]).where("doc_id > first.doc_id or (doc_id = first.doc_id and text_hash = first.text_hash and at > first.at)")
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all columns, the text without lines that a later occurrence of a three-line window covers.

    The first occurrence (smallest id, then highest up) stays; windows are judged on the input and covered positions
    are merged. ``n_lines`` and ``n_lines_removed`` are added (replacing columns so named). Texts with fewer than three
    lines, null texts (null stays null, 0 lines) and rows with a null id stay whole; rows that repeat an id take
    nothing from each other, only from smaller ids and from themselves. The order of rows is not kept.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    starts = repeated_starts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    i, h, at, ls, kept = (free_name(c, docs) for c in ("__id", "__hash", "__starts", "__lines", "__kept"))
    found = starts.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("starts").alias(at)).hint("shuffle_hash")  # a row a document: texts need no sort
    plain = docs.select(*names)
    joined = plain.join(found, (plain[id_col].cast("long") == F.col(i)) & (F.xxhash64(plain[text_col].cast("string")) == F.col(h)), "left")
    lines = joined.withColumn(ls, F.split(F.col(text_col).cast("string"), "\n", -1))
    # what lies between merged windows: from each window's end to the next window's start
    gaps = f"""filter(zip_with(concat(array(0), transform({at}, s -> s + {WINDOW})), concat({at}, array(size({ls}))), (a, b) -> struct(a as a, b as b)), g -> g.b > g.a)"""
    left = lines.withColumn(kept, F.when(F.col(at).isNotNull(), F.expr(f"flatten(transform({gaps}, g -> slice({ls}, g.a + 1, g.b - g.a)))")))
    text = F.when(F.col(at).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", kept))
    return left.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in names),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(ls)).alias("n_lines"),
        F.when(F.col(at).isNull(), 0).otherwise(F.size(ls) - F.size(kept)).alias("n_lines_removed"),
    )
