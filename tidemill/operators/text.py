"""Text helpers: tokens, n-grams, stop words, term counts, prefix lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

# The default delimiters.
DELIMITERS = " \r\n\t.,;:'\"()?!"


def tokens(text: Column, delimiters: str = DELIMITERS) -> Column:
    inside = "".join("\\" + c if not c.isspace() else c for c in delimiters)
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{inside}]+"), lambda w: w != "")


def alphabetic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))


def ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    def one(w: Column, k: int) -> Column:
        return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.concat(*(one(w, k) for k in range(low, high + 1))))


def remove_stop_words(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*stop))


def term_counts(df: DataFrame, key: str, words: Column) -> DataFrame:
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def with_prefix(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.where(F.col("term").startswith(prefix))
