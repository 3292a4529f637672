"""Item sets, rules and sequences on MLlib's distributed miners."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger item sets give rules with one consequent only; a set of n items has 2^n splits.
SPLIT_ALL = 12


def to_items(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns))).alias("items"))


def frequent_items(items: DataFrame, support: float) -> DataFrame:
    f = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    return f.select(F.array_sort("items").alias("items"), "freq")


def rules(frequent: DataFrame, n: int, least_confidence: float = 0.9) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift, leverage, conviction).

    Sets up to SPLIT_ALL items are split into all antecedent/consequent pairs; of larger ones every single item is a consequent.
    Each side is joined to its own count.
    """
    small = frequent.where(f"size(items) between 2 and {SPLIT_ALL}").select("items", "freq", F.explode(F.expr("sequence(1, cast(power(2, size(items)) as int) - 2)")).alias("m"))
    in_mask = lambda i: F.col("m").bitwiseAND(F.pow(F.lit(2), i).cast("int"))
    s = small.select(F.filter("items", lambda x, i: in_mask(i) > 0).alias("antecedent"), F.filter("items", lambda x, i: in_mask(i) == 0).alias("consequent"), "freq")
    large = frequent.where(f"size(items) > {SPLIT_ALL}").select("items", "freq", F.explode("items").alias("one"))
    s = s.union(large.select(F.array_remove("items", F.col("one")).alias("antecedent"), F.array("one").alias("consequent"), "freq"))
    a = frequent.select(F.col("items").alias("antecedent"), F.col("freq").alias("fa"))
    c = frequent.select(F.col("items").alias("consequent"), F.col("freq").alias("fc"))
    x, f, fa, fc = s.join(a, "antecedent").join(c, "consequent"), F.col("freq"), F.col("fa"), F.col("fc")
    out = x.select("antecedent", "consequent", (f / n).alias("support"), (f / fa).alias("confidence"), (f / fa / (fc / n)).alias("lift"), (f / n - fa / n * fc / n).alias("leverage"), (fa / n * (n - fc) / (fa - f + 1)).alias("conviction"))
    return out.where(F.col("confidence") >= least_confidence)


def class_rules(rule_table: DataFrame, class_column: str) -> DataFrame:
    return rule_table.where(F.size("consequent") == 1).where(F.startswith(F.col("consequent")[0], F.lit(f"{class_column}=")))


def sequences(df: DataFrame, key: list[str], order: list[str], item: str, support: float) -> DataFrame:
    """(sequence, freq) of frequent sequential patterns of any length over each key's ordered items.

    ``key`` should bound its group (a user's day, not a user's life): a sequence is one row.
    """
    s = df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item))), lambda x: F.array(x[item])).alias("sequence")).select("sequence").persist()
    try:
        longest = s.agg(F.max(F.size("sequence"))).first()[0] or 1
        return PrefixSpan(minSupport=support, maxPatternLength=longest, sequenceCol="sequence").findFrequentSequentialPatterns(s)
    finally:
        s.unpersist()


def associative_predict(rule_table: DataFrame, rows: DataFrame, id_col: str, items: str, class_column: str) -> DataFrame:
    """(id, predicted): the class of the first rule that a row's items meet, by confidence, support, then the shorter and smaller antecedent.

    ``rule_table`` is a table of class rules, small beside the rows, and is met in every task; a row without a rule gets the class of the
    rules' most frequent consequent.
    """
    r = class_rules(rule_table, class_column).select("antecedent", F.col("consequent")[0].alias("said"), F.struct((-F.round("confidence", 9)).alias("c"), (-F.round("support", 9)).alias("s"), F.size("antecedent").alias("z"), F.array_join("antecedent", ",").alias("a"), F.col("consequent")[0].alias("k")).alias("turn"))
    met = rows.select(F.col(id_col).alias("id"), F.col(items).alias("have")).join(F.broadcast(r), F.size(F.array_except("antecedent", "have")) == 0)
    first = met.groupBy("id").agg(F.min_by("said", "turn").alias("predicted"))
    other = r.groupBy("said").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "said").limit(1).select(F.col("said").alias("other"))
    return rows.select(F.col(id_col).alias("id")).join(first, "id", "left").join(F.broadcast(other)).select("id", F.coalesce("predicted", "other").alias("predicted"))


def rule_significance(rule_table: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """Adds ``chi_squared`` (one degree of freedom) of each rule's two-by-two table and keeps rules that reach ``least``.

    A side that every row has leaves nothing to test: 0.
    """
    s = F.col("support")
    a, c = s / F.col("confidence"), F.col("confidence") / F.col("lift")
    spread = a * c * (1 - a) * (1 - c)
    x = F.when(spread > 1e-15, n * F.pow(s - a * c, 2) / spread).otherwise(0.0)
    return rule_table.withColumn("chi_squared", x).where(F.col("chi_squared") >= least)


def predictive_accuracy(rule_table: DataFrame, n: int, bins: int = 20) -> DataFrame:
    """Adds ``expected``: the expected accuracy of a rule given its hits and tries, under the prior of all rules' confidences in ``bins`` (broadcast)."""
    prior = rule_table.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count("*").alias("w")).collect()
    total = sum(r.w for r in prior)
    tries = F.col("support") / F.col("confidence") * n
    hits = F.col("support") * n
    log = lambda c: hits * F.log(F.lit(c)) + (tries - hits) * F.log(F.lit(1 - c))
    points = [((r.b + 0.5) / bins, r.w / total) for r in prior]
    top = F.greatest(*(log(c) for c, _ in points)) if len(points) > 1 else log(points[0][0])
    mass = lambda f: sum((F.exp(log(c) - top) * p * f(c) for c, p in points), F.lit(0.0))
    return rule_table.withColumn("expected", mass(lambda c: c) / mass(lambda _: 1.0))
