"""Confusion entropy, cost curves, meta-features of stored predictions, robust rank order and Goldfeld-Quandt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import confusion, threshold_curve
from .ordered import running_sums
from .tests import two_sided


def confusion_entropy(p: DataFrame) -> DataFrame:
    """(label, share, confusion_entropy) of each class: entropy of its misclassified mass, logarithm to the base 2(k-1).

    The total is the sum of share times confusion_entropy. With a single class both are defined: 1 and 0.
    """
    ends = confusion(p).select(F.explode(F.array("actual", "predicted")).alias("label"), (F.col("actual") != F.col("predicted")).alias("wrong"), "n")
    x = F.col("n") / F.sum("n").over(Window.partitionBy("label"))
    c = ends.withColumn("x", x).groupBy("label").agg(F.sum("n").alias("s"), F.sum(F.when(F.col("wrong"), -F.col("x") * F.log("x")).otherwise(0.0)).alias("e"))
    every = Window.partitionBy()
    k = F.count("*").over(every)
    return c.select("label", (F.col("s") / F.sum("s").over(every)).alias("share"), F.when(k > 1, F.col("e") / F.log(2.0 * (k - 1))).otherwise(0.0).alias("confusion_entropy"))


def cost_curve(p: DataFrame, score: str = "score") -> DataFrame:
    """(score, probability_cost, expected_cost): both ends of each threshold's line of normalised expected cost."""
    ends = F.array(F.struct(F.lit(0.0).alias("probability_cost"), F.col("fallout").alias("expected_cost")), F.struct(F.lit(1.0).alias("probability_cost"), (1 - F.col("recall")).alias("expected_cost")))
    return threshold_curve(p, score).select(score, F.inline(ends))


def stacking_features(p: DataFrame) -> DataFrame:
    """(item, actual, predictions, confidences, distribution): what each module said of an item, in the order of modules.

    ``p``: (item, actual, module, predicted, probs). An item's modules are few; their number does not grow with the table.
    """
    said = F.array_sort(F.collect_list(F.struct("module", "predicted", "probs"))).alias("m")
    at = lambda f: F.transform("m", f)
    return p.groupBy("item", "actual").agg(said).select(
        "item", "actual", at(lambda m: m["predicted"]).alias("predictions"),
        at(lambda m: F.get(m["probs"], m["predicted"].cast("int"))).alias("confidences"), F.flatten(at(lambda m: m["probs"])).alias("distribution"),
    )


def robust_rank_order(df: DataFrame, sample: str, value: str, a, b) -> DataFrame:
    """Fligner-Policello: mean placements both ways, ties half, z and two-sided p; null z without spread.

    Equal values are counted first, so the window sorts distinct values only.
    """
    c = df.where(F.col(sample).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(sample) == a).alias("x"), F.count_if(F.col(sample) == b).alias("y"))
    r = running_sums(c, value, ["x", "y"])
    placed = r.select("x", "y", (F.col("y_upto") - F.col("y") / 2).alias("px"), (F.col("x_upto") - F.col("x") / 2).alias("py"))
    total = lambda n, p, k: F.sum(F.col(n) * F.pow(p, F.lit(k)))
    s = placed.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), total("x", "px", 1).alias("sx"), total("y", "py", 1).alias("sy"), total("x", "px", 2).alias("qx"), total("y", "py", 2).alias("qy"))
    mx, my = F.col("sx") / F.col("n1"), F.col("sy") / F.col("n2")
    spread = F.col("qx") - F.col("sx") * mx + F.col("qy") - F.col("sy") * my + mx * my
    z = F.when(spread > 0, (F.col("sx") - F.col("sy")) / (2 * F.sqrt(spread)))
    return s.select("n1", "n2", mx.alias("placement1"), my.alias("placement2"), z.alias("z")).withColumn("p", two_sided(F.col("z")))


def goldfeld_quandt(df: DataFrame, x: str, y: str, low: float, high: float) -> DataFrame:
    """Residual variances of straight lines below ``low`` and above ``high`` of x, and their ratio f; rows between are left out.

    The cuts are values, so one aggregate does it without ordering the table.
    """

    def part(keep, name):
        a, b = F.when(keep, F.col(y)), F.when(keep, F.col(x))
        return [F.regr_count(a, b).alias(f"n_{name}"), ((F.regr_syy(a, b) - F.pow(F.regr_sxy(a, b), F.lit(2)) / F.regr_sxx(a, b)) / (F.regr_count(a, b) - 2)).alias(f"variance_{name}")]

    return df.agg(*part(F.col(x) <= low, "low"), *part(F.col(x) >= high, "high")).withColumn("f", F.col("variance_high") / F.col("variance_low"))


def residual_tests(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spread, anscombe): correlation of absolute residuals of a straight line with its fitted values, and Anscombe's ratio."""
    f = df.agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
    e = df.join(F.broadcast(f)).select((F.col("__a") + F.col("__b") * F.col(x)).alias("fitted"), (F.col(y) - F.col("__a") - F.col("__b") * F.col(x)).alias("e"))
    gap = F.col("fitted") - F.col("__m")
    s = e.join(F.broadcast(e.agg(F.avg("fitted").alias("__m"))))
    square = F.col("e") * F.col("e")
    return s.agg(F.corr(F.abs("e"), F.col("fitted")).alias("spread"), (F.sum(square * gap) / F.avg(square) / F.sum(gap * gap)).alias("anscombe"))
