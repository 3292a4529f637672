"""Combining stored predictions: (module, item, actual, predicted, probs) rows and one weight a module (or module and class)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import written


def module_weights(p: DataFrame, scheme: str = "accuracy", power: float = 4.0, classes: int = 2) -> DataFrame:
    """(module, weight) by one of: equal; accuracy to a power; share of all accuracies; accuracy over chance or over the largest class
    (floor 0.01); balanced accuracy; one less the share of all likelihood losses; Matthews correlation moved to [0, 1] (two classes)."""
    hit = (F.col("actual") == F.col("predicted")).cast("double")
    every = Window.partitionBy()
    if scheme in ("equal", "accuracy", "over_chance", "share"):
        acc = p.groupBy("module").agg(F.avg(hit).alias("acc"))
        w = {"equal": F.lit(1.0), "accuracy": F.pow("acc", power), "over_chance": F.greatest(F.col("acc") - 1 / classes, F.lit(0.01)), "share": F.col("acc") / F.sum("acc").over(every)}[scheme]
        return acc.select("module", w.alias("weight"))
    if scheme == "likelihood":
        x = F.element_at("probs", F.col("actual").cast("int") + 1)
        loss = p.groupBy("module").agg(F.avg(F.when(x == 0, 6.64).otherwise(-F.log2(x))).alias("nll"))
        return loss.select("module", (1 - F.col("nll") / F.sum("nll").over(every)).alias("weight"))
    if scheme in ("over_largest", "balanced"):
        c = p.groupBy("module", "actual").agg(F.count("*").alias("n"), F.sum(hit).alias("hit"))
        m = c.groupBy("module").agg((F.sum("hit") / F.sum("n")).alias("acc"), (F.max("n") / F.sum("n")).alias("largest"), F.avg(F.col("hit") / F.col("n")).alias("balanced"))
        return m.select("module", (F.col("balanced") if scheme == "balanced" else F.greatest(F.col("acc") - F.col("largest"), F.lit(0.01))).alias("weight"))
    if scheme != "mcc":
        raise ValueError(f"no weighting scheme {scheme}")
    n = lambda a, b: F.count_if((F.col("actual") == a) & (F.col("predicted") == b)).cast("double")
    m = p.groupBy("module").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    root = F.sqrt(F.expr("(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)"))
    return m.select("module", ((F.when(root > 0, F.expr("tp * tn - fp * fn") / root).otherwise(0.0) + 1) / 2).alias("weight"))


def class_weights(p: DataFrame, kind: str = "recall", power: float = 1.0) -> DataFrame:
    """(module, predicted, weight) of each class: recall, precision, or the F measure to a power."""
    hit = (F.col("actual") == F.col("predicted")).cast("double")
    if kind in ("recall", "precision"):
        key = "actual" if kind == "recall" else "predicted"
        return p.groupBy("module", F.col(key).alias("predicted")).agg(F.avg(hit).alias("weight"))
    ends = p.select("module", F.explode(F.array("actual", "predicted")).alias("class"), hit.alias("hit"))
    c = ends.groupBy("module", F.col("class").alias("predicted")).agg(F.sum("hit").alias("tp2"), F.count("*").alias("all"))
    return c.select("module", "predicted", F.pow(F.col("tp2") / F.col("all"), power).alias("weight"))


def support_weights(p: DataFrame) -> DataFrame:
    """Recall of each class over the best module's, and then over all modules' sum: (module, predicted, weight)."""
    w, same = class_weights(p), Window.partitionBy("predicted")
    scaled = w.withColumn("weight", F.col("weight") / F.nullif(F.max("weight").over(same), F.lit(0.0)))
    return scaled.withColumn("weight", F.coalesce(F.col("weight") / F.sum("weight").over(same), F.lit(0.0)))


def collective(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distributions of whole modules weighted by training accuracy."""
    return distribution_sum(test, module_weights(train, "accuracy", 1.0))


def flat_collective(train: dict[str, DataFrame], test: dict[str, DataFrame]) -> DataFrame:
    """Votes of all constituents of several ensembles in one pool, each weighted by its training accuracy."""
    named = lambda parts: reduce(lambda a, b: a.unionByName(b), (x.withColumn("module", F.concat(F.lit(f"{k}/"), F.col("module").cast("string"))) for k, x in parts.items()))
    return majority_vote(named(test), module_weights(named(train), "accuracy", 1.0))


def _decide(votes: DataFrame) -> DataFrame:
    """Normalised score and the winning class of each item; ties to the smaller class."""
    share = votes.groupBy("item", "actual").agg(F.max(F.struct(F.round("v", 12).alias("v"), (-F.col("class")).alias("c"))).alias("b"), F.sum("v").alias("t"))
    return share.select("item", "actual", (-F.col("b.c")).cast("int").alias("predicted"), F.when(F.col("t") != 0, F.col("b.v") / F.col("t")).alias("share"))


def majority_vote(p: DataFrame, weights: DataFrame, confidence: str = "none", classes: int = 2, power: float = 1.0) -> DataFrame:
    """Weighted votes for the predicted class, plain or times confidence p, p - 1/C or p^power."""
    x = F.element_at("probs", F.col("predicted").cast("int") + 1)
    v: Column = {"none": F.lit(1.0), "confidence": x, "corrected": x - 1 / classes, "powered": F.pow(x, power)}[confidence]
    on = ["module", "predicted"] if "predicted" in weights.columns else ["module"]
    return _decide(p.join(F.broadcast(weights), on).groupBy("item", "actual", F.col("predicted").alias("class")).agg(F.sum(F.col("weight") * v).alias("v")))


def distribution_sum(p: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of whole distributions."""
    e = p.join(F.broadcast(weights), "module").select("item", "actual", "weight", F.posexplode("probs").alias("class", "prob"))
    return _decide(e.groupBy("item", "actual", "class").agg(F.sum(F.col("weight") * F.col("prob")).alias("v")))


def cawpe(train: DataFrame, test: DataFrame, power: float = 4.0) -> DataFrame:
    """Distributions weighted by training accuracy to the fourth power."""
    return distribution_sum(test, module_weights(train, "accuracy", power))


def best_individual(train: DataFrame, test: DataFrame) -> DataFrame:
    best = module_weights(train, "accuracy", 1.0).orderBy(F.desc("weight"), "module").limit(1).select("module")
    return test.join(F.broadcast(best), "module", "left_semi")


def naive_bayes_combiner(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """Product over modules of P(class given the module's prediction), Laplace-smoothed, over the prior."""
    c = train.groupBy("module", "predicted", F.col("actual").alias("class")).agg(F.count("*").alias("n"))
    seen = train.groupBy("module", "predicted").agg(F.count("*").alias("m"))
    prior = train.groupBy(F.col("actual").alias("class")).agg(F.count("*").alias("k")).withColumn("prior", F.col("k") / F.sum("k").over(Window.partitionBy()))
    e = test.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    j = e.join(F.broadcast(seen), ["module", "predicted"], "left").join(F.broadcast(c), ["module", "predicted", "class"], "left").join(F.broadcast(prior), "class")
    log = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("m", F.lit(0)) + classes))
    s = j.groupBy("item", "actual", "class", "prior").agg(F.sum(log).alias("l"), F.count("*").alias("k"))
    return _decide(s.select("item", "actual", "class", F.exp(F.col("l") - (F.col("k") - 1) * F.log("prior")).alias("v")))


def select_ensemble(p: DataFrame, rounds: int = 10) -> list:
    """Greedy forward selection with replacement on accuracy of summed distributions; each round scores all candidates in one job.

    The modules' distributions are laid beside each other once, a row an item; a round is one aggregate over these rows without a shuffle of items.
    """
    names = [r["module"] for r in p.select("module").distinct().orderBy("module").collect()]
    classes = p.agg(F.max(F.size("probs"))).first()[0] or 0
    prob = lambda c, k: F.sum(F.when(F.col("module") == F.lit(c), F.get("probs", F.lit(k))))
    rows = p.groupBy("item", "actual").agg(*(prob(c, k).alias(f"p{i}_{k}") for i, c in enumerate(names) for k in range(classes)))
    rows, chosen = written(rows, "distributions"), []
    for _ in range(rounds):
        scores = []
        for i in range(len(names)):
            votes = []
            for k in range(classes):
                cells = [F.col(f"p{j}_{k}") for j in [*chosen, i]]
                v = sum((F.coalesce(x, F.lit(0.0)) for x in cells), F.lit(0.0))
                votes.append(F.when(F.coalesce(*cells).isNotNull(), F.struct(F.round(v, 9).alias("v"), F.lit(-k).alias("c"))))
            best = votes[0] if classes == 1 else F.greatest(*votes)
            scores.append(F.avg((-best["c"] == F.col("actual")).cast("double")).alias(str(i)))
        acc = rows.agg(*scores).first()
        chosen.append(min(range(len(names)), key=lambda i: (acc[i] is None, -(acc[i] or 0.0), i)))
    return [names[i] for i in chosen]


def choose_stored(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """For each dataset and fold (``by``) the test predictions of the module with the best stored training accuracy; ties to the smaller module."""
    acc = train.groupBy(*by, "module").agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("acc"))
    best = acc.groupBy(*by).agg(F.min_by("module", F.struct(-F.col("acc"), "module")).alias("module"))
    return test.join(best, [*by, "module"], "left_semi")
