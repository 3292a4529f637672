"""Learners that refine counts by their errors, and trees of two-class problems."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import _written
from .models import LEARNERS


def _class_log_odds(terms: DataFrame, counts: DataFrame, classes: DataFrame, vocabulary: int, docs: DataFrame) -> DataFrame:
    """(doc, class, p): the probability of each class for each of ``docs`` (doc), by smoothed term counts and class shares."""
    total = counts.groupBy("class").agg(F.sum("n").alias("total"))
    c = classes.join(total, "class", "left").select("class", F.log("share").alias("prior"), F.log(F.coalesce("total", F.lit(0.0)) + vocabulary).alias("norm"))
    hits = terms.join(counts.where("n > 0"), "word").groupBy("doc", "class").agg(F.sum(F.col("f") * F.log(F.col("n") + 1)).alias("hit"))
    length = docs.join(terms.groupBy("doc").agg(F.sum("f").alias("len")), "doc", "left").select("doc", F.coalesce("len", F.lit(0.0)).alias("len"))
    known = [F.struct(F.lit(r["class"]).alias("class"), F.lit(float(r.prior)).alias("prior"), F.lit(float(r.norm)).alias("norm")) for r in c.orderBy("class").collect()]
    each = length.withColumn("c", F.explode(F.array(*known))).select("doc", "len", "c.*")
    z = each.join(hits, ["doc", "class"], "left").select("doc", "class", (F.col("prior") + F.coalesce("hit", F.lit(0.0)) - F.col("len") * F.col("norm")).alias("z"))
    top = Window.partitionBy("doc")
    z = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(top)))
    return z.select("doc", "class", (F.col("e") / F.sum("e").over(top)).alias("p"))


@dataclass
class DiscriminativeBayes:
    """Multinomial Bayes whose counts grow by what is not predicted yet: in each epoch a document adds its words to its class,
    weighted by one minus the probability that the model gives the class.

    ``fit`` takes terms (doc, word, f) and labels (doc, class); all documents of an epoch are judged by the counts before it. The classes (1,000 at
    most) and the number of words come to the driver, counts stay in a written table.
    """

    epochs: int = 3

    def fit(self, terms: DataFrame, labels: DataFrame) -> DiscriminativeBayes:
        labels = labels.where("doc is not null and class is not null")
        terms = _written(terms.where("word is not null and f > 0").join(labels.select("doc"), "doc", "left_semi").select("doc", "word", F.col("f").cast("double").alias("f")), "terms")
        n = labels.count()
        self.classes = _written(labels.groupBy("class").agg((F.count("*") / n).alias("share")), "classes")
        if self.classes.count() > 1000:
            raise ValueError("over 1000 classes")
        self.vocabulary = terms.select("word").distinct().count()
        self.counts = terms.sparkSession.createDataFrame([], f"word string, class {dict(labels.dtypes)['class']}, n double")
        for _ in range(self.epochs):
            p = _class_log_odds(terms, self.counts, self.classes, self.vocabulary, labels.select("doc"))
            weight = labels.join(p, ["doc", "class"]).select("doc", "class", (1 - F.col("p")).alias("w"))
            more = terms.join(weight, "doc").groupBy("word", "class").agg(F.sum(F.col("f") * F.col("w")).alias("n"))
            self.counts = _written(self.counts.unionByName(more).groupBy("word", "class").agg(F.sum("n").alias("n")), "counts")
        return self

    def predict(self, terms: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc, predicted, p) for every doc of ``docs``: the class of largest probability, the smaller on ties; words not learned from only add to the length."""
        rows = terms.select("doc", "word", F.col("f").cast("double").alias("f"))
        p = _class_log_odds(rows, self.counts, self.classes, self.vocabulary, docs.select("doc"))
        return p.groupBy("doc").agg(F.min(F.struct((-F.round("p", 12)).alias("q"), "class")).alias("b")).select("doc", F.col("b.class").alias("predicted"), (-F.col("b.q")).alias("p"))


class NestedDichotomies:
    """A random tree that halves the classes; each inner node is a two-class problem on the rows of its classes, and the probability of a class is the
    product along its path. A node whose rows are of one side only gives that side."""

    def __init__(self, learner: str = "logistic", seed: int = 1, **params):
        self.learner, self.seed, self.params = learner, seed, params

    def fit(self, df: DataFrame, features: str, label: str) -> NestedDichotomies:
        known = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
        self.classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(1001).collect()]
        if not 1 <= len(self.classes) <= 1000:
            raise ValueError(f"{label}: 1 to 1000 classes are needed")
        rng, self.nodes, todo = np.random.default_rng(self.seed), [], [list(range(len(self.classes)))]
        while todo:
            part = todo.pop()
            if len(part) < 2:
                continue
            mixed = rng.permutation(part).tolist()
            left, right = sorted(mixed[: len(part) // 2]), sorted(mixed[len(part) // 2 :])
            self.nodes.append((left, right))
            todo += [left, right]
        rows = known.select(array_to_vector(F.col(features)).alias("__v"), (F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)) - 1).alias("__c"))
        self.models = []
        for left, right in self.nodes:
            part = rows.where(F.col("__c").isin(left + right)).withColumn("__l", F.col("__c").isin(right).cast("double"))
            self.models.append(LEARNERS[self.learner](featuresCol="__v", labelCol="__l", **self.params).fit(part))
        return self

    def predict(self, df: DataFrame, keep: list[str], features: str) -> DataFrame:
        """``keep``, ``predicted`` (ties to the first class) and ``probs``, one a class."""
        x = df.where(F.col(features).isNotNull()).select(*keep, array_to_vector(F.col(features)).alias("__v"))
        for i, m in enumerate(self.models):
            x = m.transform(x).withColumn(f"__right{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        probs = []
        for c in range(len(self.classes)):
            p = F.lit(1.0)
            for i, (left, right) in enumerate(self.nodes):
                if c in right:
                    p = p * F.col(f"__right{i}")
                elif c in left:
                    p = p * (1 - F.col(f"__right{i}"))
            probs.append(p)
        x = x.select(*keep, F.array(*probs).alias("probs"))
        return x.select(*keep, F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("probs", F.array_max("probs")).cast("int")).alias("predicted"), "probs")


class OrderedClasses:
    """Classes with an order: one two-class problem for each class but the last, whether a row lies above it; the probability of a class is the
    difference of its neighbours', brought to a sum of one where the problems disagree."""

    def __init__(self, learner: str = "logistic", **params):
        self.learner, self.params = learner, params

    def fit(self, df: DataFrame, features: str, label: str) -> OrderedClasses:
        known = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
        self.classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(1001).collect()]
        if not 1 <= len(self.classes) <= 1000:
            raise ValueError(f"{label}: 1 to 1000 classes are needed")
        rows = known.select(array_to_vector(F.col(features)).alias("__v"), F.col(label).alias("__c"))
        self.models = [LEARNERS[self.learner](featuresCol="__v", labelCol="__l", **self.params).fit(rows.withColumn("__l", (F.col("__c") > c).cast("double"))) for c in self.classes[:-1]]
        return self

    def predict(self, df: DataFrame, keep: list[str], features: str) -> DataFrame:
        """``keep``, ``predicted`` (ties to the lower class) and ``probs``, one a class in order."""
        x = df.where(F.col(features).isNotNull()).select(*keep, array_to_vector(F.col(features)).alias("__v"))
        for i, m in enumerate(self.models):
            x = m.transform(x).withColumn(f"__above{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        above = [F.lit(1.0), *(F.col(f"__above{i}") for i in range(len(self.models))), F.lit(0.0)]
        raw = F.array(*(F.greatest(a - b, F.lit(0.0)) for a, b in zip(above, above[1:], strict=False)))
        x = x.select(*keep, raw.alias("__r")).withColumn("__s", F.aggregate("__r", F.lit(0.0), lambda a, v: a + v))
        x = x.select(*keep, F.transform("__r", lambda v: v / F.col("__s")).alias("probs"))
        return x.select(*keep, F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("probs", F.array_max("probs")).cast("int")).alias("predicted"), "probs")
