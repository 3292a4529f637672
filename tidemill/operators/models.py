"""Learners and clusterers: MLlib where it has them, aggregates where a fit is a table of sums."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import density
from .ordered import running_sums

LEARNERS = {
    "logistic": lambda **k: LogisticRegression(regParam=k.pop("ridge", 1e-8), **k),
    "tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosted": GBTClassifier, "naive_bayes": NaiveBayes,
    "perceptron": MultilayerPerceptronClassifier, "svm": LinearSVC, "one_vs_rest": lambda **k: OneVsRest(classifier=LogisticRegression(), **k),
    "linear": LinearRegression, "isotonic": IsotonicRegression, "tree_regression": DecisionTreeRegressor,
}


def fit(name: str, df: DataFrame, features: str = "features", label: str = "label", **params):
    """A fitted MLlib model on an array column of features; ``model.transform`` on :func:`as_vectors` adds prediction and probability."""
    return LEARNERS[name](featuresCol="features", labelCol="label", **params).fit(as_vectors(df, features, label))


def as_vectors(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(features))).withColumn("label", F.col(label).cast("double"))


def cross_validate(name: str, df: DataFrame, label: str, features: str, id_col: str, k: int = 5, **params) -> DataFrame:
    """(item, actual, predicted) out of fold, stratified folds."""
    from .sampling import stratified_folds

    x = as_vectors(stratified_folds(df, label, id_col, k), features, label)
    out = None
    for i in range(k):
        m = LEARNERS[name](featuresCol="features", labelCol="label", **params).fit(x.where(F.col("fold") != i))
        p = m.transform(x.where(F.col("fold") == i)).select(F.col(id_col).alias("item"), F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))
        out = p if out is None else out.unionByName(p)
    return out


def zero_rule(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class (smallest on ties)."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label).limit(1)


def gaussian_naive_bayes(train: DataFrame, test: DataFrame, label: str, columns: list[str], id_col: str) -> DataFrame:
    """(item, actual, predicted), a row for each of ``test``: per-class normals and priors in one aggregate; nulls add nothing.

    The model, one row a class (at most 10,000), comes to the driver, and every row scores all classes in itself. Ties go to the larger class count, then class.
    """
    model = density.normal(train, columns, [label], 1e-3).join(train.groupBy(label).agg(F.count("*").alias("__k")), label).withColumnRenamed(label, "__c")
    rows = model.where("__c is not null").orderBy("__c").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{label} has over 10,000 classes")
    parts = []
    for r in rows:
        lit = lambda c, r=r: F.lit(None if r[c] is None else float(r[c]))
        score = F.log(lit("__k")) + sum((F.coalesce(density.normal_log_density(F.col(c), lit(f"{c}_mean"), lit(f"{c}_sd")), F.lit(0.0)) for c in columns), F.lit(0.0))
        parts.append(F.struct(score.alias("s"), F.lit(r["__k"]).alias("k"), F.lit(r["__c"]).alias("c")))
    best = F.array_max(F.array(*parts))["c"] if parts else F.lit(None).cast(dict(train.dtypes)[label])
    return test.select(F.col(id_col).alias("item"), F.col(label).alias("actual"), best.alias("predicted"))


def decision_stump(df: DataFrame, column: str, label: str) -> DataFrame:
    """(threshold, entropy): the split of least weighted class entropy, over counts of distinct values."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v"), F.col(label).alias("c")).agg(F.count("*").alias("n"))
    classes = c.groupBy("c").agg(F.sum("n").alias("all"))
    grid = c.select("v").distinct().join(F.broadcast(classes)).join(c, ["v", "c"], "left").na.fill(0, ["n"])
    b = running_sums(grid, "v", ["n"], ["c"]).withColumnRenamed("n_upto", "b")
    h = lambda x: F.sum(F.when(x > 0, -x * F.log2(x)).otherwise(0.0))
    t = b.groupBy("v").agg(h(F.col("b")).alias("hb"), h(F.col("all") - F.col("b")).alias("ha"), F.sum("b").alias("nb"), F.sum("all").alias("na"))
    left, right = F.col("nb"), F.col("na") - F.col("nb")
    s = t.where(right > 0).select("v", ((F.col("hb") + left * F.log2(left) + F.col("ha") + right * F.log2(right)) / F.col("na")).alias("entropy"))
    return s.orderBy("entropy", "v").limit(1).select(F.col("v").alias("threshold"), "entropy")


def decision_table(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Majority class of each pattern of the columns."""
    return df.groupBy(*columns, label).count().groupBy(*columns).agg(F.max(F.struct("count", label))[label].alias("predicted"))


def hyper_pipes(train: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return train.groupBy(label).agg(*(x for c in columns for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))))


def k_means(df: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    v = df.withColumn("__v", array_to_vector(F.col(features)))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def gaussian_mixture(df: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    v = df.withColumn("__v", array_to_vector(F.col(features)))
    return GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def farthest_first(df: DataFrame, id_col: str, features: str, k: int, seed: int | None = None) -> DataFrame:
    """Cluster of the nearest of k centres; each next centre is the row farthest from those so far (ties by id).

    The first centre is the row of smallest id, or of smallest hash of the id and a seed.
    """
    from ..functions import arrays as A

    first = df.orderBy(*([id_col] if seed is None else [F.xxhash64(id_col, F.lit(seed)), id_col])).first()
    centres = [first[features]]
    gap = lambda: F.least(*(A.squared_euclidean(F.col(features), F.array(*map(F.lit, c))) for c in centres)) if len(centres) > 1 else A.squared_euclidean(F.col(features), F.array(*map(F.lit, centres[0])))
    while len(centres) < k:
        centres.append(df.orderBy(F.desc(gap()), id_col).first()[features])
    near = F.array_min(F.array(*(F.struct(A.squared_euclidean(F.col(features), F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return df.withColumn("cluster", near["i"])


def cluster_classes(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, n, majority, share) for classes-to-clusters evaluation."""
    c = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    g = c.groupBy(cluster).agg(F.sum("n").alias("size"), F.max(F.struct("n", label)).alias("b"))
    return g.select(cluster, "size", F.col(f"b.{label}").alias("majority"), (F.col("b.n") / F.col("size")).alias("share"))


def best_assignment(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(n, hits, error): classes to clusters by the one-to-one assignment of most hits, over the small table of both."""
    cells = {(r[0], r[1]): r[2] for r in df.groupBy(cluster, label).count().collect()}
    clusters, classes = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    best: dict[int, int] = {0: 0}  # classes taken (as bits) -> hits
    for c in clusters:
        now = dict(best)
        for taken, hits in best.items():
            for i, v in enumerate(classes):
                if not taken >> i & 1:
                    now[taken | 1 << i] = max(now.get(taken | 1 << i, 0), hits + cells.get((c, v), 0))
        best = now
    n = sum(cells.values())
    hits = max(best.values())
    return df.sparkSession.createDataFrame([(n, hits, 1 - hits / n if n else 0.0)], "n long, hits long, error double")


def cluster_densities(df: DataFrame, cluster: str, columns: list[str], id_col: str) -> DataFrame:
    """(id, cluster, log_density): log prior and normal log density of each row under each cluster (one row a cluster is broadcast)."""
    m = density.normal(df, columns, [cluster], 1e-6).join(df.groupBy(cluster).agg(F.count("*").alias("__k")), cluster).withColumnRenamed(cluster, "cluster")
    m = m.join(F.broadcast(m.agg(F.sum("__k").alias("__t"))))
    score = F.log(F.col("__k") / F.col("__t")) + sum((density.normal_log_density(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in columns), F.lit(0.0))
    rows = df.select(F.col(id_col).alias("id"), *columns).withColumn("__j", F.lit(1))
    return rows.join(F.broadcast(m.withColumn("__m", F.lit(1))), F.col("__j") == F.col("__m")).select("id", "cluster", score.alias("log_density"))


def via_clustering(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``df`` with ``predicted``: the most frequent class of the row's cluster, the smaller on ties."""
    top = df.groupBy(cluster, label).count().groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("count"), label)).alias("predicted"))
    return df.join(F.broadcast(top), cluster)


def diagonal_mixture(df: DataFrame, columns: list[str], id_col: str, k: int, rounds: int = 10) -> tuple[list[dict], DataFrame]:
    """EM of normals with diagonal covariance; each round is one aggregate. The start deals rows to components by their place in ``columns[0]``.

    Returns the components (share, means, deviations) and (id, component, share) of every row under each.
    """
    known = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    spark = df.sparkSession
    r = known.agg(F.min(columns[0]).alias("a"), F.max(columns[0]).alias("b")).first()
    width = (float(r.b) - float(r.a)) / k or 1.0
    first = F.least(F.floor((F.col(columns[0]) - float(r.a)) / width), F.lit(k - 1)).cast("int")
    shares = known.withColumn("__c", first).withColumn("__w", F.lit(1.0))
    parts: list[dict] = []
    for step in range(rounds + 1):
        w = F.col("__w")
        s = shares.groupBy("__c").agg(F.sum(w).alias("w"), *(x for c in columns for x in (F.sum(w * F.col(c)).alias(f"s_{c}"), F.sum(w * F.col(c) * F.col(c)).alias(f"q_{c}")))).orderBy("__c").collect()
        total = sum(x.w for x in s)
        parts = [{"component": x["__c"], "share": x.w / total, "mean": [x[f"s_{c}"] / x.w for c in columns], "sd": [max(1e-6, (x[f"q_{c}"] / x.w - (x[f"s_{c}"] / x.w) ** 2)) ** 0.5 for c in columns]} for x in s if x.w > 0]
        model = spark.createDataFrame([(p["component"], float(p["share"]), [float(v) for v in p["mean"]], [float(v) for v in p["sd"]]) for p in parts], "__c int, __p double, __m array<double>, __s array<double>")
        log = F.log("__p") + sum((density.normal_log_density(F.col(c), F.col("__m")[i], F.col("__s")[i]) for i, c in enumerate(columns)), F.lit(0.0))
        joined = known.withColumn("__j", F.lit(1)).join(F.broadcast(model.withColumn("__one", F.lit(1))), F.col("__j") == F.col("__one")).withColumn("__l", log)
        rows = joined.groupBy(*known.columns).agg(F.collect_list(F.struct("__c", "__l")).alias("__all"))  # k entries a row
        top = F.array_max(F.transform("__all", lambda e: e["__l"]))
        norm = F.aggregate("__all", F.lit(0.0), lambda a, e: a + F.exp(e["__l"] - top))
        shares = rows.select(*known.columns, F.explode(F.transform("__all", lambda e: F.struct(e["__c"].alias("__c"), (F.exp(e["__l"] - top) / norm).alias("__w")))).alias("e")).select(*known.columns, "e.__c", "e.__w")
        if step == rounds:
            break
    return parts, shares.select(F.col(id_col).alias("id"), F.col("__c").alias("component"), F.col("__w").alias("share"))


# --- learners that are tables of counts ------------------------------------------------------------------------------


def multinomial_bayes(words: DataFrame, labels: DataFrame, id_col: str, label: str, complement: bool = False) -> DataFrame:
    """(id, actual, predicted): naive Bayes over word counts (id, term, n), Laplace-smoothed; with ``complement`` the weights of the other classes.

    Documents of which no word is known get the largest class. The model is one row a class and word, joined by word.
    """
    own = words.join(labels.select(F.col(id_col), F.col(label).alias("class")), id_col)
    counts = own.groupBy("class", "term").agg(F.sum("n").alias("n"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("all"))
    v = terms.agg(F.count("*").alias("v"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    every = totals.agg(F.sum("total").alias("t"))
    prior = labels.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("docs"))
    grid = terms.join(F.broadcast(totals.join(F.broadcast(v)).join(F.broadcast(every)))).join(counts, ["class", "term"], "left").na.fill(0, ["n"])
    n, t = (F.col("all") - F.col("n"), F.col("t") - F.col("total")) if complement else (F.col("n"), F.col("total"))
    weight = F.log((n + 1) / (t + F.col("v")))
    model = grid.select("class", "term", (-weight if complement else weight).alias("w"))
    s = words.join(model, "term").groupBy(id_col, "class").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    base = labels.select(F.col(id_col), F.col(label).alias("actual")).join(F.broadcast(prior.withColumn("p", F.lit(0.0) if complement else F.log("docs"))))
    scored = base.join(s, [id_col, "class"], "left").withColumn("s", F.round(F.coalesce("s", F.lit(0.0)) + F.col("p"), 9))
    return scored.groupBy(F.col(id_col).alias("item"), "actual").agg(F.min_by("class", F.struct(-F.col("s"), -F.col("docs"), "class")).alias("predicted"))


def one_dependence(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Each pattern of nominal ``columns`` with ``predicted``: averaged one-dependence estimators.

    For every class the mean over parents a_i of P(c, a_i) times the product of P(a_j | c, a_i), Laplace-smoothed. Works on the distinct
    patterns; the pair counts are joined by their values.
    """
    rows = df.groupBy(*columns, label).agg(F.count("*").alias("__n"))
    total = df.count()
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    sizes = {c: rows.select(c).distinct().count() for c in columns}
    patterns = rows.select(*columns).distinct().withColumn("__class", F.explode(F.array(*map(F.lit, classes))))
    score = F.lit(0.0)
    for parent in columns:
        one = rows.groupBy(F.col(parent), F.col(label).alias("__class")).agg(F.sum("__n").alias(f"__{parent}"))
        patterns = patterns.join(one, [parent, "__class"], "left").na.fill(0, [f"__{parent}"])
        term = (F.col(f"__{parent}") + 1) / (total + len(classes) * sizes[parent])
        for child in columns:
            if child != parent:
                pair = rows.groupBy(F.col(parent), F.col(child), F.col(label).alias("__class")).agg(F.sum("__n").alias(f"__{parent}_{child}"))
                patterns = patterns.join(pair, [parent, child, "__class"], "left").na.fill(0, [f"__{parent}_{child}"])
                term = term * (F.col(f"__{parent}_{child}") + 1) / (F.col(f"__{parent}") + sizes[child])
        score = score + term
    best = patterns.withColumn("__s", F.round(score, 12)).groupBy(*columns).agg(F.min_by("__class", F.struct(-F.col("__s"), "__class")).alias("predicted"))
    return best


def conditional_information(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(a, b, information) in bits: mutual information of each pair of nominal columns given the class."""
    out = None
    n = df.count()
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            abc = df.groupBy(F.col(a).alias("u"), F.col(b).alias("v"), F.col(label).alias("c")).agg(F.count("*").alias("__n"))
            side = lambda k, name: abc.groupBy(k, "c").agg(F.sum("__n").alias(name))
            x = abc.join(side("u", "nu"), ["u", "c"]).join(side("v", "nv"), ["v", "c"]).join(abc.groupBy("c").agg(F.sum("__n").alias("nc")), "c")
            part = x.agg(F.sum(F.col("__n") / n * F.log2(F.col("__n") * F.col("nc") / (F.col("nu") * F.col("nv")))).alias("information")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "information")
            out = part if out is None else out.union(part)
    return out


def tree_edges(information: DataFrame) -> list[tuple[str, str]]:
    """The edges of the maximum spanning tree of the small table of pairs, (parent, child) from the smallest name."""
    rows = sorted(((round(r.information, 12), r.a, r.b) for r in information.collect()), key=lambda x: (-x[0], x[1], x[2]))
    names = sorted({x for r in rows for x in r[1:]})
    inside, edges = names[:1], []
    while len(inside) < len(names):
        for _, a, b in rows:
            if (a in inside) != (b in inside):
                edges.append((a, b) if a in inside else (b, a))
                inside.append(edges[-1][1])
                break
    return edges


def tree_bayes(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Each pattern of nominal ``columns`` with ``predicted``: naive Bayes in which each column also depends on its parent in the tree."""
    edges = dict((b, a) for a, b in tree_edges(conditional_information(df, columns, label)))
    rows = df.groupBy(*columns, label).agg(F.count("*").alias("__n"))
    prior = rows.groupBy(F.col(label).alias("__class")).agg(F.sum("__n").alias("__prior"))
    p = rows.select(*columns).distinct().join(F.broadcast(prior))
    score = F.log("__prior")
    for c in columns:
        size = rows.select(c).distinct().count()
        given = [edges[c]] if c in edges else []
        up = rows.groupBy(*given, F.col(label).alias("__class")).agg(F.sum("__n").alias(f"__up_{c}"))
        own = rows.groupBy(*given, c, F.col(label).alias("__class")).agg(F.sum("__n").alias(f"__own_{c}"))
        p = p.join(up, [*given, "__class"], "left").join(own, [*given, c, "__class"], "left").na.fill(0, [f"__up_{c}", f"__own_{c}"])
        score = score + F.log((F.col(f"__own_{c}") + 1) / (F.col(f"__up_{c}") + size))
    return p.withColumn("__s", F.round(score, 9)).groupBy(*columns).agg(F.min_by("__class", F.struct(-F.col("__s"), "__class")).alias("predicted"))


def simple_linear(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(attribute, slope, intercept, sse): the column whose straight line leaves the least squared error."""
    out = None
    for c in columns:
        sse = F.regr_syy(target, c) - F.regr_sxy(target, c) * F.regr_sxy(target, c) / F.regr_sxx(target, c)
        r = df.agg(F.regr_slope(target, c).alias("slope"), F.regr_intercept(target, c).alias("intercept"), sse.alias("sse")).select(F.lit(c).alias("attribute"), "slope", "intercept", "sse")
        out = r if out is None else out.union(r)
    return out.orderBy("sse", "attribute").limit(1)


def ridge(df: DataFrame, columns: list[str], target: str, penalty: float = 1e-8) -> tuple[list[float], float]:
    """Weights and intercept of penalised least squares: one pass of cross-products, a small solve."""
    from .columns import gram_matrix

    _, mean, g = gram_matrix(df, [*columns, target])
    w = np.linalg.solve(g[:-1, :-1] + penalty * np.eye(len(columns)), g[:-1, -1])
    return [float(x) for x in w], float(mean[-1] - w @ mean[:-1])


def voting_intervals(train: DataFrame, columns: list[str], label: str) -> dict:
    """Interval borders (ends of the classes' ranges) and each interval's class votes, a class's counts over its size, normalised to one."""
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    out = {"classes": sorted(sizes), "columns": {}}
    for c in columns:
        borders = sorted({float(v) for r in train.groupBy(label).agg(F.min(c).alias("a"), F.max(c).alias("b")).collect() for v in (r.a, r.b) if v is not None})
        at = sum((F.when(F.col(c) >= b, 1).otherwise(0) for b in borders), F.lit(0))
        votes: dict[int, dict] = {}
        for r in train.where(F.col(c).isNotNull()).groupBy(at.alias("i"), label).count().collect():
            votes.setdefault(r.i, {})[r[label]] = r["count"] / sizes[r[label]]
        out["columns"][c] = (borders, {i: {k: v / sum(x.values()) for k, v in x.items()} for i, x in votes.items()})
    return out


def interval_predict(df: DataFrame, model: dict) -> DataFrame:
    """``df`` with ``predicted``: the class of most votes over the columns, the smaller on ties."""
    totals = []
    for k in model["classes"]:
        t = F.lit(0.0)
        for c, (borders, votes) in model["columns"].items():
            at = sum((F.when(F.col(c) >= b, 1).otherwise(0) for b in borders), F.lit(0))
            table = F.array(*(F.lit(float(votes.get(i, {}).get(k, 0.0))) for i in range(len(borders) + 1)))
            t = t + F.when(F.col(c).isNotNull(), F.get(table, at)).otherwise(0.0)
        totals.append(F.struct((-F.round(t, 9)).alias("s"), F.lit(k).alias("k")))
    return df.withColumn("predicted", F.array_min(F.array(*totals))["k"])


def binned_regression(df: DataFrame, key: list[str], target: str, bins: int) -> DataFrame:
    """(key, predicted): the target cut to equal-width bins, each pattern's bin shares, and the mean of the bins' means under them."""
    from .columns import bin_of, equal_width_cuts

    x = df.withColumn("__bin", bin_of(F.col(target), equal_width_cuts(df, target, bins)))
    means = x.groupBy("__bin").agg(F.avg(target).alias("__m"))
    c = x.groupBy(*key, "__bin").agg(F.count("*").alias("__n")).join(F.broadcast(means), "__bin")
    return c.groupBy(*key).agg((F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("predicted"))


def least_cost(p: DataFrame, costs: list[list[float]]) -> DataFrame:
    """Predictions moved to the class of least expected cost; ``costs[actual][predicted]``."""
    k = len(costs)
    expected = lambda j: sum((F.col("probs")[i] * float(costs[i][j]) for i in range(k)), F.lit(0.0))
    return p.withColumn("predicted", F.array_min(F.array(*(F.struct(F.round(expected(j), 12).alias("c"), F.lit(j).alias("j")) for j in range(k))))["j"])


def best_threshold(p: DataFrame, score: str = "score", metric: str = "f1") -> DataFrame:
    """(score, value): the threshold of best F1 or accuracy, the larger on ties."""
    from .evaluation import threshold_curve

    c = threshold_curve(p, score)
    value = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")) if metric == "f1" else F.col("precision")
    return c.where(F.col("tp") > 0).select(score, value.alias("value")).orderBy(F.desc(F.round("value", 9)), F.desc(score)).limit(1)


def align(df: DataFrame, schema) -> DataFrame:
    """Incoming columns mapped by name (case aside) to the model's; absent ones null, others dropped."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(have[f.name.lower()]).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def bag_summary(df: DataFrame, bag: str, columns: list[str], kind: str = "mean") -> DataFrame:
    """One row a bag: arithmetic or geometric means, or both ends, of its members' columns."""
    f = {"mean": lambda c: [F.avg(c).alias(c)], "geometric": lambda c: [F.exp(F.avg(F.log(c))).alias(c)], "ends": lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]}[kind]
    return df.groupBy(bag).agg(*(x for c in columns for x in f(c)))


def bag_vote(p: DataFrame, bag: str) -> DataFrame:
    """(bag, actual, predicted): members' distributions averaged; the smaller class on ties."""
    e = p.select(bag, "actual", F.posexplode("probs").alias("class", "prob")).groupBy(bag, "actual", "class").agg(F.avg("prob").alias("v"))
    return e.groupBy(bag, "actual").agg(F.min_by("class", F.struct(-F.round("v", 12), "class")).alias("predicted"))


def channel_vote(df: DataFrame, id_col: str, channels: str, label: str) -> DataFrame:
    """(query, actual, predicted): 1-NN on each channel of every series, majority over channels, the smaller class on ties."""
    from .distances import nearest
    from .series import split_channels

    parts = split_channels(df, id_col, channels).join(df.select(id_col, F.col(label).alias("__l")), id_col)
    count = parts.agg(F.max("channel")).first()[0]
    votes = None
    for c in range((count or 0) + 1):
        own = parts.where(F.col("channel") == c)
        n = nearest(own, own, id_col, "series", "__l").select("query", "actual", "label")
        votes = n if votes is None else votes.union(n)
    v = votes.groupBy("query", "actual", "label").agg(F.count("*").alias("n"))
    return v.groupBy("query", "actual").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"))


def _stump_table(df: DataFrame, columns: list[str], label: str, weight: str) -> dict:
    """The nominal column whose value-by-value majority has the least weighted error, with its rule."""
    best = None
    for c in columns:
        w = df.groupBy(F.col(c).alias("v"), F.col(label).alias("y")).agg(F.sum(weight).alias("w"))
        top = w.groupBy("v").agg(F.min_by("y", F.struct(-F.round("w", 12), "y")).alias("y"), F.max("w").alias("hit"), F.sum("w").alias("all")).collect()
        error = 1 - sum(r["hit"] for r in top) / sum(r["all"] for r in top)
        if best is None or error < best["error"] - 1e-12:
            best = {"column": c, "rule": {r.v: r.y for r in top}, "error": error}
    return best


def boosted_rules(df: DataFrame, columns: list[str], label: str, rounds: int = 10) -> list[dict]:
    """AdaBoost.M1 over one-column rules: misclassified patterns weigh more in the next round. Weights live on the distinct patterns."""
    p = df.groupBy(*columns, label).agg(F.count("*").cast("double").alias("__w"))
    factor, out = F.lit(1.0), []
    for _ in range(rounds):
        best = _stump_table(p.withColumn("__v", F.col("__w") * factor), columns, label, "__v")
        e = max(best["error"], 1e-10)
        if e >= 0.5:
            break
        best["beta"] = e / (1 - e)
        out.append(best)
        if best["error"] <= 1e-10:
            break
        rule = F.create_map(*(F.lit(x) for kv in best["rule"].items() for x in kv))
        factor = factor * F.when(rule[F.col(best["column"])] == F.col(label), F.lit(best["beta"])).otherwise(1.0)
    return out


def rules_predict(df: DataFrame, rules: list[dict], labels: list) -> DataFrame:
    """``df`` with ``predicted``: the class of most weight log(1/beta) over the rules."""
    said = [(F.create_map(*(F.lit(x) for kv in r["rule"].items() for x in kv))[F.col(r["column"])], -math.log(r["beta"])) for r in rules]
    total = lambda k: sum((F.when(p == k, w).otherwise(0.0) for p, w in said), F.lit(0.0))
    return df.withColumn("predicted", F.array_min(F.array(*(F.struct((-F.round(total(k), 9)).alias("s"), F.lit(k).alias("k")) for k in labels)))["k"])


def bagged_tables(df: DataFrame, columns: list[str], label: str, id_col: str, bags: int, share: float = 1.0, subspace: float = 1.0, seed: int = 1) -> DataFrame:
    """Each pattern with ``predicted``: votes of decision tables fitted on bootstrap samples (Poisson counts by hash) and on random columns.

    All bags are fitted in one job: each row goes to a bag as often as its hash says.
    """
    names = [sorted(columns, key=lambda c, b=b: zlib.crc32(f"{seed}/{b}/{c}".encode()))[: max(1, round(subspace * len(columns)))] for b in range(bags)]
    u = F.pmod(F.xxhash64(id_col, "bag", F.lit(seed)), F.lit(1_000_000)) / 1e6
    # Poisson by its distribution function
    steps, p, total = [], math.exp(-share), 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p *= share / (k + 1)
    times = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    dealt = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn("__t", times).where("__t > 0")
    masked = [F.when(F.col("bag").isin(*[b for b in range(bags) if c in names[b]]), F.col(c)).alias(c) if any(c in n for n in names) else F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in columns]
    counts = dealt.select("bag", *masked, label, "__t").groupBy("bag", *columns, label).agg(F.sum("__t").alias("__n"))
    rule = counts.groupBy("bag", *columns).agg(F.min_by(label, F.struct(-F.col("__n"), label)).alias("vote"))
    asked = df.select(*columns).distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    seen = asked.select("bag", *(F.col(c).alias(f"__{c}") for c in columns), *masked)
    on = [F.col("q.bag") == F.col("r.bag"), *(F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns)]
    votes = seen.alias("q").join(rule.alias("r"), reduce(lambda a, b: a & b, on)).groupBy(*(F.col(f"q.__{c}").alias(c) for c in columns), "vote").agg(F.count("*").alias("__n"))
    return votes.groupBy(*columns).agg(F.min_by("vote", F.struct(-F.col("__n"), "vote")).alias("predicted"))


def pairwise_codes(classes: list, kind: str = "one_vs_one") -> list[dict]:
    """Code words: for each binary problem which classes are 1 and which 0 (others left out)."""
    if kind == "one_vs_one":
        return [{a: 1, b: 0} for i, a in enumerate(classes) for b in classes[i + 1 :]]
    if kind == "one_vs_rest":
        return [{c: int(c == k) for c in classes} for k in classes]
    return [{c: (code >> i) & 1 for i, c in enumerate(classes)} for code in range(1, 2 ** (len(classes) - 1))]  # exhaustive


def decode(df: DataFrame, bits: list[str], codes: list[dict], classes: list) -> DataFrame:
    """``df`` with ``predicted``: the class whose code words disagree least with the predicted bits, the smaller on ties."""
    gap = lambda k: sum((F.abs(F.col(b) - float(code[k])) for b, code in zip(bits, codes, strict=True) if k in code), F.lit(0.0))
    share = lambda k: gap(k) / max(1, sum(k in c for c in codes))
    return df.withColumn("predicted", F.array_min(F.array(*(F.struct(F.round(share(k), 9).alias("s"), F.lit(k).alias("k")) for k in classes)))["k"])


def radial_basis(df: DataFrame, features: str, label: str, centres: int, seed: int = 1, **params):
    """A k-means layer of normal activations and a logistic layer on them: (activations model, logistic model, activate)."""
    from ..functions import arrays as A

    v = df.withColumn("__v", array_to_vector(F.col(features)))
    km = KMeans(k=centres, seed=seed, featuresCol="__v", predictionCol="__c").fit(v)
    points = [c.tolist() for c in km.clusterCenters()]
    spread = km.transform(v).select("__c", features)
    of = F.get(F.array(*(F.array(*map(F.lit, c)) for c in points)), F.col("__c"))
    width = spread.agg(F.avg(A.squared_euclidean(F.col(features), of))).first()[0] or 1.0
    act = lambda x: F.array(*(F.exp(-A.squared_euclidean(x, F.array(*map(F.lit, c))) / (2 * width)) for c in points))
    activate = lambda t: t.withColumn("__act", act(F.col(features)))
    return km, fit("logistic", activate(df), "__act", label, **params), activate


def stacked(df: DataFrame, label: str, features: str, id_col: str, learners: dict[str, dict], k: int = 3) -> DataFrame:
    """(item, actual, predicted): a decision table over the out-of-fold predictions of several learners."""
    joined = None
    for name, params in learners.items():
        p = cross_validate(name, df, label, features, id_col, k, **params).withColumnRenamed("predicted", name)
        joined = p if joined is None else joined.join(p.drop("actual"), "item")
    return joined.join(decision_table(joined, list(learners), "actual"), list(learners)).select("item", "actual", "predicted")


def grid(name: str, df: DataFrame, label: str, features: str, id_col: str, settings: list[dict], k: int = 3) -> DataFrame:
    """(setting, accuracy) by cross-validation of each setting."""
    from .evaluation import accuracy

    out = None
    for i, params in enumerate(settings):
        r = accuracy(cross_validate(name, df, label, features, id_col, k, **params)).select(F.lit(i).alias("setting"), "accuracy")
        out = r if out is None else out.union(r)
    return out


def k_medians(df: DataFrame, id_col: str, features: str, k: int, rounds: int = 5) -> tuple[list[list[float]], DataFrame]:
    """Manhattan k-means: the first k ids start, each round assigns rows to the nearest centre and takes exact medians. Centres and (id, cluster)."""
    from ..functions import arrays as A

    centres = [r[0] for r in df.orderBy(id_col).select(features).limit(k).collect()]

    def assigned() -> DataFrame:
        near = F.array_min(F.array(*(F.struct(F.round(A.manhattan(F.col(features), F.array(*map(F.lit, c))), 9).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
        return df.select(F.col(id_col).alias("id"), F.col(features).alias("v"), near["i"].alias("cluster"))

    for _ in range(rounds):
        m = assigned().select("cluster", F.posexplode("v").alias("t", "x")).groupBy("cluster", "t").agg(F.percentile("x", F.lit(0.5)).alias("m"))
        rows = m.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "m"))), lambda e: e["m"]).alias("c")).collect()
        now = list(centres)
        for r in rows:
            now[r.cluster] = list(r.c)
        if now == centres:
            break
        centres = now
    return centres, assigned().select("id", "cluster")


def x_means(df: DataFrame, features: str, low: int, high: int, seed: int = 1) -> DataFrame:
    """``df`` with ``cluster``: k-means with ``low`` centres, then clusters split in two while that raises the Bayesian information criterion."""
    from ..functions import arrays as A

    def spread(x: DataFrame) -> tuple[int, float, int]:
        centre = x.select(F.posexplode(features).alias("t", "v")).groupBy("t").agg(F.avg("v").alias("v")).orderBy("t").collect()
        c = F.array(*(F.lit(float(r.v)) for r in centre))
        r = x.agg(F.count("*").alias("n"), F.sum(A.squared_euclidean(F.col(features), c)).alias("s")).first()
        return r.n, float(r.s or 0.0), len(centre)

    def bic(parts: list[tuple[int, float, int]]) -> float:
        n, k, d = sum(p[0] for p in parts), len(parts), parts[0][2]
        var = max(1e-12, sum(p[1] for p in parts) / max(1, n - k) / d)
        like = sum(p[0] * math.log(p[0] / n) - p[0] * d / 2 * math.log(2 * math.pi * var) - (p[0] - 1) * d / 2 for p in parts if p[0])
        return like - (k * (d + 1)) / 2 * math.log(n)

    first = k_means(df, features, low, seed) if low > 1 else df.withColumn("cluster", F.lit(0))
    now = first.withColumn("cluster", F.col("cluster").cast("string"))
    count, open_ = low, [str(i) for i in range(low)]
    while open_ and count < high:
        name = open_.pop(0)
        part = now.where(F.col("cluster") == name).drop("cluster")
        if part.count() < 4:
            continue
        two = k_means(part, features, 2, seed)
        halves = [spread(two.where(F.col("cluster") == i)) for i in (0, 1)]
        if min(h[0] for h in halves) and bic(halves) > bic([spread(part)]):
            kept = two.withColumn("cluster", F.concat(F.lit(f"{name}."), F.col("cluster").cast("string")))
            now = now.where(F.col("cluster") != name).unionByName(kept.select(*now.columns))
            open_ += [f"{name}.0", f"{name}.1"]
            count += 1
    return now


def leaf_membership(df: DataFrame, features: str, label: str, id_col: str, depth: int = 3) -> DataFrame:
    """(id, leaf, membership): the tree leaf of each row and its indicator array over the leaves."""
    x = as_vectors(df, features, label)
    model = DecisionTreeClassifier(maxDepth=depth, leafCol="leaf").fit(x)
    leaves = model.transform(x).select(F.col(id_col).alias("id"), F.col("leaf").cast("int").alias("leaf"))
    most = leaves.agg(F.max("leaf")).first()[0]
    return leaves.withColumn("membership", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: (i == F.col("leaf")).cast("int")))


def median_squares(df: DataFrame, x: str, y: str, id_col: str, tries: int = 30, seed: int = 1) -> dict:
    """Least median of squares: lines through pairs of rows chosen by hash, judged by the median squared residual of all rows in one job."""
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(2 * tries).select(x, y).collect()
    lines = []
    for a, b in zip(ends[::2], ends[1::2], strict=False):
        if a[0] != b[0]:
            slope = (b[1] - a[1]) / (b[0] - a[0])
            lines.append((float(slope), float(a[1] - slope * a[0])))
    r = df.agg(*(F.percentile(F.pow(F.col(y) - s * F.col(x) - c, F.lit(2)), F.lit(0.5)).alias(f"l{i}") for i, (s, c) in enumerate(lines))).first()
    i = min(range(len(lines)), key=lambda i: (r[f"l{i}"], i))
    return {"slope": lines[i][0], "intercept": lines[i][1], "median": r[f"l{i}"]}


def profile_clusters(results: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(dataset, cluster): datasets by the accuracies of all methods on them (dataset, method, mean), a method without a result at 0."""
    methods = [r[0] for r in results.select("method").distinct().orderBy("method").collect()]
    p = results.groupBy("dataset").pivot("method", methods).agg(F.first("mean")).na.fill(0.0)
    x = p.select("dataset", F.array(*(F.col(f"`{m}`") for m in methods)).alias("features"))
    return k_means(x, "features", k, seed).select("dataset", "cluster")
