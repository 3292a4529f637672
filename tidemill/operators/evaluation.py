"""Evaluation of stored predictions: (item, actual, predicted, probs) rows, by any grouping, and collation over datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranges_for, running_sums, written


def confusion(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    return p.groupBy(*(by or []), "actual", "predicted").agg(F.count("*").alias("n"))


def accuracy(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, accuracy, error, and kappa against chance agreement."""
    c, b = confusion(p, by), by or []
    n = c.groupBy(*b).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    rows, cols = c.groupBy(*b, F.col("actual").alias("c")).agg(F.sum("n").alias("a")), c.groupBy(*b, F.col("predicted").alias("c")).agg(F.sum("n").alias("p"))
    chance = rows.join(cols, [*b, "c"]).groupBy(*b).agg(F.sum(F.col("a") * F.col("p")).alias("chance"))
    both = n.join(chance, b, "left") if b else n.join(F.broadcast(chance))
    acc, e = F.col("hit") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*b, "n", acc.alias("accuracy"), (1 - acc).alias("error"), F.when(e < 1, (acc - e) / (1 - e)).otherwise(1.0).alias("kappa"))


def per_class(p: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1 and MCC of each class, one against the rest."""
    c = confusion(p)
    labels = c.select(F.col("actual").alias("c")).union(c.select("predicted")).distinct()
    each = labels.join(c, (F.col("c") == F.col("actual")) | (F.col("c") == F.col("predicted")), "left")
    hit, own, said = (F.col("actual") == F.col("c")) & (F.col("predicted") == F.col("c")), F.col("actual") == F.col("c"), F.col("predicted") == F.col("c")
    n = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    s = each.groupBy("c").agg(n(hit).alias("tp"), n(said & ~own).alias("fp"), n(own & ~said).alias("fn")).join(F.broadcast(c.agg(F.sum("n").alias("all"))))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("all") - F.col("tp") - F.col("fp") - F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    root = F.sqrt(((tp + fp) * (tp + fn)).cast("double") * ((tn + fp) * (tn + fn)))
    return s.select(F.col("c").alias("label"), tp, fp, fn, tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp * tn - fp * fn, root).alias("mcc"))


def averaged(classes: DataFrame) -> DataFrame:
    """Balanced accuracy, macro, micro and size-weighted F1 of a per-class table."""
    size = F.col("tp") + F.col("fn")
    return classes.agg((F.sum(F.when(size > 0, F.col("recall"))) / F.count_if(size > 0)).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("micro_f1"), (F.sum(F.col("f1") * size) / F.sum(size)).alias("weighted_f1"))


def negative_log_likelihood(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of -log2 of the true class's probability; probability 0 costs 6.64."""
    x = F.element_at("probs", F.col("actual").cast("int") + 1)
    return p.groupBy(*(by or [])).agg(F.avg(F.when(x == 0, 6.64).otherwise(-F.log2(x))).alias("nll"))


def _counted(p: DataFrame, score: str, positive: Column | None) -> DataFrame:
    """(score, p, n): positives and negatives of each distinct score, a written table."""
    pos = (F.col("actual") == 1) if positive is None else positive
    return written(p.groupBy(score).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")), "scores")


def _scored(p: DataFrame, score: str, positive: Column | None) -> DataFrame:
    """(score, p, n, p_upto, n_upto): positives and negatives of each distinct score, and of it with all above."""
    counted = _counted(p, score, positive)
    return running_sums(counted, score, ["p", "n"], descending=True, parts=ranges_for(counted))


def auroc(p: DataFrame, score: str = "score", positive: Column | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged: equal scores are counted first, so only distinct scores are sorted."""
    s = _scored(p, score, positive)
    w = F.sum(F.col("n") * (F.col("p_upto") - F.col("p") / 2))
    return s.agg((w / (F.sum("p") * F.sum("n"))).alias("auroc"))


def threshold_curve(p: DataFrame, score: str = "score", positive: Column | None = None) -> DataFrame:
    """Per distinct score from the top: TP, FP, rates, precision, recall, lift, sample share."""
    counted = _counted(p, score, positive)
    all_p, all_n = counted.agg(F.sum("p"), F.sum("n")).first()
    c = running_sums(counted, score, ["p", "n"], descending=True, parts=ranges_for(counted)).withColumns({"all_p": F.lit(all_p).cast("long"), "all_n": F.lit(all_n).cast("long")})
    tp, fp, every = F.col("p_upto"), F.col("n_upto"), F.col("all_p") + F.col("all_n")
    return c.select(
        score, tp.alias("tp"), fp.alias("fp"), (tp / F.col("all_p")).alias("recall"), (fp / F.col("all_n")).alias("fallout"), (tp / (tp + fp)).alias("precision"),
        (tp / (tp + fp) * every / F.col("all_p")).alias("lift"), ((tp + fp) / every).alias("sample_share"), (F.col("p") / F.col("all_p")).alias("recall_step"),
    )


def auprc(p: DataFrame, score: str = "score", positive: Column | None = None) -> DataFrame:
    """Area under the precision-recall curve by trapezia; the first one is a rectangle."""
    s = _scored(p, score, positive)
    tp, fp, p0, n0 = F.col("p_upto"), F.col("n_upto"), F.col("p_upto") - F.col("p"), F.col("n_upto") - F.col("n")
    now = tp / (tp + fp)
    before = F.when(p0 + n0 > 0, p0 / (p0 + n0)).otherwise(now)
    return s.agg((F.sum(F.col("p") * (now + before) / 2) / F.sum("p")).alias("auprc"))


def margin_curve(p: DataFrame, decimals: int = 12) -> DataFrame:
    """(margin, share): cumulative share of p(true) less the largest other probability, rounded so that equal margins meet."""
    true = F.element_at("probs", F.col("actual").cast("int") + 1)
    other = F.array_max(F.filter("probs", lambda x, i: i != F.col("actual")))
    m = running_sums(p.select(F.round(true - other, decimals).alias("margin")).groupBy("margin").agg(F.count("*").alias("n")), "margin", ["n"])
    return m.join(F.broadcast(m.agg(F.sum("n").alias("all")))).select("margin", (F.col("n_upto") / F.col("all")).alias("share"))


def regression_errors(p: DataFrame, actual: str, predicted: str, train_mean: float | None = None) -> DataFrame:
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    m = F.lit(train_mean) if train_mean is not None else F.col("__m")
    base = p if train_mean is not None else p.join(F.broadcast(p.agg(F.avg(a).alias("__m"))))
    return base.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(F.abs(e)) / F.sum(F.abs(a - m))).alias("relative_absolute"), F.sqrt(F.sum(e * e) / F.sum((a - m) * (a - m))).alias("root_relative_squared"), F.corr(actual, predicted).alias("correlation"))


def information_score(p: DataFrame, prior: DataFrame) -> DataFrame:
    """Mean Kononenko-Bratko score in bits; prior: (actual, share)."""
    x = F.element_at("probs", F.col("actual").cast("int") + 1)
    gain = F.when(x >= F.col("share"), F.log2(x) - F.log2("share")).otherwise(F.log2(1 - F.col("share")) - F.log2(1 - x))
    return p.join(F.broadcast(prior), "actual").agg(F.avg(gain).alias("information_score"))


def cost(p: DataFrame, matrix: DataFrame) -> DataFrame:
    """Total and mean cost; matrix: (actual, predicted, cost)."""
    return confusion(p).join(F.broadcast(matrix), ["actual", "predicted"], "left").agg(F.sum(F.col("n") * F.coalesce("cost", F.lit(0.0))).alias("total_cost"), (F.sum(F.col("n") * F.coalesce("cost", F.lit(0.0))) / F.sum("n")).alias("mean_cost"))


def bias_variance(p: DataFrame) -> DataFrame:
    """Kohavi-Wolpert: predictions of one item over repeated samples -> mean error, squared bias, variance."""
    s = p.groupBy("item", "actual", "predicted").count().withColumn("q", F.col("count") / F.sum("count").over(Window.partitionBy("item")))
    each = s.groupBy("item", "actual").agg(F.sum(F.col("q") * F.col("q")).alias("q2"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("q")).otherwise(0.0)).alias("hit"))
    return each.agg(F.avg(1 - F.col("hit")).alias("error"), F.avg((1 - 2 * F.col("hit") + F.col("q2")) / 2).alias("bias2"), F.avg((1 - F.col("q2")) / 2).alias("variance"))


def collate(results: DataFrame, metric: str) -> DataFrame:
    """Mean and deviation over folds of each method and dataset."""
    return results.groupBy("method", "dataset").agg(F.count(metric).alias("folds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))


def average_ranks(means: DataFrame) -> DataFrame:
    """Mean rank of each method over datasets, best 1, ties averaged."""
    w, same = Window.partitionBy("dataset").orderBy(F.desc("mean")), Window.partitionBy("dataset", "mean")
    r = F.rank().over(w) + (F.count("*").over(same) - 1) / 2
    return means.withColumn("rank", r).groupBy("method").agg(F.avg("rank").alias("average_rank"))


def wins_draws_losses(means: DataFrame) -> DataFrame:
    other = means.select(F.col("method").alias("other"), "dataset", F.col("mean").alias("m2"))
    return means.join(other, "dataset").where("method <> other").groupBy("method", "other").agg(F.count_if(F.col("mean") > F.col("m2")).alias("wins"), F.count_if(F.col("mean") == F.col("m2")).alias("draws"), F.count_if(F.col("mean") < F.col("m2")).alias("losses"))


def dataset_statistics(df: DataFrame, label: str, series: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(F.size(series)).alias("shortest"), F.max(F.size(series)).alias("longest"), F.count_distinct(label).alias("classes"))




def prediction_rows(p: DataFrame) -> DataFrame:
    """(item, actual, predicted, error, confidence): one row a prediction, with the probability of the class it names."""
    return p.select("item", "actual", "predicted", (F.col("actual") != F.col("predicted")).alias("error"), F.get("probs", F.col("predicted").cast("int")).alias("confidence"))


def entropy_gain(p: DataFrame) -> DataFrame:
    """Mean bits of the true class under the prior and under the predictions, and what the predictions save."""
    n = p.groupBy("actual").agg(F.count("*").alias("__n"))
    share = n.join(F.broadcast(n.agg(F.sum("__n").alias("__t")))).select("actual", (F.col("__n") / F.col("__t")).alias("__share"))
    x = F.element_at("probs", F.col("actual").cast("int") + 1)
    both = p.join(F.broadcast(share), "actual").agg(F.avg(-F.log2("__share")).alias("prior_entropy"), F.avg(F.when(x == 0, 6.64).otherwise(-F.log2(x))).alias("scheme_entropy"))
    return both.withColumn("gain", F.col("prior_entropy") - F.col("scheme_entropy"))


def region_coverage(p: DataFrame, least: float) -> DataFrame:
    """Share of rows whose true class has probability ``least`` or more, and the mean share of classes that have."""
    inside = F.size(F.filter("probs", lambda x: x >= least)) / F.size("probs")
    return p.agg(F.avg((F.element_at("probs", F.col("actual").cast("int") + 1) >= least).cast("double")).alias("coverage"), F.avg(inside).alias("region_size"))


def pairwise_tests(means: DataFrame) -> DataFrame:
    """For each pair of methods, over datasets: mean difference, t, positive differences, the larger signed-rank sum, and normal p-values of all three."""
    from .tests import two_sided

    b = means.select(F.col("method").alias("other"), "dataset", F.col("mean").alias("m2"))
    d = means.join(b, "dataset").where("method < other").select("method", "other", F.round(F.col("mean") - F.col("m2"), 9).alias("d"))
    same = Window.partitionBy("method", "other")
    ranked = d.where("d <> 0").withColumn("r", F.rank().over(same.orderBy(F.abs("d"))) + (F.count("*").over(Window.partitionBy("method", "other", F.abs("d"))) - 1) / 2)
    w = ranked.groupBy("method", "other").agg(F.count("*").alias("__k"), F.greatest(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0))).alias("w"))
    s = d.groupBy("method", "other").agg(F.count("*").alias("datasets"), F.avg("d").alias("mean_difference"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"), F.count_if(F.col("d") > 0).alias("above"), F.count_if(F.col("d") < 0).alias("__below"))
    n, k = F.col("datasets"), F.col("__k")
    out = s.join(w, ["method", "other"], "left").withColumn("p_t", two_sided(F.col("t"))).withColumn("p_sign", two_sided((F.greatest("above", "__below") - n / 2) / F.sqrt(n / 4)))
    return out.withColumn("p_signed_rank", F.when(k > 0, two_sided((F.col("w") - k * (k + 1) / 4) / F.sqrt(k * (k + 1) * (2 * k + 1) / 24))).otherwise(1.0)).drop("__k", "__below")


def cliques(pairs: DataFrame, alpha: float = 0.05, p: str = "p_signed_rank") -> DataFrame:
    """(clique, methods): the largest groups of methods none of whose pairs differs at ``alpha`` (over the number of pairs).

    The table of pairs is one row a pair of methods, a small table, which the driver groups.
    """
    rows = pairs.select("method", "other", p).collect()
    names = sorted({r.method for r in rows} | {r.other for r in rows})
    differ = {frozenset((r.method, r.other)) for r in rows if (r[p] if r[p] is not None else 1.0) < alpha / max(1, len(rows))}
    groups: list[list] = [[]]
    for n in names:
        grown = []
        for g in groups:
            fits = [m for m in g if frozenset((m, n)) not in differ]
            grown += [[*g, n]] if len(fits) == len(g) else [g, [*fits, n]]
        sets = sorted({tuple(g) for g in grown}, key=lambda g: (-len(g), g))
        groups = [list(g) for i, g in enumerate(sets) if not any(set(g) < set(o) for o in sets)]
    kind = dict(pairs.dtypes)["method"]
    return pairs.sparkSession.createDataFrame([(i, g) for i, g in enumerate(groups, 1)], f"clique int, methods array<{kind}>")


def train_test_difference(results: DataFrame, metric: str) -> DataFrame:
    """(method, dataset, difference): mean of the train rows less that of the test rows (``part``), where both are there."""
    mean = lambda part: F.avg(F.when(F.col("part") == part, F.col(metric)))
    return results.groupBy("method", "dataset").agg((mean("train") - mean("test")).alias("difference")).where("difference is not null")


def by_grouping(means: DataFrame, groups: DataFrame) -> DataFrame:
    """(grouping, method, mean, wins): averages and first places inside groups of datasets (``groups``: dataset, grouping)."""
    best = F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("mean"))) == 1
    return means.withColumn("__best", best).join(F.broadcast(groups), "dataset").groupBy("grouping", "method").agg(F.avg("mean").alias("mean"), F.count_if("__best").alias("wins"))


def significant_wins(results: DataFrame, metric: str, z: float = 1.959964) -> DataFrame:
    """Wins, draws and losses over datasets, where a two-sample statistic of unequal variances within ``z`` is a draw."""
    s = results.groupBy("method", "dataset").agg(F.avg(metric).alias("m"), (F.var_samp(metric) / F.count(metric)).alias("e"))
    other = s.select(F.col("method").alias("other"), "dataset", F.col("m").alias("m2"), F.col("e").alias("e2"))
    t = (F.col("m") - F.col("m2")) / F.sqrt(F.col("e") + F.col("e2"))
    p = s.join(other, "dataset").where("method <> other").withColumn("t", t)
    return p.groupBy("method", "other").agg(F.count_if(F.col("t") > z).alias("wins"), F.count_if(F.abs("t") <= z).alias("draws"), F.count_if(F.col("t") < -z).alias("losses"))
