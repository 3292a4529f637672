"""Queries of multivariate and remaining elastic distances, further shapelet searches, and model families without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import distances, ensembles, evaluation, mining, models, series, symbols
from .catalog import _results, query, r6, read, vectors
from .learned import SETS, _rules
from .series_queries import W64


@query(f"""with recursive {W64}, p as (select a.vec_id as x, b.vec_id as y, a.s as a, b.s as b from v a, v b where a.vec_id <> b.vec_id),
r as (select x, y, a, b, 0 as i, list_transform(range(65), lambda j: case when j = 0 then 0.0::double else 1e300::double end) as row from p union all
select x, y, a, b, i + 1, list_reduce(list_transform(range(1, 65), lambda j: [case when abs(i + 1 - j) <= 1 then least(row[j] + abs(a[i + 1] - b[j]), case when i > 0 then row[j + 1] + 1 else 1e300 end) else 1e300 end, case when abs(i + 1 - j) <= 1 and j > 1 then 1.0 else 1e300 end]), lambda acc, e: list_append(acc, least(e[1], least(1e300, acc[len(acc)] + e[2]))), [1e300::double]) from r where i < 64)
select x, y, round(row[65], 6) as score from r where i = 64""")
def d_time_aligned(spark, d):
    v = vectors(spark, d)
    return r6(distances.pair_values(v, v, "vec_id", "s", {"score": distances.paired("taa")}, ("x", "y")))


def _channel_values(spark, d, name, dependent):
    v = series.to_channels(vectors(spark, d), "s", 16)
    return distances.pair_values(v, v, "vec_id", "channels", {name: distances.paired_channels(dependent=dependent)}, ("x", "y"))


_COST = "list_sum(list_transform([0, 1, 2, 3], lambda k: power(a[16 * k + i + 1] - b[16 * k + j], 2)))"


@query(f"""with recursive {W64}, p as (select a.vec_id as x, b.vec_id as y, a.s as a, b.s as b from v a, v b where b.vec_id <> a.vec_id),
r as (select x, y, a, b, 0 as i, list_transform(range(17), lambda j: case when j = 0 then 0.0::double else 1e300::double end) as row from p union all
select x, y, a, b, i + 1, list_reduce(list_transform(range(1, 17), lambda j: [{_COST} + least(row[j], row[j + 1]), {_COST}]), lambda acc, e: list_append(acc, least(e[1], least(1e300, acc[len(acc)] + e[2]))), [1e300::double]) from r where i < 16)
select x, y, round(sqrt(row[17]), 6) as dependent from r where i = 16""")
def d_dependent_dtw(spark, d):
    return r6(_channel_values(spark, d, "dependent", True))


@query(f"""with recursive {W64}, p as (select a.vec_id as x, b.vec_id as y, k, a.s[16 * k + 1 : 16 * k + 16] as a, b.s[16 * k + 1 : 16 * k + 16] as b from v a, v b, range(4) t(k) where b.vec_id <> a.vec_id),
r as (select x, y, k, a, b, 0 as i, list_transform(range(17), lambda j: case when j = 0 then 0.0::double else 1e300::double end) as row from p union all
select x, y, k, a, b, i + 1, list_reduce(list_transform(range(1, 17), lambda j: [power(a[i + 1] - b[j], 2) + least(row[j], row[j + 1]), power(a[i + 1] - b[j], 2)]), lambda acc, e: list_append(acc, least(e[1], least(1e300, acc[len(acc)] + e[2]))), [1e300::double]) from r where i < 16)
select x, y, round(sum(sqrt(row[17])), 6) as independent from r where i = 16 group by all""")
def d_independent_dtw(spark, d):
    return r6(_channel_values(spark, d, "independent", False))


@query()
def d_adaptive_channels(spark, d):
    v = series.to_channels(vectors(spark, d), "s", 16)
    _, said = distances.adaptive_channels(v, v, "vec_id", "channels", "label")
    return evaluation.confusion(said)


@query()
def d_sphere_cover(spark, d):
    return r6(distances.sphere_cover(vectors(spark, d), "vec_id", "s", "label").select("class", "radius", "covered"))


@query("select module, n from (select unnest(['dtw', 'erp', 'euclidean', 'lcss', 'msm', 'twe', 'wdtw']) as module), (select count(*) as n from embeddings where vec_id % 100 = 0)")
def v_elastic_members(spark, d):
    return _elastic(spark, d).groupBy("module").agg(F.count("*").alias("n"))


def _elastic(spark, d):
    x = vectors(spark, d)
    members = {"euclidean": {}, "dtw": {"window": 0.1}, "wdtw": {}, "lcss": {}, "msm": {}, "twe": {}, "erp": {}}
    return distances.elastic_ensemble(x, x.where("vec_id % 100 = 0"), "vec_id", "s", "label", members)


@query()
def v_elastic_ensemble(spark, d):
    p = _elastic(spark, d)
    return r6(evaluation.accuracy(ensembles.majority_vote(p, ensembles.module_weights(p, "accuracy", 1.0))))


@query(f"""with {W64}, h as (select vec_id as k, list_transform([0, 1, 2, 3], lambda c: list_transform(s[16 * c + 1 : 16 * c + 6], lambda x: (x - list_avg(s[16 * c + 1 : 16 * c + 6])) / list_stddev_pop(s[16 * c + 1 : 16 * c + 6]))) as h from v where vec_id < 3),
w as (select vec_id, i, list_transform([0, 1, 2, 3], lambda c: list_transform(s[16 * c + i + 1 : 16 * c + i + 6], lambda x: (x - list_avg(s[16 * c + i + 1 : 16 * c + i + 6])) / list_stddev_pop(s[16 * c + i + 1 : 16 * c + i + 6]))) as z from v, range(11) t(i)),
e as (select vec_id, k, i, list_transform([1, 2, 3, 4], lambda c: list_sum(list_transform(range(1, 7), lambda t: power(z[c][t] - h[c][t], 2))) / 6) as e from w, h),
m as (select vec_id, k, min(list_sum(e)) as dep, min(e[1]) + min(e[2]) + min(e[3]) + min(e[4]) as ind from e group by all) select vec_id, list(round(dep, 6) order by k) as dependent, list(round(ind, 6) order by k) as independent from m group by 1""")
def h_channels(spark, d):
    x = series.to_channels(vectors(spark, d), "s", 16)
    own = x.where("vec_id < 3").orderBy("vec_id").select(F.transform("channels", lambda c: A.z_normalise(F.slice(c, 1, 6))).alias("h")).collect()
    shapelets = [r.h for r in own]
    dep = symbols.channel_shapelet_transform(x, ["vec_id"], "channels", shapelets).withColumnRenamed("distances", "dependent")
    ind = symbols.channel_shapelet_transform(x, ["vec_id"], "channels", shapelets, False).withColumnRenamed("distances", "independent")
    return r6(dep.join(ind, "vec_id"))


@query(f"""with {W64}, g as (select vec_id, list_transform(range(8), lambda r: s[8 * r + 1 : 8 * r + 8]) as g from v), p as (select list_transform([1, 2, 3], lambda r: g[r][1:3]) as p from g where vec_id = 0),
e as (select vec_id, list_sum(list_transform([1, 2, 3], lambda a: list_sum(list_transform([1, 2, 3], lambda b: power(g[y + a][x + b] - p[a][b], 2))))) / 9 as e from g, p, range(6) t(y), range(6) u(x)) select vec_id, [round(min(e), 6)] as distances from e group by 1""")
def h_patches(spark, d):
    x = vectors(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("s", r * 8 + 1, F.lit(8))).alias("image"))
    first = x.where("vec_id = 0").first().image
    return r6(symbols.patch_transform(x, ["vec_id"], "image", [[row[:3] for row in first[:3]]]))


@query()
def h_clustered(spark, d):
    best = symbols.best_shapelets(vectors(spark, d), "vec_id", "s", "label", [12], 8)
    groups = symbols.merge_shapelets(best, 3)
    return spark.createDataFrame([(i, int(best[j]["series_id"]), int(best[j]["start"])) for i, g in enumerate(groups) for j in g], "cluster int, series_id long, start int")


@query()
def h_sampled(spark, d):
    return symbols.sampled_candidates(vectors(spark, d), "vec_id", "s", "label", [12], 0.05).select("series_id", "start", "length")


@query()
def h_classifier(spark, d):
    x = vectors(spark, d)
    best = symbols.best_shapelets(x, "vec_id", "s", "label", [16], 10)
    t = symbols.shapelet_transform(x, ["vec_id", "label"], "s", [b["content"] for b in best])
    return r6(evaluation.accuracy(models.cross_validate("forest", t, "label", "distances", "vec_id", 2, numTrees=5, seed=1)))


@query()
def i_own_intervals(spark, d):
    p = symbols.interval_forest(vectors(spark, d), "vec_id", "s", "label", 64, 2)
    return r6(evaluation.accuracy(ensembles.majority_vote(p, ensembles.module_weights(p, "equal"))))


@query()
def i_spectral_ensemble(spark, d):
    p = symbols.spectral_forest(vectors(spark, d), "vec_id", "s", "label", 64, 3)
    return r6(evaluation.accuracy(ensembles.majority_vote(p, ensembles.module_weights(p, "equal"))))


@query()
def b_pattern_forest(spark, d):
    x = vectors(spark, d)
    b = symbols.leaf_bags(x, "vec_id", "s", 64, 16, 3)
    return r6(evaluation.accuracy(symbols.nearest_bag(symbols.nearest_boss(b, "vec_id"), x, "vec_id", "label")))


@query()
def b_bag_of_features(spark, d):
    x = symbols.feature_bags(vectors(spark, d), "vec_id", "s", "label", 64, 6)
    return r6(evaluation.accuracy(models.cross_validate("forest", x, "label", "features", "vec_id", 2, numTrees=5, seed=1)))


@query()
def k_medians(spark, d):
    _, c = models.k_medians(vectors(spark, d), "vec_id", "s", 4, 3)
    return c.groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def k_x_means(spark, d):
    return models.x_means(vectors(spark, d), "s", 2, 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def k_profiles(spark, d):
    return models.profile_clusters(_results(spark, d), 2)


# Two classes that one cut parts: the tree's leaves are its two sides.
@query("select l_orderkey * 10 + l_linenumber as id, case when l_linenumber <= 3 then [1, 0] else [0, 1] end as membership from lineitem")
def c_leaf_membership(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_linenumber").cast("double")).alias("x"), (F.col("l_linenumber") > 3).cast("int").alias("y"))
    return models.leaf_membership(x, "x", "y", "id", 1).select("id", F.transform("membership", lambda v: v.cast("int")).alias("membership"))


@query("select 3.0::double as slope, 7.0::double as intercept, 0.0::double as median from (select count(*) from part)")
def l_median_squares(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (3.0 * F.col("p_size") + 7 + F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice")).otherwise(0.0)).alias("y"))
    line = models.median_squares(x, "x", "y", "p_partkey")
    # four rows in five lie on the line 3x + 7, whatever the rest do
    return r6(spark.createDataFrame([tuple(float(line[c]) for c in ("slope", "intercept", "median"))], "slope double, intercept double, median double"))


@query(f"""with {SETS}, w as (select least(floor(confidence * 20), 19)::int as b, count(*) / sum(count(*)) over () as p from u group by 1), x as (select antecedent, consequent, support * n as h, support / confidence * n as t, w.b, w.p, (w.b + 0.5) / 20 as c from u, w, n), l as (select *, h * ln(c) + (t - h) * ln(1 - c) as l, max(h * ln(c) + (t - h) * ln(1 - c)) over (partition by antecedent, consequent) as top from x)
select antecedent, consequent, round(sum(exp(l - top) * p * c) / sum(exp(l - top) * p), 6) as expected from l group by all""")
def m_predictive(spark, d):
    x = mining.predictive_accuracy(_rules(spark, d), read(spark, d, "lineitem").count())
    return r6(x.select("antecedent", "consequent", "expected"))


@query()
def t_autoregression_order(spark, d):
    return r6(vectors(spark, d).select("vec_id", series.autoregression_by_aic("s").alias("ar")))


# Autocorrelations of the cut series to lag 20; Durbin-Levinson on biased autocovariances, order by order, for the others.
@query(f"""with recursive {W64}, l as (select vec_id, unnest(range(1, 21)) as k, s from v), q as (select vec_id, k, s[1 : 64 - k] as x, s[k + 1 : 64] as y from l), a as (select vec_id, list(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - list_avg(x)) * (p[2] - list_avg(y)))) / len(x) / (list_stddev_pop(x) * list_stddev_pop(y)) order by k) as acf from q group by 1),
c as (select vec_id, list_transform(s, lambda x: x - list_avg(s)) as c from v), r as (select vec_id, list_transform(range(1, 11), lambda k: list_sum(list_transform(range(1, 65 - k), lambda i: c[i] * c[i + k])) / list_sum(list_transform(c, lambda x: x * x))) as r from c),
t as (select vec_id, r, 0 as k, []::double[] as phi, []::double[] as pacf from r union all select vec_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - n * phi[k + 1 - j]), n), list_append(pacf, n)
  from (select *, (r[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j])), 0)) as n from t where k < 10))
select vec_id, list_transform(list_concat(acf, pacf, phi), lambda x: round(x, 6)) as features from t join a using (vec_id) where k = 10""")
def t_combined(spark, d):
    return r6(series.acf_pacf_ar(vectors(spark, d), ["vec_id"], "s", 20))
