"""Queries of further series transforms and distances, and SQL for the array kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import distances, evaluation, series
from .catalog import ORACLE_SQL, QUERIES, V, query, r6, rounded, read, vectors

W64 = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings)"

# SQL for the kernels of the first catalog.
FFT = f"""{W64}, k as (select vec_id, unnest(range(64)) as k, s from v), f as (select vec_id, k, list_sum(list_transform(range(64), lambda i: s[i + 1] * cos(2 * pi() * k * i / 64))) as re, -list_sum(list_transform(range(64), lambda i: s[i + 1] * sin(2 * pi() * k * i / 64))) as im from k)"""


@query(f"with {FFT} select vec_id, flatten(list([round(re, 6), round(case when k in (0, 32) then 0 else im end, 6)] order by k)) as f from f group by 1")
def t_fourier(spark, d):
    return r6(vectors(spark, d).select("vec_id", F.transform(series.fourier("s"), lambda x, i: F.when(i.isin(1, 65), 0.0).otherwise(x)).alias("f")))


@query(f"""with {FFT}, l as (select vec_id, list(ln(greatest(re * re + im * im, 1e-12)) order by k) as l from f group by 1)
select vec_id, list_transform(range(32), lambda n: round(power(list_sum(list_transform(range(64), lambda k: l[k + 1] * cos(2 * pi() * k * n / 64))) / 64, 2) + power(list_sum(list_transform(range(64), lambda k: l[k + 1] * sin(2 * pi() * k * n / 64))) / 64, 2), 5)) as cepstrum from l""")
def t_cepstrum(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(series.power_cepstrum("s"), lambda x: F.round(x, 5) + 0.0).alias("cepstrum"))


def _haar_sql() -> str:
    steps, last = [], "v"
    for k, n in enumerate((32, 16, 8, 4, 2, 1)):
        at = "s" if k == 0 else "a"
        keep = ", ".join(f"d{j}" for j in range(k))
        steps.append(f"h{k} as (select vec_id, {keep + ', ' if keep else ''}list_transform(range({n}), lambda i: ({at}[2 * i + 1] - {at}[2 * i + 2]) / sqrt(2.0)) as d{k}, list_transform(range({n}), lambda i: ({at}[2 * i + 1] + {at}[2 * i + 2]) / sqrt(2.0)) as a from {last})")
        last = f"h{k}"
    return f"with {W64}, {', '.join(steps)} select vec_id, list_transform(flatten([a, d5, d4, d3, d2, d1, d0]), lambda x: round(x, 6)) as haar from h5"


@query(_haar_sql())
def c_haar(spark, d):
    return r6(vectors(spark, d).select("vec_id", series.haar("s").alias("haar")))


@query(f"""with {W64}, w as (select vec_id, unnest(range(57)) as i, s from v), z as (select vec_id, i, case when list_stddev_pop(s[i + 1 : i + 8]) > 0 then list_transform(s[i + 1 : i + 8], lambda x: (x - list_avg(s[i + 1 : i + 8])) / list_stddev_pop(s[i + 1 : i + 8])) else list_transform(range(8), lambda x: 0.0::double) end as z from w),
m as (select a.vec_id, a.i, min(list_sum(list_transform(range(1, 9), lambda k: power(a.z[k] - b.z[k], 2)))) as m from z a join z b on a.vec_id = b.vec_id and abs(a.i - b.i) > 12 group by 1, 2)
select vec_id, list(round(m, 5) order by i) as profile from m group by 1""")
def t_matrix_profile(spark, d):
    x = vectors(spark, d)
    return x.select("vec_id", F.transform(series.matrix_profile(8)("s"), lambda v: F.round(v, 5) + 0.0).alias("profile"))


ORACLE_SQL["t_hilbert_runs"] = f"""with {W64}, h as (select vec_id, list_transform(range(64), lambda k: round(list_sum(list_transform(range(64), lambda i: case when i <> k then s[i + 1] / (k - i) else 0 end)), 6)) as hilbert from v),
b as (select vec_id, unnest(range(64)) as t, unnest(list_transform(s, lambda x: (x >= list_avg(s))::int)) as b from v), g as (select vec_id, t, b, t - row_number() over (partition by vec_id, b order by t) as g from b),
r as (select vec_id, least(count(*), 10) as n from g group by vec_id, b, g), c as (select vec_id, list_transform(range(1, 11), lambda k: len(list_filter(list(n), lambda x: x = k))::int) as runs from r group by 1)
select vec_id, hilbert, runs from h join c using (vec_id)"""

ORACLE_SQL["t_binary_split"] = f"""with {W64}, l as (select label, unnest(range(64))::int as t, unnest(s) as x from v), c as (select t, x, label, count(*) as n from l group by all), a as (select t, label, sum(n) as n from c group by all), g as (select t, x, label, a.n as total, coalesce(c.n, 0) as n from (select distinct t, x from c) join a using (t) left join c using (t, x, label)),
b as (select t, x, label, total, sum(n) over (partition by t, label order by x) as below from g), s as (select t, x, sum(below) as nb, sum(total) as na, sum(case when total > 0 then -total * log2(total) else 0 end) as ea, sum(case when below > 0 then -below * log2(below) else 0 end) as eb, sum(case when total > below then -(total - below) * log2(total - below) else 0 end) as er from b group by 1, 2),
q as (select t, x, lead(x) over (partition by t order by x) as nx, (ea + na * log2(na) - (eb + nb * log2(nb)) - (er + case when na > nb then (na - nb) * log2(na - nb) else 0 end)) / na as gain from s)
select t, round((arg_max(nx, (round(gain, 12), -x)) + arg_max(x, (round(gain, 12), -x))) / 2, 6) as threshold, round(max(gain), 6) as gain from q where nx is not null group by 1"""


@query(f"with {W64} select vec_id, list_transform(range(8), lambda k: list_transform(s[8 * k + 1 : 8 * k + 8], lambda x: round(x, 6))) as w from v")
def t_disjoint_windows(spark, d):
    x = vectors(spark, d).select("vec_id", series.disjoint_windows(F.col("s"), 8).alias("w"))
    return x.select("vec_id", F.transform("w", lambda w: F.transform(w, lambda v: rounded(v))).alias("w"))


@query(f"""with {W64}, l as (select vec_id, unnest(range(1, 17)) as k, s from v), p as (select vec_id, k, s[1 : 64 - k] as x, s[k + 1 : 64] as y from l),
f as (select vec_id, k, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - list_avg(x)) * (p[2] - list_avg(y)))) / len(x) / (list_stddev_pop(x) * list_stddev_pop(y)) as f from p),
g as (select vec_id, list(round(f, 6) order by k) as f, coalesce(max(k) filter (where abs(f) > 1.6448536269514722 / sqrt(64.0)), 0) as own from f group by 1)
select vec_id, own::int as own, f[1 : own] as cut, f[1 : (select max(own) from g)] as cut_for_all from g""")
def t_truncated_autocorrelation(spark, d):
    x = vectors(spark, d).select("vec_id", series.autocorrelation(F.col("s"), 16).alias("f"))
    x = x.withColumn("own", series.last_significant(F.col("f"), 64, 1.6448536269514722)).withColumn("cut", F.slice("f", F.lit(1), F.col("own")))
    return r6(series.truncate_all(x, "f", "own", "cut_for_all").drop("f"))


@query(f"""with {W64} select vec_id, list_transform(s[17 : 40], lambda x: round(x, 6)) as part from v""")
def t_interval(spark, d):
    return r6(vectors(spark, d).select("vec_id", series.interval(F.col("s"), 16, 24).alias("part")))


@query(f"""with {W64} select vec_id, list_transform([0, 1, 2, 3], lambda k: list_transform(s[16 * k + 1 : 16 * k + 16], lambda x: round(x, 6))) as channels, list_transform(range(1, 17), lambda t: list_transform([0, 1, 2, 3], lambda k: round(s[16 * k + t], 6))) as transposed, list_transform(s, lambda x: round(x, 6)) as joined,
list_transform([0, 1, 2, 3], lambda k: list_transform(s[16 * k + 1 : 16 * k + 16], lambda x: round((x - list_avg(s[16 * k + 1 : 16 * k + 16])) / list_stddev_pop(s[16 * k + 1 : 16 * k + 16]), 6))) as scaled from v""")
def t_channels(spark, d):
    x = series.to_channels(vectors(spark, d), "s", 16)
    two = lambda c: F.transform(c, lambda w: F.transform(w, lambda v: rounded(v)))
    c = F.col("channels")
    # transposed after rounding, in a step of its own: rounded twice in one step, the second array lost the sign of zero
    y = r6(x.select("vec_id", two(c).alias("channels"), F.flatten(c).alias("joined"), two(F.transform(c, A.z_normalise)).alias("scaled")))
    return y.select("vec_id", "channels", series.transpose_channels(F.col("channels")).alias("transposed"), "joined", "scaled")


@query(f"with {W64} select vec_id, k::int as channel, list_transform(s[16 * k + 1 : 16 * k + 16], lambda x: round(x, 6)) as series from v, range(4) t(k)")
def t_split_channels(spark, d):
    split = series.split_channels(series.to_channels(vectors(spark, d), "s", 16), "vec_id", "channels")
    return r6(series.split_channels(series.merge_channels(split, "vec_id"), "vec_id", "channels"))


@query(f"""with {W64}, d as (select vec_id, list_transform(range(1, 65), lambda i: case when i = 1 then ((s[2] - s[1]) + (s[3] - s[1]) / 2) / 2 when i = 64 then ((s[63] - s[62]) + (s[64] - s[62]) / 2) / 2 else ((s[i] - s[i - 1]) + (s[i + 1] - s[i - 1]) / 2) / 2 end) as g, s from v)
select vec_id, round(list_avg(s), 6) as raw, round(list_stddev_pop(g), 6) as derivative, 15::int as lags,
round((64 * list_sum(list_transform(s, lambda x: x * x)) + power(list_sum(s), 2) - power(list_sum(list_transform(range(1, 65), lambda i: s[i] * (2 * (i % 2) - 1))), 2)) / 2, 3) as power from d""")
def t_ensemble_input(spark, d):
    x = series.transform_inputs(vectors(spark, d), "vec_id", "s", 64)
    return x.select("vec_id", F.round(A.mean(F.col("raw")), 6).alias("raw"), F.round(F.sqrt(A.variance(F.col("derivative"))), 6).alias("derivative"), F.size("acf").alias("lags"), F.round(A.total(F.col("power")), 3).alias("power"))


@query(f"with {W64}, w as (select vec_id, label, unnest(range(64))::int as t, unnest(s) as x from v), r as (select t, min(x) as a, max(x) as b from w group by 1) select w.vec_id, list(round((x - a) / (b - a), 6) order by t) as scaled from w join r using (t) group by 1")
def t_interval_normalise(spark, d):
    return r6(series.normalise_time_points(vectors(spark, d), "vec_id", "s", 64).select("vec_id", "scaled"))


@query(f"with {W64} select vec_id, list_transform(s, lambda x: round((x - list_min(s)) / (list_max(s) - list_min(s)), 6)) as unit, list_transform(s, lambda x: round(x / list_stddev_pop(s), 6)) as sd1 from v")
def t_row_scaling(spark, d):
    s = F.col("s")
    return r6(vectors(spark, d).select("vec_id", series.unit_interval(s).alias("unit"), series.unit_deviation(s).alias("sd1")))


# --- D ---------------------------------------------------------------------------------------------------------------

PAIR = "p as (select a.vec_id as x, b.vec_id as y, a.s as s, b.s as t from v a join v b on a.label = b.label and a.vec_id % 100 = 0 and b.vec_id <> a.vec_id)"


def _pairs(spark, d):
    x = vectors(spark, d)
    a, b = x.where("vec_id % 100 = 0").select(F.col("vec_id").alias("x"), "label", F.col("s").alias("a")), x.select(F.col("vec_id").alias("y"), "label", F.col("s").alias("b"))
    return a.join(b, "label").where("x <> y")


@query(f"""with {W64}, w as (select vec_id, unnest(range(64))::int as t, unnest(s) as x from v), g as (select list(r order by t) as r from (select t, max(x) - min(x) as r from w group by 1)), {PAIR}
select x, y, round(list_sum(list_transform(range(1, 65), lambda i: abs(s[i] - t[i]) / r[i])), 6) as gower from p, g""")
def d_gower(spark, d):
    ranges = distances.point_ranges(vectors(spark, d), "s", 64)
    return r6(_pairs(spark, d).select("x", "y", distances.gower(F.col("a"), F.col("b"), ranges).alias("gower")))


@query("select a.p_partkey as x, b.p_partkey as y, levenshtein(a.p_name, b.p_name)::int as edits from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def d_edit(spark, d):
    return distances.edits_within(read(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name")


@query(f"""with {W64}, {PAIR}, e as (select x, y, list_transform(s, lambda v: exp(v / 8 + 2)) as s, list_transform(t, lambda v: exp(v / 8 + 2)) as t from p)
select x, y, round(list_sum(list_transform(range(1, 65), lambda i: s[i] / t[i] - ln(s[i]) / ln(t[i]) - 1)), 5) as divergence, round(list_sum(list_transform(range(1, 65), lambda i: ln(s[i]) - ln(t[i]))), 5) as log_normalised,
round(list_sum(list_transform(range(1, 65), lambda i: 128 * ln((64 * s[i] + 64 * t[i]) / 128) - 64 * ln(s[i]) - 64 * ln(t[i]))), 4) as likelihood_ratio from e""")
def d_spectral(spark, d):
    e = _pairs(spark, d).select("x", "y", *(F.transform(c, lambda v: F.exp(v / 8 + 2)).alias(c) for c in ("a", "b")))
    a, b = F.col("a"), F.col("b")
    five = lambda c: F.round(c, 5) + 0.0
    return e.select("x", "y", five(distances.spectral_divergence(a, b)).alias("divergence"), five(distances.log_normalised(a, b)).alias("log_normalised"), (F.round(distances.likelihood_ratio(a, b, 64, 64), 4) + 0.0).alias("likelihood_ratio"))


@query(f"""with {W64}, {PAIR} select x, y, round(list_sum(list_transform(range(1, 65), lambda i: s[i] * t[i])), 6) as poly,
round(list_sum(list_transform(range(1, 65), lambda i: s[i] * t[i])) / sqrt(list_sum(list_transform(s, lambda v: v * v)) * list_sum(list_transform(t, lambda v: v * v))), 6) as normalised_poly,
round(exp(-0.01 * list_sum(list_transform(range(1, 65), lambda i: power(s[i] - t[i], 2)))), 6) as rbf, round(1 / (1 + 4 * list_sum(list_transform(range(1, 65), lambda i: power(s[i] - t[i], 2)))), 6) as puk from p""")
def d_kernel_matrix(spark, d):
    return r6(_pairs(spark, d).select("x", "y", *(distances.kernel_column(k, F.col("a"), F.col("b")).alias(k) for k in ("poly", "normalised_poly", "rbf", "puk"))))


@query(f"""with {W64}, {PAIR}, m as (select x, y, round(power(list_sum(list_transform(range(1, 65), lambda i: power(abs(s[i] - t[i]), 3))), 1.0 / 3), 6) as minkowski from p) select x, y, minkowski from m""")
def d_minkowski(spark, d):
    return r6(_pairs(spark, d).select("x", "y", A.minkowski(F.col("a"), F.col("b"), 3.0).alias("minkowski")))


@query(f"""with {W64}, n as (select a.vec_id as query, b.vec_id as y, a.label as actual, b.label as label, list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2))) as distance from v a, v b where a.vec_id <> b.vec_id and a.vec_id % 100 = 0),
k as (select *, row_number() over (partition by query order by distance, y) as r from n), w as (select query, actual, label, sum(1 / (distance + 1e-9)) as w from k where r <= 5 group by all)
select query, actual, arg_max(label, (round(w, 12), -label)) as predicted from w group by all""")
def d_weighted_vote(spark, d):
    x = vectors(spark, d)
    return distances.vote(distances.knn_join(x.where("vec_id % 100 = 0"), x, 5, "vec_id", "s", "label"), "inverse")


@query(f"""with {W64}, n as (select a.vec_id as query, a.label as actual, b.label as label, row_number() over (partition by a.vec_id order by list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2))), b.vec_id) as r from v a, v b where a.vec_id <> b.vec_id),
v1 as (select k, query, actual, label, count(*) as w from n, range(1, 6) t(k) where r <= k group by all), p as (select k, query, actual, arg_max(label, (w, -label)) as predicted from v1 group by all)
select k::int as k, round(avg((actual = predicted)::int), 6) as accuracy from p group by 1""")
def d_choose_k(spark, d):
    x = vectors(spark, d)
    return r6(distances.accuracy_by_k(distances.knn_join(x, x, 5, "vec_id", "s", "label")))


@query(f"""with {W64}, p as (select a.vec_id as x, b.vec_id as y, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2)))) as distance from v a, v b where a.vec_id <> b.vec_id) select x, y, round(distance, 6) as distance from p where distance <= 1.15""")
def d_radius(spark, d):
    x = vectors(spark, d)
    return r6(distances.radius_join(x, x, "vec_id", "s", 1.15))


@query(f"""with {W64}, b as (select vec_id // 5 as bag, s[1:8] as s from v), p as (select a.bag as x, b.bag as y, sqrt(list_sum(list_transform(range(1, 9), lambda i: power(a.s[i] - b.s[i], 2)))) as d, a.s as sa, b.s as sb from b a join b b on a.bag < b.bag and a.bag % 100 = 0),
m as (select x, y, min(d) as least from p group by all), h1 as (select x, y, sa, min(d) as d from p group by all), h2 as (select x, y, sb, min(d) as d from p group by all), h as (select x, y, max(d) as d from (select x, y, d from h1 union all select x, y, d from h2) group by all)
select x, y, round(least, 6) as least, round(h.d, 6) as hausdorff from m join h using (x, y)""")
def d_bags(spark, d):
    b = vectors(spark, d).select("vec_id", (F.col("vec_id") / 5).cast("long").alias("bag"), F.slice("s", 1, 8).alias("s"))
    return r6(distances.bag_distances(b.where("bag % 100 = 0"), b, "bag", "vec_id", "s").where("x < y"))


@query(f"""with {W64}, z as (select vec_id, label, case when list_stddev_pop(s) > 0 then list_transform(s, lambda x: (x - list_avg(s)) / list_stddev_pop(s)) else s end as s from v),
g as (select vec_id, label, s, list_transform(range(1, 65), lambda i: case when i = 1 then ((s[2] - s[1]) + (s[3] - s[1]) / 2) / 2 when i = 64 then ((s[63] - s[62]) + (s[64] - s[62]) / 2) / 2 else ((s[i] - s[i - 1]) + (s[i + 1] - s[i - 1]) / 2) / 2 end) as g from z),
p as (select a.vec_id as query, b.vec_id as y, a.label as actual, b.label as label, list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2))) as d, list_sum(list_transform(range(1, 65), lambda i: power(a.g[i] - b.g[i], 2))) as e from g a, g b where a.vec_id <> b.vec_id),
k as (select w, query, actual, arg_min(label, (round(cos(w * pi() / 8) * d + sin(w * pi() / 8) * e, 9), y)) as predicted from p, range(5) t(w) group by all)
select w::int as setting, round(avg((actual = predicted)::int), 6) as accuracy from k group by 1""")
def d_derivative_weighted(spark, d):
    x = vectors(spark, d).select("vec_id", "label", A.z_normalise(F.col("s")).alias("s"))
    x = x.withColumn("g", series.derivative(F.col("s")))
    return r6(distances.weighted_views(x, x, "vec_id", "label", "s", "g", 5).select("setting", "accuracy"))


@query(f"""with {W64}, c as (select vec_id, label, s, list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 64), lambda i: s[i + 1] * cos(k * (i + 0.5) * pi() / 64)))) as g from v),
p as (select a.vec_id as query, b.vec_id as y, a.label as actual, b.label as label, list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2))) as d, list_sum(list_transform(range(1, 65), lambda i: power(a.g[i] - b.g[i], 2))) as e from c a, c b where a.vec_id <> b.vec_id),
k as (select w, query, actual, arg_min(label, (round(cos(w * pi() / 8) * d + sin(w * pi() / 8) * e, 6), y)) as predicted from p, range(5) t(w) group by all)
select w::int as setting, round(avg((actual = predicted)::int), 6) as accuracy from k group by 1""")
def d_transform_weighted(spark, d):
    x = vectors(spark, d).withColumn("g", series.cosine_transform(F.col("s")))
    return r6(distances.weighted_views(x, x, "vec_id", "label", "s", "g", 5).select("setting", "accuracy"))


@query(f"""with recursive {W64}, p as (select a.vec_id as query, b.vec_id as y, b.label as label, a.label as actual, a.s as a, b.s as b from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select query, y, label, actual, a, b, 0 as i, list_transform(range(65), lambda j: case when j = 0 then 0.0::double else 1e300::double end) as row from p union all
select query, y, label, actual, a, b, i + 1, list_reduce(list_transform(range(1, 65), lambda j: [case when abs(i + 1 - j) < 7 then power(a[i + 1] - b[j], 2) + least(row[j], row[j + 1]) else 1e300 end, case when abs(i + 1 - j) < 7 then power(a[i + 1] - b[j], 2) else 1e300 end]), lambda acc, e: list_append(acc, least(e[1], least(1e300, acc[len(acc)] + e[2]))), [1e300::double]) from r where i < 64),
n as (select query, actual, y, label, row[65] as distance, row_number() over (partition by query order by row[65], y) as k from r where i = 64)
select query, actual, y as neighbour, label, round(distance, 6) as distance from n where k = 1""")
def d_windowed_dtw_nearest(spark, d):
    x = vectors(spark, d)
    return r6(distances.pruned_nearest(x.where("vec_id % 100 = 0"), x, "vec_id", "s", "label", 0.1))


@query()
def d_elastic_nearest(spark, d):
    x = vectors(spark, d)
    out = None
    for name in sorted(distances.KERNELS):
        n = distances.knn_join(x.where("vec_id % 100 = 0"), x, 3, "vec_id", "s", "label", name).select(F.lit(name).alias("name"), "query", "neighbour", "distance", "rank")
        out = n if out is None else out.union(n)
    return r6(out)


_BANDS = ORACLE_SQL["d_windowed_dtw_nearest"].rsplit("n as (", 1)[0].replace("where a.vec_id % 100 = 0 and", "where", 1)
_BANDS = _BANDS.replace("a.s as a, b.s as b from v a, v b", "a.s as a, b.s as b, m from v a, v b, (values (2), (4), (7)) t(m)").replace("a, b, 0 as i", "a, b, m, 0 as i").replace("a, b, i + 1", "a, b, m, i + 1").replace("< 7", "< m")


# The same distances in three bands; the nearest by each, and how many queries it labels rightly.
@query(_BANDS + "n as (select m, query, arg_min({'l': label, 'a': actual}, (row[65], y)) as p from r where i = 64 group by all) select (case m when 2 then 0 when 4 then 1 else 2 end)::int as setting, round(avg((p.l = p.a)::int), 6) as accuracy, count(*) as n from n group by m")
def d_window_search(spark, d):
    x = vectors(spark, d)
    return r6(distances.window_search(x, x, "vec_id", "s", "label", [0.02, 0.05, 0.1]).select("setting", "accuracy", "n"))


@query()
def d_locally_weighted(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.length("p_type") / 20.0).alias("x"), F.col("p_retailprice").alias("y"))
    return r6(distances.locally_weighted(x.where("p_partkey % 100 = 0"), x, "p_partkey", "x", "y", 10))

