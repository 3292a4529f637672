"""Queries of the dictionary and shapelet operators, with SQL that builds the same words and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import evaluation, series, symbols
from ..sources import files
from .catalog import ORACLE_SQL, query, r6, vectors

# Every window of 16 points, z-normalised, as a word of four letters; a run of equal words counts once.
_ZW = "case when list_stddev_pop(s[i + 1 : i + 16]) > 0 then list_transform(s[i + 1 : i + 16], lambda x: (x - list_avg(s[i + 1 : i + 16])) / list_stddev_pop(s[i + 1 : i + 16])) else list_transform(range(16), lambda x: 0.0::double) end"
BAGS = f"""v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), w as (select vec_id, label, unnest(range(49)) as i, s from v), z as (select vec_id, label, i, {_ZW} as z from w),
l as (select vec_id, label, i, list_aggregate(list_transform([0, 1, 2, 3], lambda k: case when list_avg(z[4 * k + 1 : 4 * k + 4]) > 0.67 then 'd' when list_avg(z[4 * k + 1 : 4 * k + 4]) > 0 then 'c' when list_avg(z[4 * k + 1 : 4 * k + 4]) > -0.67 then 'b' else 'a' end), 'string_agg', '') as word from z),
r as (select vec_id, label, word from (select *, lag(word) over (partition by vec_id order by i) as before from l) where before is null or before <> word), b as (select vec_id, label, word, count(*) as n from r group by all)"""

ORACLE_SQL["b_bag_of_patterns"] = f"with {BAGS} select vec_id, label, word, n from b"
ORACLE_SQL["b_sax_vector_space"] = f"""with {BAGS}, t as (select label, word, sum(n) as tf from b group by all), q as (select label, word, ln(1 + tf) * ln((select count(distinct label) from b) / count(*) over (partition by word)) as w from t), n as (select label, sqrt(sum(w * w)) as norm from q group by 1),
s as (select vec_id, q.label as class, round(sum(coalesce(b.n * w / nullif(norm, 0), 0)), 9) as s from b join q using (word) join n on n.label = q.label group by all), p as (select vec_id, arg_max(class, (s, -class)) as predicted from s group by 1) select predicted, count(*) as n from p group by 1"""


def _bags(spark, d):
    return symbols.bag_of_patterns(vectors(spark, d), "vec_id", "s", 16, 4, label="label")


@query(f"with {BAGS} select vec_id, label, substr(word, 1, 2) as word, sum(n)::bigint as n from b group by all")
def b_shorten_words(spark, d):
    return symbols.shorten_words(_bags(spark, d), 2)


_QUERY = "x as (select * from b where vec_id % 100 = 0)"


@query(f"with {BAGS}, {_QUERY}, p as (select x.vec_id as a, b.vec_id as b, sum(b.n * b.n - 2 * x.n * b.n) as p from x join b using (word) where x.vec_id <> b.vec_id group by all), q as (select vec_id as a, sum(n * n) as q from x group by 1) select a, b, (q + p)::bigint as distance from p join q using (a)")
def b_boss_distance(spark, d):
    b = _bags(spark, d).drop("label")
    return symbols.boss_distance(b.where("vec_id % 100 = 0"), b, "vec_id")


@query(f"with {BAGS}, {_QUERY}, n as (select vec_id, sqrt(sum(n * n)) as m from b group by 1), p as (select x.vec_id as a, b.vec_id as b, sum(x.n * b.n) as p from x join b using (word) where x.vec_id <> b.vec_id group by all) select a, b, round(p / (na.m * nb.m), 6) as similarity from p join n na on na.vec_id = a join n nb on nb.vec_id = b")
def b_bag_cosine(spark, d):
    b = _bags(spark, d).drop("label")
    return r6(symbols.bag_cosine(b.where("vec_id % 100 = 0"), b, "vec_id"))


@query(f"with {BAGS}, p as (select x.vec_id as a, b.vec_id as b, sum(b.n * b.n - 2 * x.n * b.n) as p from b x join b using (word) where x.vec_id <> b.vec_id group by all), m as (select a, arg_min(b, (p, b)) as b from p group by 1), y as (select a.label as actual, b.label as predicted from m join v a on a.vec_id = m.a join v b on b.vec_id = m.b) select actual, predicted, count(*) as n from y group by all")
def b_nearest_bag(spark, d):
    x = vectors(spark, d)
    b = _bags(spark, d).drop("label")
    return evaluation.confusion(symbols.nearest_bag(symbols.nearest_boss(b, "vec_id"), x, "vec_id", "label"))


@query(f"""with {BAGS}, k as (select vec_id, concat_ws('/', k, floor(i * pow(2, k) / 49)::int, word) as word, pow(2, k - 1) as w from l, range(2) t(k)), h as (select vec_id, word, sum(w) as n from k group by all)
select x.vec_id as a, y.vec_id as b, round(sum(least(x.n, y.n)), 6) as shared from h x join h y using (word) where x.vec_id <> y.vec_id group by all""")
def b_pyramid(spark, d):
    w = series.sliding_windows(vectors(spark, d).select("vec_id", "s"), "s", 16).select("vec_id", "start", series.sax(A.z_normalise(F.col("window")), 4, 16).alias("word"))
    h = symbols.pyramid(w, "vec_id", 49, 2)
    return r6(symbols.histogram_intersection(h, h, "vec_id"))


@query(f"""with {BAGS}, p as (select vec_id, label, list_transform(range(8), lambda k: case when list_avg(s[8 * k + 1 : 8 * k + 8]) > 0.67 then 3 when list_avg(s[8 * k + 1 : 8 * k + 8]) > 0 then 2 when list_avg(s[8 * k + 1 : 8 * k + 8]) > -0.67 then 1 else 0 end) as w from v),
n as (select a.vec_id, a.label as actual, b.label as predicted, row_number() over (partition by a.vec_id order by len(list_filter(range(1, 9), lambda i: a.w[i] <> b.w[i])), b.vec_id) as r from p a, p b where a.vec_id <> b.vec_id) select vec_id, actual, predicted from n where r = 1""")
def b_sax_nearest(spark, d):
    word = F.transform(F.split(series.sax(F.col("s"), 8, 64), ""), lambda c: F.when(c == "", None).otherwise(F.ascii(c).cast("double")))
    x = vectors(spark, d).select("vec_id", "label", F.array_compact(word).alias("s"))
    # letters differ or not: each letter as four indicators, half the Manhattan distance
    x = x.withColumn("s", F.flatten(F.transform("s", lambda c: F.array(*(F.when(c == 97.0 + i, 0.5).otherwise(0.0) for i in range(4))))))
    n = symbols.nearest_word(x, "vec_id", "s", "label")
    return n.select(F.col("id").alias("vec_id"), "actual", "predicted")


_SFA = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), w as (select vec_id, label, unnest(range(49)) as i, s from v),
f as (select vec_id, label, i, list_stddev_pop(s[i + 1 : i + 16]) as sd, list_transform([1, 2], lambda k: [list_sum(list_transform(range(16), lambda t: s[i + t + 1] * cos(2 * pi() * k * t / 16))), -list_sum(list_transform(range(16), lambda t: s[i + t + 1] * sin(2 * pi() * k * t / 16)))]) as c from w),
c as (select vec_id, label, i, list_transform(flatten(c), lambda x: round(x / sd / 4, 2)) as c from f), q as (select k, quantile_cont(c[k], [0.25, 0.5, 0.75]) as q from c, range(1, 5) t(k) where i % 16 = 0 group by k), t as (select list(q order by k) as q from q),
x as (select vec_id, label, i, list_aggregate(list_transform([1, 2, 3, 4], lambda k: case when c[k] > q[k][3] then 'd' when c[k] > q[k][2] then 'c' when c[k] > q[k][1] then 'b' else 'a' end), 'string_agg', '') as word from c, t)"""
ORACLE_SQL["b_sfa_words"] = f"with {_SFA} select word, count(*) as n from x group by 1"


def _sfa(spark, d):
    return symbols.sfa_words(symbols.sfa_coefficients(vectors(spark, d), "vec_id", "s", 16, 4), "vec_id", 16)


@query(f"""with {_SFA}, p as (select vec_id, label, word from x union all select vec_id, label, word || ' ' || nx from (select vec_id, label, word, lead(word, 16) over (partition by vec_id order by i) as nx from x) where nx is not null), u as (select word, label, count(*) as o from p group by all), g as (select word, label, coalesce(o, 0) as o, sum(coalesce(o, 0)) over (partition by word) as w, sum(coalesce(o, 0)) over (partition by label) as c, sum(coalesce(o, 0)) over () as t from (select distinct word from u) cross join (select distinct label from u) left join u using (word, label)),
k as (select word from g group by 1 having sum(power(o - w * c / t, 2) / (w * c / t)) >= 12) select vec_id, word, count(*) as n from p join k using (word) group by all""")
def b_weasel(spark, d):
    return symbols.weasel_features(_sfa(spark, d), vectors(spark, d), "vec_id", "label", 16, 12.0)


@query()
def b_boss_grid(spark, d):
    return r6(symbols.boss_grid(vectors(spark, d), "vec_id", "s", "label", [(10, 4), (16, 4), (16, 6)]))


# --- H: the first windows of six series as shapelets -------------------------------------------------------------------

LINES = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), h as (select vec_id as k, list_transform(s[1:16], lambda x: (x - list_avg(s[1:16])) / list_stddev_pop(s[1:16])) as h from v where vec_id < 6),
w as (select vec_id, label, unnest(range(49)) as i, s from v), z as (select vec_id, label, list_transform(s[i + 1 : i + 16], lambda x: (x - list_avg(s[i + 1 : i + 16])) / list_stddev_pop(s[i + 1 : i + 16])) as z from w),
d as (select vec_id, label, k, round(min(list_sum(list_transform(range(1, 17), lambda t: power(z[t] - h[t], 2))) / 16), 9) as d from z, h group by all)"""


def _transform(spark, d):
    x = vectors(spark, d)
    own = x.where("vec_id < 6").orderBy("vec_id").select(A.z_normalise(F.slice("s", 1, 16)).alias("h")).collect()
    return symbols.shapelet_transform(x, ["vec_id", "label"], "s", [r.h for r in own])


# The same distances before they are rounded to nine digits: rounding twice is not rounding once.
PLAIN_LINES = LINES.replace("round(min(", "(min(").replace(", 9) as d", ") as d")


@query(f"with {PLAIN_LINES} select vec_id, label, list(round(d, 6) order by k) as distances from d group by all")
def h_transform(spark, d):
    return r6(_transform(spark, d))


@query(f"with {LINES}, e as (select k, label, count(*) as n, sum(d) as s, sum(d * d) as q from d group by all), t as (select k, count(*) as c, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as b from e group by 1) select k::int as k, round((b - s * s / n) / (c - 1) / ((q - b) / (n - c)), 5) as f_statistic from t")
def h_f_statistic(spark, d):
    return symbols.shapelet_quality(_transform(spark, d), "label").select("k", (F.round("f_statistic", 5) + 0.0).alias("f_statistic"))


@query(f"""with {LINES}, c as (select k, d, label, count(*) as n from d group by all), g as (select k, d, label, a, coalesce(n, 0) as n from (select distinct k, d from c) join (select k, label, sum(n) as a from c group by all) using (k) left join c using (k, d, label)), b as (select *, sum(n) over (partition by k, label order by d) as b from g),
s as (select k, d, sum(b) as nb, sum(a) as na, sum(n) * d as w, sum(case when a > 0 then -a * log2(a) else 0 end) as ea, sum(case when b > 0 then -b * log2(b) else 0 end) as eb, sum(case when a > b then -(a - b) * log2(a - b) else 0 end) as er from b group by k, d),
x as (select k, d, lead(d) over (partition by k order by d) as nx, nb, na, sum(w) over (partition by k order by d) as u, sum(w) over (partition by k) as t, ea, eb, er from s), y as (select *, round((ea + na * log2(na) - (eb + nb * log2(nb)) - (er + (na - nb) * log2(na - nb))) / na, 9) as gain, (t - u) / (na - nb) - u / nb as gap from x where nx is not null),
m as (select k, arg_max({{'d': d, 'nx': nx, 'gap': gap}}, (gain, -d)) as m, max(gain) as gain from y group by 1) select k::int as k, round((m.d + m.nx) / 2, 6) as threshold, round(gain, 6) as gain, round(m.gap, 6) as gap from m""")
def h_information_gain(spark, d):
    return r6(symbols.shapelet_information(_transform(spark, d), "label"))


@query(f"with {LINES}, r as (select k, label, rank() over (partition by k order by d) + (count(*) over (partition by k, d) - 1) / 2 as r from d), g as (select k, label, count(*) as m, sum(r) as s from r group by all) select k::int as k, round(12 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1), 5) as h from g group by 1")
def h_kruskal_wallis(spark, d):
    return symbols.shapelet_kruskal(_transform(spark, d), "label").select("k", (F.round(F.col("h").cast("double"), 5) + 0.0).alias("h"))


@query(f"with {LINES}, m as (select k, quantile_cont(d, 0.5) as m from d group by 1), c as (select k, label, sum((d > m)::int) as up, count(*) as n from d join m using (k) group by all), t as (select *, sum(up) over (partition by k) as us, sum(n) over (partition by k) as t from c) select k::int as k, round(sum(power(up - n * us / t, 2) / (n * us / t) + power(n - up - n * (t - us) / t, 2) / (n * (t - us) / t)), 6) as chi_squared from t group by 1")
def h_moods_median(spark, d):
    return r6(symbols.shapelet_mood(_transform(spark, d), "label"))


@query("select vec_id as series_id, label as class, start::int as start, n::int as length, 'z' as kind from embeddings, (values (12), (20)) l(n), range(53) t(start) where start <= 64 - n")
def h_candidates(spark, d):
    return symbols.shapelet_candidates(vectors(spark, d), "vec_id", "s", "label", [12, 20]).select("series_id", "class", "start", "length", F.lit("z").alias("kind"))


@query()
def h_scored_candidates(spark, d):
    return r6(symbols.scored_candidates(vectors(spark, d), "vec_id", "s", "label", [20]))


@query()
def h_balanced(spark, d):
    best = symbols.best_shapelets(vectors(spark, d), "vec_id", "s", "label", [12], 20, balanced=True)
    return spark.createDataFrame([(int(b["class"]), int(b["series_id"]), int(b["start"]), int(b["length"])) for b in best], "class int, series_id long, start int, length int")


@query()
def h_tree(spark, d):
    x = vectors(spark, d)
    tree = symbols.shapelet_tree(x, "vec_id", "s", "label", [16], 1)
    return evaluation.confusion(symbols.tree_predict(x, ["vec_id", "label"], "s", tree).withColumnRenamed("label", "actual"))


@query("select vec_id as series_id, 0::int as start, label::varchar as class, list_transform(embedding[1:16], lambda x: round(x::double, 6)) as content from embeddings")
def h_file(spark, d):
    path = files.scratch(spark, "shapelets")
    own = vectors(spark, d).select(F.lit(1.0).alias("quality"), F.col("vec_id").alias("series_id"), F.lit(0).alias("start"), F.col("label").cast("string").alias("class"), F.slice("s", 1, 16).alias("content"))
    symbols.write_shapelets(own, path)
    return r6(symbols.read_shapelets(spark, path).select("series_id", "start", "class", "content"))
