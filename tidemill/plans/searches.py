"""Queries of the learned, bounded and hashed shapelet searches, the linkage trees and the pivot search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import category_clusters, columns, descriptors, distances, learned_shapelets, linkage, pivots, refined, rotation, series, shapelet_search, string_kernels, symbols, text
from ..streaming import operators as streaming
from .catalog import ORACLE_SQL, query, r6, read, vectors
from .streams import source
from .symbolic import BAGS

_FIRST = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), h as (select vec_id as k, list_transform(s[1:16], lambda x: (x - list_avg(s[1:16])) / list_stddev_pop(s[1:16])) as h from v where vec_id < 6)"


# Soft minima over all windows of the mean squared distances to the first windows of six series.
@query(f"""with {_FIRST}, w as (select vec_id, unnest(range(49)) as i, s from v), z as (select vec_id, i, list_transform(s[i + 1 : i + 16], lambda x: (x - list_avg(s[i + 1 : i + 16])) / list_stddev_pop(s[i + 1 : i + 16])) as z from w),
d as (select vec_id, k, list_sum(list_transform(range(1, 17), lambda t: power(z[t] - h[t], 2))) / 16 as d from z, h), m as (select vec_id, k, sum(d * exp(-30 * d)) / sum(exp(-30 * d)) as m from d group by all) select vec_id, list(round(m, 6) order by k) as distances from m group by 1""")
def h_soft_minima(spark, d):
    x = vectors(spark, d)
    own = x.where("vec_id < 6").orderBy("vec_id").select(A.z_normalise(F.slice("s", 1, 16)).alias("h")).toPandas()["h"]
    return r6(learned_shapelets.soft_transform(x, ["vec_id"], "s", [np.stack(own.to_list())]))


@query()
def h_learned(spark, d):
    x = vectors(spark, d)
    model, _ = learned_shapelets.learn_shapelets(x, "s", "label", [12, 24], 4, epochs=8)
    return learned_shapelets.shapelet_predict(x, ["vec_id", "label"], "s", model).select("vec_id", "label", "predicted")


@query()
def h_bounded_search(spark, d):
    best, report = shapelet_search.bounded_search(vectors(spark, d), "vec_id", "s", "label", [20], 10)
    table = symbols.shapelet_table(spark, best).select("series_id", "start", F.round("quality", 6).alias("quality"))
    share = report.agg((F.sum(F.col("candidates") * F.col("series")) / (F.max("candidates") * F.sum("series"))).alias("work"))
    return table.join(F.broadcast(share)).select("series_id", "start", "quality", F.round("work", 6).alias("work"))


MASKS = [[0, 1], [2], [3], [1, 3]]
_HIDDEN = "[" + ", ".join(" || ".join("'*'" if i in m else f"word[{i + 1}]" for i in range(4)) for m in MASKS) + "]"
POWER = f"""{BAGS}, o as (select distinct vec_id, label, word from l), k as (select vec_id, label, word, unnest(range({len(MASKS)})) as m, unnest({_HIDDEN}) as key from o), c as (select m, key, label, count(distinct vec_id) as n from k group by all),
q as (select distinct word, m, key from k), e as (select word, label, sum(n) as near from q join c using (m, key) group by all), sizes as (select label, count(*) as size from v group by 1),
g as (select word, sizes.label, 2 * coalesce(near, 0) - {len(MASKS)} * size as d from (select distinct word from o) cross join sizes left join e using (word, label)), p as (select word, (sum(abs(d)) - abs(max(d)) - abs(min(d)) + max(d) - min(d))::bigint as power from g group by 1)"""


@query(f"with {POWER} select word, power from p")
def h_word_powers(spark, d):
    return shapelet_search.word_powers(shapelet_search.window_words(vectors(spark, d), "vec_id", "s", "label", 16, 4), MASKS, 4)[1]


@query(f"with {POWER} select word, label as class, near::bigint as near from e")
def h_collisions(spark, d):
    return shapelet_search.word_powers(shapelet_search.window_words(vectors(spark, d), "vec_id", "s", "label", 16, 4), MASKS, 4)[0]


@query()
def h_hashed_search(spark, d):
    best = shapelet_search.hashed_search(vectors(spark, d), "vec_id", "s", "label", [16, 24], 10)
    return r6(symbols.shapelet_table(spark, best).select("series_id", "start", "quality"))


@query(ORACLE_SQL["d_knn_join"])
def d_pivot_knn(spark, d):
    x = vectors(spark, d)
    return r6(pivots.pivot_knn(x, x, 3, "vec_id", "s", "label")[0].select("query", "neighbour", "distance", "rank"))


# Brands by mean price, size and number of parts; the nearest two clusters merge, one pair a step.
_BRANDS = "f as (select substr(p_brand, 7)::int as id, [avg(p_retailprice) / 10, avg(p_size), count(*)::double] as x from part group by 1), p as (select a.id as x, b.id as y, sqrt(list_sum(list_transform([1, 2, 3], lambda i: power(a.x[i] - b.x[i], 2)))) as d from f a, f b where a.id <> b.id)"
_TREE = """t(step, id, g, h, other, size) as (select 0, id, id, null::double, null::int, null::bigint from f union all
select t.step + 1, t.id, case when t.g = m.m.h then m.m.g else t.g end, m.m.d, m.m.h, m.m.n from t, (select arg_min({{'g': g, 'h': h, 'd': d, 'n': n}}, (round(d, 8), g, h)) as m from (select a.g, b.g as h, {d} as d, count(distinct a.id) + count(distinct b.id) as n from t a join t b on a.g < b.g join p on p.x = a.id and p.y = b.id group by all) having count(*) > 0) m)
select g as x, other as y, round(any_value(h), 6) as height, any_value(size) as size from t where step > 0 and g in (select g from t u where u.step = t.step - 1 and u.g = t.g) and exists (select 1 from t u where u.step = t.step - 1 and u.id = t.id and u.g = t.other) group by step, g, other"""


def _brand_tree(spark, d, link):
    f = read(spark, d, "part").groupBy(F.substring("p_brand", 7, 10).cast("int").alias("id")).agg(F.array(F.avg("p_retailprice") / 10, F.avg("p_size"), F.count("*").cast("double")).alias("x"))
    return r6(linkage.agglomerate(linkage.pair_distances(f, "id", "x", link), link))


@query(f"with recursive {_BRANDS}, {_TREE.format(d='max(p.d)')}")
def k_complete_link(spark, d):
    return _brand_tree(spark, d, "complete")


@query(f"with recursive {_BRANDS}, {_TREE.format(d='avg(p.d)')}")
def k_average_link(spark, d):
    return _brand_tree(spark, d, "average")


@query()
def k_ward_link(spark, d):
    return _brand_tree(spark, d, "ward")


@query()
def k_information(spark, d):
    terms = text.term_counts(read(spark, d, "documents"), "doc_id", text.tokens(F.lower("text"))).select(F.col("doc_id").alias("doc"), F.col("term").alias("word"), "n")
    return category_clusters.information_clusters(terms, 4, sweeps=3, parts=2)[0]


@query()
def k_item_profit(spark, d):
    x = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority", F.quarter("o_orderdate").cast("string")).alias("items"))
    return category_clusters.item_clusters(x, 2.6)


@query()
def i_rotation_forest(spark, d):
    x = vectors(spark, d)
    return rotation.RotationForest(trees=5).fit(x, "vec_id", "s", "label").predict(x, ["vec_id", "label"], "s").select("vec_id", "label", "predicted")


# Warping of the means of 16 segments; the recursion carries the last row of the cost table.
@query("""with recursive v as (select vec_id, label, list_transform(range(16), lambda i: list_avg(embedding[4 * i + 1 : 4 * i + 4]::double[])) as s from embeddings), p as (select a.vec_id as query, b.vec_id as y, a.s as a, b.s as b from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select query, y, a, b, 0 as i, list_transform(range(17), lambda j: case when j = 0 then 0.0::double else 1e300::double end) as row from p union all
select query, y, a, b, i + 1, list_reduce(list_transform(range(1, 17), lambda j: [power(a[i + 1] - b[j], 2) + least(row[j], row[j + 1]), power(a[i + 1] - b[j], 2)]), lambda acc, e: list_append(acc, least(e[1], least(1e300, acc[len(acc)] + e[2]))), [1e300::double]) from r where i < 16),
n as (select query, y, row[17] as d, row_number() over (partition by query order by row[17], y) as k from r where i = 16) select query, y as neighbour, round(d, 6) as distance from n where k = 1""")
def d_piecewise_dtw(spark, d):
    x = vectors(spark, d).withColumn("s", series.paa(F.col("s"), 16, 64))
    return r6(distances.nearest(x.where("vec_id % 100 = 0"), x, "vec_id", "s", "label", "dtw").select("query", "neighbour", "distance"))


@query()
def c_proportional_bins(spark, d):
    x = read(spark, d, "part")
    return x.select(columns.bin_of(F.col("p_retailprice"), columns.equal_frequency_cuts(x, "p_retailprice", None)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


# Two epochs of counts weighted by what the model before them does not give the class.
_EPOCH = """, w{j} as (select c.lang, ln(p.share) as prior, coalesce(sum(n), 0) + (select count(distinct word) from t) as norm, ln(coalesce(sum(n), 0) + (select count(distinct word) from t)) as l from (select lang from s) c join s p using (lang) left join n{i} n using (lang) group by c.lang, p.share),
z{j} as (select d.doc_id, w.lang, w.prior - d.len * w.l + coalesce(h.h, 0) as z from d, w{j} w left join (select doc_id, n.lang, sum(f * ln(n.n + 1)) as h from t join n{i} n using (word) group by all) h on h.doc_id = d.doc_id and h.lang = w.lang),
p{j} as (select doc_id, lang, exp(z - m) / sum(exp(z - m)) over (partition by doc_id) as p from (select *, max(z) over (partition by doc_id) as m from z{j})),
n{j} as (select word, lang, sum(n) as n from (select word, lang, n from n{i} union all select t.word, d.lang, sum(f * (1 - p.p)) from t join d using (doc_id) join p{j} p on p.doc_id = d.doc_id and p.lang = d.lang group by all) group by all)"""


@query(r"""with x as (select doc_id, lang, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \r\n\t.,;:''"()?!]+'), lambda x: x <> '')) as word from documents where lang is not null), t as (select doc_id, word, count(*)::double as f from x group by all),
d as (select doc_id, lang, coalesce(len, 0) as len from documents left join (select doc_id, sum(f) as len from t group by 1) using (doc_id) where lang is not null), s as (select lang, count(*) / sum(count(*)) over () as share from d group by 1), n0 as (select ''::varchar as word, ''::varchar as lang, 0.0::double as n where false)""" + _EPOCH.format(i=0, j=1) + _EPOCH.format(i=1, j=2) + " select word, lang as class, round(n, 5) as n from n2")
def l_discriminative_bayes(spark, d):
    docs = read(spark, d, "documents").where("lang is not null")
    terms = text.term_counts(docs, "doc_id", text.tokens(F.lower("text"))).select(F.col("doc_id").alias("doc"), F.col("term").alias("word"), F.col("n").alias("f"))
    model = refined.DiscriminativeBayes(2).fit(terms, docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("class")))
    return model.counts.select("word", "class", (F.round("n", 5) + 0.0).alias("n"))


@query()
def l_nested(spark, d):
    x = vectors(spark, d)
    return refined.NestedDichotomies("tree", maxDepth=3).fit(x, "s", "label").predict(x, ["vec_id", "label"], "s").select("vec_id", "label", "predicted")


@query()
def w_category_clusters(spark, d):
    state = streaming.TableState(spark, "cluster long, column string, value string, n double")
    names = ["o_orderstatus", "o_orderpriority"]
    streaming.feed(source(spark, d, "orders", dealt=True), streaming.category_sink(names, state))
    return streaming.category_clusters(read(spark, d, "orders").select("o_orderkey", *names), names, state.before()).select("o_orderkey", "cluster")


@query()
def d_string_kernel(spark, d):
    types = read(spark, d, "part").select("p_type").distinct()
    both = distances.all_pairs(types.select(F.col("p_type").alias("x")), types.select(F.col("p_type").alias("y"))).where("x <= y")
    return r6(both.select("x", "y", string_kernels.subsequence_kernel(F.lower("x"), F.lower("y"), 3, 0.5, True).alias("kernel")))


@query()
def b_descriptor_words(spark, d):
    x = vectors(spark, d)
    return r6(descriptors.DescriptorWords(16, dense=True).fit(x, "s").transform(x, "vec_id", "s", "label"))


def _pattern_sql(width: int, length: int, alphabet: int) -> str:
    """SQL of one setting: bags of words, squared distances of all pairs, leave-one-out accuracy."""
    part, w = width // length, f"s[i + 1 : i + {width}]"
    letter = "case " + " ".join(f"when list_avg(z[{part} * k + 1 : {part} * k + {part}]) > {b} then '{'abcdef'[n + 1]}'" for n, b in sorted(enumerate(series.BREAK_POINTS[alphabet]), reverse=True)) + " else 'a' end"
    return f"""(with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), w as (select vec_id, label, unnest(range({65 - width})) as i, s from v), z as (select vec_id, label, i, list_transform({w}, lambda x: (x - list_avg({w})) / list_stddev_pop({w})) as z from w),
l as (select vec_id, i, list_aggregate(list_transform(range({length}), lambda k: {letter}), 'string_agg', '') as word from z), b as (select vec_id, word, count(*) as n from (select *, lag(word) over (partition by vec_id order by i) as before from l) where before is null or before <> word group by all),
q as (select vec_id, sum(n * n) as q from b group by 1), d as (select a.vec_id as a, b.vec_id as b, sum(a.n * b.n) as dot from b a join b on a.word = b.word group by all), p as (select x.vec_id as a, y.vec_id as b, x.q + y.q - 2 * coalesce(dot, 0) as d from q x cross join q y left join d on d.a = x.vec_id and d.b = y.vec_id where x.vec_id <> y.vec_id),
n as (select a, arg_min(b, (d, b)) as b from p group by 1) select {width}::int as width, {length}::int as length, {alphabet}::int as alphabet, round(avg((u.label = t.label)::int), 6) as accuracy from n join v u on u.vec_id = n.a join v t on t.vec_id = n.b)"""


PATTERN_GRID = [(16, 4, 4), (24, 4, 3), (32, 8, 2)]


@query(" union all ".join(_pattern_sql(*g) for g in PATTERN_GRID))
def b_pattern_grid(spark, d):
    return r6(symbols.pattern_grid(vectors(spark, d), "vec_id", "s", "label", PATTERN_GRID))


@query("""with e as (select event_id, ts, value, (user_id % 5)::int as label from events), h as (select * from e order by ts desc, event_id desc limit 300), n as (select q.event_id as query, q.label as actual, h.label, row_number() over (partition by q.event_id order by power(q.value - h.value, 2), h.event_id) as r from e q, h where q.event_id % 100 = 0 and q.event_id <> h.event_id),
v as (select query, actual, label, count(*) as n from n where r <= 3 group by all) select query, actual, arg_max(label, (n, -label)) as predicted from v group by all""")
def w_recent_neighbours(spark, d):
    state = streaming.TableState(spark, "event_id long, ts timestamp, x array<double>, label int")
    shaped = lambda e: e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.array("value").alias("x"), (F.col("user_id") % 5).cast("int").alias("label"))
    streaming.feed(shaped(source(spark, d, "events")), streaming.recent_sink(300, ["ts", "event_id"], state))
    return streaming.recent_neighbours(state.before(), shaped(read(spark, d, "events")).where("event_id % 100 = 0"), "event_id", "x", "label", 3)


@query()
def l_ordered(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.array(F.col("p_retailprice") / 1000, F.length("p_type").cast("double")).alias("x"), F.ceil(F.col("p_size") / 10).cast("int").alias("y"))
    return refined.OrderedClasses("tree", maxDepth=3).fit(x, "x", "y").predict(x, ["p_partkey", "y"], "x").select("p_partkey", "y", "predicted")
