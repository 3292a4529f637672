"""Queries of the symbolic, interval, shapelet, mining and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import ensembles, evaluation, mining, models, symbols, text
from .catalog import PRED, VP, _modules, _predictions, query, r6, read, vectors


@query()
def b_bag_of_patterns(spark, d):
    return symbols.bag_of_patterns(vectors(spark, d), "vec_id", "s", 16, 4, label="label")


@query()
def b_sax_vector_space(spark, d):
    bags = symbols.bag_of_patterns(vectors(spark, d), "vec_id", "s", 16, 4, label="label")
    p = symbols.vsm_predict(bags, symbols.sax_vector_space(bags, "label"), "vec_id", "label")
    return p.groupBy("predicted").agg(F.count("*").alias("n"))


@query()
def b_sfa_words(spark, d):
    c = symbols.sfa_coefficients(vectors(spark, d), "vec_id", "s", 16, 4)
    return symbols.sfa_words(c, "vec_id", 16).groupBy("word").agg(F.count("*").alias("n"))


V = "v as (select vec_id, list_transform(embedding, lambda x: x::double) as s from embeddings)"


@query(f"""with {V}, i as (select vec_id, s[1:16] as a, s[21:32] as b from v), f as (select vec_id, list_avg(a) as m1, list_var_pop(a) as v1, list_sum(list_transform(range(0, 16), lambda i: (i - 7.5) * a[i + 1])) / 340 as s1, list_avg(b) as m2, list_var_pop(b) as v2, list_sum(list_transform(range(0, 12), lambda i: (i - 5.5) * b[i + 1])) / 143 as s2 from i)
select vec_id, list_transform([m1, v1, s1, m2, v2, s2], lambda x: round(x, 6)) as features from f""")
def i_interval_features(spark, d):
    return r6(symbols.interval_features(vectors(spark, d), ["vec_id"], "s", [(0, 16), (20, 12)]))


@query()
def i_interval_forest(spark, d):
    x = symbols.interval_features(vectors(spark, d), ["vec_id", "label"], "s", symbols.random_intervals(64, 8))
    return evaluation.accuracy(models.cross_validate("forest", x, "label", "features", "vec_id", 3, numTrees=20, seed=1))


@query()
def h_shapelet_transform(spark, d):
    x = vectors(spark, d)
    best = symbols.best_shapelets(x, "vec_id", "s", "label", [12, 20], 10)
    return r6(symbols.shapelet_transform(x, ["vec_id", "label"], "s", [b["content"] for b in best]))


ITEMS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("""with t as (select 'l_returnflag=' || l_returnflag as a, 'l_linestatus=' || l_linestatus as b, 'l_linenumber=' || l_linenumber as c from lineitem), s as (select list_sort(x) as items from t, lateral (select unnest([[a], [b], [c], [a, b], [a, c], [b, c], [a, b, c]]) as x))
select items, count(*) as freq from s group by 1 having count(*) >= ceil(0.05 * (select count(*) from lineitem))""")
def m_frequent_items(spark, d):
    return mining.frequent_items(mining.to_items(read(spark, d, "lineitem"), ITEMS), 0.05)


@query()
def m_rules(spark, d):
    x = read(spark, d, "lineitem")
    return r6(mining.rules(mining.frequent_items(mining.to_items(x, ITEMS), 0.02), x.count(), 0.3))


@query()
def m_sequences(spark, d):
    return mining.sequences(read(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], "event_type", 0.02)


@query()
def k_clusters(spark, d):
    x = vectors(spark, d)
    return models.cluster_classes(models.k_means(x, "s", 10), "cluster", "label")


@query()
def k_farthest_first(spark, d):
    return models.farthest_first(vectors(spark, d), "vec_id", "s", 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def l_logistic(spark, d):
    return evaluation.accuracy(models.cross_validate("logistic", vectors(spark, d), "label", "s", "vec_id", 3, maxIter=20))


@query()
def l_gaussian_naive_bayes(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_quantity", "l_discount", "l_tax")
    p = models.gaussian_naive_bayes(x, x, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "id")
    return evaluation.confusion(p)


@query("select l_returnflag, l_linenumber, arg_max(l_linestatus, (n, l_linestatus)) as predicted from (select l_returnflag, l_linenumber, l_linestatus, count(*) as n from lineitem group by all) group by all")
def l_decision_table(spark, d):
    return models.decision_table(read(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus")


@query("select o_orderstatus, min(o_totalprice) as o_totalprice_low, max(o_totalprice) as o_totalprice_high from orders group by 1")
def l_hyper_pipes(spark, d):
    return models.hyper_pipes(read(spark, d, "orders"), "o_orderstatus", ["o_totalprice"])


@query()
def l_decision_stump(spark, d):
    return r6(models.decision_stump(read(spark, d, "lineitem"), "l_quantity", "l_returnflag"))


# Each vector as four channels of 16 points, against the vector that follows it.
CHANNELS = "c as (select vec_id, list_transform([0, 1, 2, 3], lambda k: list_transform(embedding[16 * k + 1 : 16 * k + 16], lambda x: x::double)) as ch from embeddings)"


@query(f"""with {CHANNELS}, p as (select a.vec_id, list_transform(range(1, 17), lambda t: list_sum(list_transform([1, 2, 3, 4], lambda k: power(a.ch[k][t] - b.ch[k][t], 2)))) as q from c a join c b on b.vec_id = a.vec_id + 1)
select vec_id, round(sqrt(list_sum(q)), 6) as dependent, round(list_sum(list_transform(q, lambda x: sqrt(x))), 6) as independent from p""")
def d_multivariate_euclidean(spark, d):
    x = vectors(spark, d).select("vec_id", F.array(*(F.slice("s", 16 * k + 1, 16) for k in range(4))).alias("ch"))
    after = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("ch").alias("after"))
    both = [arrays.multivariate_euclidean(F.col("ch"), F.col("after"), kind).alias(name) for name, kind in (("dependent", True), ("independent", False))]
    return r6(x.join(after, "vec_id").select("vec_id", *both))


@query(f"""with {VP}, q as (select *, item % 5 as fold from p), a as (select fold, module, avg((actual = predicted)::int) as acc from q where item % 2 = 0 group by all),
b as (select fold, module from (select *, row_number() over (partition by fold order by acc desc, module) as r from a) where r = 1)
select fold, module, actual, predicted, count(*) as n from q join b using (fold, module) where item % 2 = 1 group by all""")
def v_choose_stored(spark, d):
    p = _modules(spark, d).withColumn("fold", F.col("item") % 5)
    best = ensembles.choose_stored(p.where("item % 2 = 0"), p.where("item % 2 = 1"), ["fold"])
    return best.groupBy("fold", "module", "actual", "predicted").agg(F.count("*").alias("n"))


@query(f"with {PRED} select item, actual, predicted, actual <> predicted as error, round(probs[predicted + 1], 6) as confidence from p")
def e_prediction_rows(spark, d):
    return r6(evaluation.prediction_rows(_predictions(spark, d)))


@query(f"""with {PRED}, s as (select score, sum(actual) as p, sum(1 - actual) as n from p group by 1), c as (select score, sum(p) over w / sum(p) over () as recall, sum(p) over w / (sum(p) over w + sum(n) over w) as precision from s window w as (order by score desc)),
a as (select (recall - lag(recall, 1, 0.0) over w) * (precision + coalesce(lag(precision) over w, precision)) / 2 as a from c window w as (order by score desc))
select round(sum(a), 6) as auprc from a""")
def e_auprc(spark, d):
    return r6(evaluation.auprc(_predictions(spark, d)))


STOP = ["the", "a", "an", "and", "or", "of", "in", "to", "is", "for"]
SPLIT = r"""list_filter(string_split_regex(coalesce(text, ''), '[ \r\n\t.,;:''"()?!]+'), lambda x: x <> '')"""


@query(f"select doc_id, len(list_filter({SPLIT}, lambda x: lower(x) not in {tuple(STOP)}))::int as n from documents")
def n_stop_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.remove_stop_words(text.tokens(F.col("text")), STOP)).alias("n"))


@query(f"with w as (select doc_id, unnest({SPLIT}) as term from documents) select term, count(*) as n, count(distinct doc_id) as docs from w where starts_with(term, 're') group by 1")
def n_prefix_lookup(spark, d):
    terms = text.with_prefix(text.term_counts(read(spark, d, "documents"), "doc_id", text.tokens(F.col("text"))), "re")
    return terms.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("""with t as (select unnest(['l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus, 'l_linenumber=' || l_linenumber]) as x, row_number() over () as r from lineitem), n as (select count(*)::double as n from lineitem),
f as (select x, count(*) / any_value(n) as s from t, n group by 1 having count(*) >= ceil(0.02 * any_value(n))), p as (select a.x as a, b.x as c, count(*) / any_value(n) as s from t a join t b on a.r = b.r and a.x <> b.x, n group by 1, 2 having count(*) >= ceil(0.02 * any_value(n)))
select p.a as antecedent, p.c as consequent, round(n * power(p.s - fa.s * fc.s, 2) / (fa.s * fc.s * (1 - fa.s) * (1 - fc.s)), 4) as chi_squared from p join f fa on fa.x = p.a join f fc on fc.x = p.c, n where p.s / fa.s >= 0.3""")
def m_rule_significance(spark, d):
    x = read(spark, d, "lineitem")
    n = x.count()
    tested = mining.rule_significance(mining.rules(mining.frequent_items(mining.to_items(x, ITEMS), 0.02), n, 0.3), n)
    single = tested.where("size(antecedent) = 1 and size(consequent) = 1")
    return single.select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.round("chi_squared", 4).alias("chi_squared"))
