"""Queries of further evaluation, ensemble, test and density operators, and SQL for model queries of the first catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, diagnostics, ensembles, evaluation, tests
from .catalog import ORACLE_SQL, PRED, VP, _modules, _predictions, _results, query, r6, read

KAPPA = "(sum((actual = predicted)::int) / count(*) - e) / (1 - e)"
SCORED = "c as (select count(*) as n, sum((actual = predicted)::int) as hit, (sum(actual) * sum(predicted) + sum(1 - actual) * sum(1 - predicted)) / power(count(*), 2) as e from r) select n, round(hit / n, 6) as accuracy, round(1 - hit / n, 6) as error, round((hit / n - e) / (1 - e), 6) as kappa from c"
SUMMED = "select item, actual, case when round(sum(w * (0.25 + 0.5 * predicted)), 12) > round(sum(w * (0.75 - 0.5 * predicted)), 12) then 1 else 0 end as predicted from p join w using (module) group by item, actual"

ORACLE_SQL["v_cawpe"] = f"with {VP}, w as (select module, power(avg((actual = predicted)::int), 4) as w from p group by 1), r as ({SUMMED}), {SCORED}"

ORACLE_SQL["v_naive_bayes"] = f"""with {VP}, k as (select t.class, module, predicted, sum((actual = t.class)::int) as n, count(*) as m from p, (values (0), (1)) t(class) group by all), q as (select t.class, avg((actual = t.class)::int) as prior from p, (values (0), (1)) t(class) group by 1),
l as (select item, actual, k.class, sum(ln((n + 1) / (m + 2))) - (count(*) - 1) * ln(any_value(prior)) as l from p join k using (module, predicted) join q on q.class = k.class group by all), r as (select item, actual, arg_max(class, (round(l, 12), -class)) as predicted from l group by all), {SCORED}"""

ORACLE_SQL["l_decision_stump"] = """with c as (select l_quantity as v, l_returnflag as c, count(*) as n from lineitem group by all), g as (select v, c, coalesce(n, 0) as n from (select distinct v from c) cross join (select distinct c from c) left join c using (v, c)),
b as (select v, sum(n) over (partition by c order by v) as b, sum(n) over (partition by c) as a from g), s as (select v, sum(b) as nb, sum(a) as na, sum(case when b > 0 then -b * log2(b) else 0 end) as hb, sum(case when a > b then -(a - b) * log2(a - b) else 0 end) as ha from b group by v),
e as (select v, (hb + nb * log2(nb) + ha + (na - nb) * log2(na - nb)) / na as e from s where na > nb) select v as threshold, round(e, 6) as entropy from e order by round(e, 12), v limit 1"""

ORACLE_SQL["l_gaussian_naive_bayes"] = """with m as (select l_returnflag as c, count(*) as k, avg(l_quantity) as m1, greatest(stddev_samp(l_quantity), 0.001) as s1, avg(l_discount) as m2, greatest(stddev_samp(l_discount), 0.001) as s2, avg(l_tax) as m3, greatest(stddev_samp(l_tax), 0.001) as s3 from lineitem group by 1),
s as (select item, l_returnflag as actual, c, k, ln(k) - power((l_quantity - m1) / s1, 2) / 2 - ln(s1) - power((l_discount - m2) / s2, 2) / 2 - ln(s2) - power((l_tax - m3) / s3, 2) / 2 - ln(s3) as s from (select *, row_number() over () as item from lineitem), m),
p as (select item, actual, arg_max(c, (s, k)) as predicted from s group by all) select actual, predicted, count(*) as n from p group by all"""

CDF = "case when z >= 0 then 1 - t else t end"
ORACLE_SQL["p_normality_power"] = f"""with m as (select avg(p_retailprice) as m, stddev_samp(p_retailprice) as s, count(*) as t from part), c as (select p_retailprice as x, count(*) as n from part group by 1), e as (select x, n, sum(n) over (order by x) as upto, (x - m.m) / m.s as z, m.t as total from c, m), u as (select *, 1 / (1 + 0.2316419 * abs(z)) as k from e),
f as (select *, exp(-z * z / 2) * 0.3989422804014327 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) as t from u), d as (select round(max(greatest(abs(upto / total - ({CDF})), abs((upto - n) / total - ({CDF})))), 6) as d from f),
g as (select -3 + i * 0.25 as power, power(corr(case when i = 12 then ln(p_retailprice) else (power(p_retailprice, -3 + i * 0.25) - 1) / (-3 + i * 0.25) end, p_size), 2) as r2 from part, range(25) t(i) group by i) select d, power::double as power, round(r2, 6) as r2 from g, d order by round(r2, 12) desc, power limit 1"""

# --- V ---------------------------------------------------------------------------------------------------------------


@query(f"""with {VP}, a as (select module, avg((actual = predicted)::int) as a, avg(actual) as s1, avg(case when actual = 1 then predicted end) as r1, avg(case when actual = 0 then 1 - predicted end) as r0,
sum((actual = 1 and predicted = 1)::int) as tp, sum((actual = 0 and predicted = 1)::int) as fp, sum((actual = 1 and predicted = 0)::int) as fn, sum((actual = 0 and predicted = 0)::int) as tn, avg(-log2(case when actual = predicted then case predicted when 1 then 0.75 else 0.75 end else 0.25 end)) as nll from p group by 1),
m as (select *, (tp * tn - fp * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) as mcc from a)
select module, 1.0::double as equal, round(a / sum(a) over (), 6) as share, round(greatest(a - 0.5, 0.01), 6) as over_chance, round(greatest(a - greatest(s1, 1 - s1), 0.01), 6) as over_largest, round((r0 + r1) / 2, 6) as balanced, round(1 - nll / sum(nll) over (), 6) as likelihood, round((mcc + 1) / 2, 6) as mcc from m""")
def v_weighting_schemes(spark, d):
    p = _modules(spark, d)
    out = None
    for scheme in ("equal", "share", "over_chance", "over_largest", "balanced", "likelihood", "mcc"):
        w = ensembles.module_weights(p, scheme).withColumnRenamed("weight", scheme)
        out = w if out is None else out.join(w, "module")
    return r6(out)


@query(f"""with {VP}, c as (select module, l as predicted, sum((actual = l and predicted = l)::int) as tp, sum((actual <> l and predicted = l)::int) as fp, sum((actual = l and predicted <> l)::int) as fn from p, (values (0), (1)) t(l) group by all)
select module, predicted, round(tp / (tp + fn), 6) as recall, round(tp / (tp + fp), 6) as precision, round(power(2 * tp / (2 * tp + fp + fn), 2), 6) as f from c""")
def v_class_weights(spark, d):
    p = _modules(spark, d)
    out = None
    for kind in ("recall", "precision", "f"):
        w = ensembles.class_weights(p, kind, 2.0).withColumnRenamed("weight", kind)
        out = w if out is None else out.join(w, ["module", "predicted"])
    return r6(out)


@query(f"""with {VP}, c as (select module, l as predicted, sum((actual = l and predicted = l)::int) / sum((actual = l)::int) as w from p, (values (0), (1)) t(l) group by all), v as (select item, actual, p.predicted, sum(w) as v from p join c using (module, predicted) group by all)
select predicted, actual, count(*) as n from (select item, actual, predicted, row_number() over (partition by item, actual order by round(v, 12) desc, predicted) as r from v) where r = 1 group by all""")
def v_recall_vote(spark, d):
    p = _modules(spark, d)
    return ensembles.majority_vote(p, ensembles.class_weights(p)).groupBy("predicted", "actual").agg(F.count("*").alias("n"))


def _voted(x: str) -> str:
    return f"""with {VP}, w as (select module, power(avg((actual = predicted)::int), 4) as w from p group by 1), v as (select item, actual, predicted, sum(w * ({x})) as v from p join w using (module) group by all)
select predicted, actual, count(*) as n from (select item, actual, predicted, row_number() over (partition by item, actual order by round(v, 12) desc, predicted) as r from v) where r = 1 group by all"""


@query(_voted("0.75"))
def v_confidence_vote(spark, d):
    p = _modules(spark, d)
    return ensembles.majority_vote(p, ensembles.module_weights(p), "confidence").groupBy("predicted", "actual").agg(F.count("*").alias("n"))


@query(_voted("0.25"))
def v_corrected_vote(spark, d):
    p = _modules(spark, d)
    return ensembles.majority_vote(p, ensembles.module_weights(p), "corrected").groupBy("predicted", "actual").agg(F.count("*").alias("n"))


@query(_voted("power(0.75, 2)"))
def v_powered_vote(spark, d):
    p = _modules(spark, d)
    return ensembles.majority_vote(p, ensembles.module_weights(p), "powered", power=2.0).groupBy("predicted", "actual").agg(F.count("*").alias("n"))


@query(f"with {VP}, w as (select distinct module, 1.0 as w from p), r as ({SUMMED}), {SCORED}")
def v_mean_confidence(spark, d):
    p = _modules(spark, d)
    return r6(evaluation.accuracy(ensembles.distribution_sum(p, ensembles.module_weights(p, "equal"))))


@query(f"with {VP}, w as (select module, avg((actual = predicted)::int) as w from p group by 1), r as ({SUMMED}), {SCORED}")
def v_accuracy_collective(spark, d):
    p = _modules(spark, d)
    return r6(evaluation.accuracy(ensembles.collective(p, p)))


@query(f"""with {VP}, g as (select *, module % 2 as source from p), w as (select source, module, avg((actual = predicted)::int) as w from g group by all), r as (select item, actual, case when round(sum(w * predicted), 12) > round(sum(w * (1 - predicted)), 12) then 1 else 0 end as predicted from g join w using (source, module) group by all), {SCORED}""")
def v_flat_collective(spark, d):
    p = _modules(spark, d)
    parts = {str(s): p.where(F.col("module") % 2 == s) for s in (0, 1)}
    return r6(evaluation.accuracy(ensembles.flat_collective(parts, parts)))


@query(f"""with {VP}, w as (select module, avg((actual = predicted)::int) as w from p group by 1), b as (select module from w order by w desc, module limit 1), r as (select actual, predicted from p join b using (module)), {SCORED}""")
def v_best_individual(spark, d):
    p = _modules(spark, d)
    return r6(evaluation.accuracy(ensembles.best_individual(p, p)))


@query(f"""with {VP}, c as (select module, l as class, sum((actual = l and predicted = l)::int) / sum((actual = l)::int) as w from p, (values (0), (1)) t(l) group by all), s as (select module, class, w / max(w) over (partition by class) as w from c), z as (select module, class, w / sum(w) over (partition by class) as w from s),
v as (select item, actual, p.predicted, sum(w) as v from p join z on z.module = p.module and z.class = p.predicted group by all) select predicted, actual, count(*) as n from (select item, actual, predicted, row_number() over (partition by item, actual order by round(v, 12) desc, predicted) as r from v) where r = 1 group by all""")
def v_support_vote(spark, d):
    p = _modules(spark, d)
    return ensembles.majority_vote(p, ensembles.support_weights(p)).groupBy("predicted", "actual").agg(F.count("*").alias("n"))


@query(f"""with recursive {VP}, c as (select module, item, actual, 0.75 - 0.5 * predicted as p0, 0.25 + 0.5 * predicted as p1 from p), m as (select distinct module from c),
s as (select 0 as r, []::int[] as chosen union all select r + 1, list_append(chosen, (select module from (select m.module, avg((case when round(v1, 9) > round(v0, 9) then 1 else 0 end = actual)::int) as acc from (select m.module, c.item, c.actual, sum(c.p0 * times) as v0, sum(c.p1 * times) as v1 from m, c, lateral (select len(list_filter(list_append(s.chosen, m.module), lambda x: x = c.module)) as times) where times > 0 group by all) m group by 1 order by acc desc, module limit 1))) from s where r < 3)
select unnest(range(1, 4))::int as place, unnest(chosen) as module from s where r = 3""")
def v_ensemble_selection(spark, d):
    p = _modules(spark, d)
    return spark.createDataFrame([(i, int(m)) for i, m in enumerate(ensembles.select_ensemble(p, 3), 1)], "place int, module int")


# --- E ---------------------------------------------------------------------------------------------------------------


@query(f"""with {PRED}, c as (select l as label, sum((actual = l and predicted = l)::int) as tp, sum((actual <> l and predicted = l)::int) as fp, sum((actual = l and predicted <> l)::int) as fn from p, (values (0), (1)) t(l) group by 1)
select round(avg(tp / (tp + fn)), 6) as balanced_accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 6) as macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(sum((tp + fn) * 2 * tp / (2 * tp + fp + fn)) / sum(tp + fn), 6) as weighted_f1 from c""")
def e_averaged(spark, d):
    return r6(evaluation.averaged(evaluation.per_class(_predictions(spark, d))))


@query(f"with {PRED}, m as (select round(probs[actual + 1] - probs[2 - actual], 9) as margin, count(*) as n from p group by 1) select round(margin, 6) as margin, round(sum(n) over (order by margin) / sum(n) over (), 6) as share from m")
def e_margin_curve(spark, d):
    p = _predictions(spark, d).withColumn("probs", F.transform("probs", lambda x: F.round(x, 10)))
    m = evaluation.margin_curve(p, 9)
    return r6(m)


@query(f"""with {PRED}, q as (select actual, count(*) / sum(count(*)) over () as share from p group by 1) select round(avg(case when probs[actual + 1] >= share then log2(probs[actual + 1]) - log2(share) else log2(1 - share) - log2(1 - probs[actual + 1]) end), 6) as information_score from p join q using (actual)""")
def e_information(spark, d):
    p = _predictions(spark, d)
    prior = p.groupBy("actual").agg(F.count("*").alias("n"))
    n = prior.agg(F.sum("n").alias("t"))
    return r6(evaluation.information_score(p, prior.join(F.broadcast(n)).select("actual", (F.col("n") / F.col("t")).alias("share"))))


@query(f"with {PRED} select round(avg(-log2(share)), 6) as prior_entropy, round(avg(-log2(probs[actual + 1])), 6) as scheme_entropy, round(avg(-log2(share)) - avg(-log2(probs[actual + 1])), 6) as gain from p join (select actual, count(*) / sum(count(*)) over () as share from p group by 1) using (actual)")
def e_entropy_gain(spark, d):
    return r6(evaluation.entropy_gain(_predictions(spark, d)))


@query(f"with {PRED}, x as (select sum(case when actual = 1 and predicted = 0 then 5.0 when actual = 0 and predicted = 1 then 1.0 else 0.0 end) as t, count(*) as n from p) select round(t, 6) as total_cost, round(t / n, 6) as mean_cost from x")
def e_cost(spark, d):
    m = spark.createDataFrame([(1, 0, 5.0), (0, 1, 1.0)], "actual int, predicted int, cost double")
    return r6(evaluation.cost(_predictions(spark, d), m))


@query(f"with {PRED} select round(avg(case when probs[actual + 1] >= 0.2 then 1 else 0 end), 6) as coverage, round(avg(((probs[1] >= 0.2)::int + (probs[2] >= 0.2)::int) / 2), 6) as region_size from p")
def e_coverage(spark, d):
    return r6(evaluation.region_coverage(_predictions(spark, d), 0.2))


@query(f"""with {VP}, s as (select item, actual, predicted, count(*) as n from p group by all), q as (select item, actual, sum(power(n / t, 2)) as q2, sum(case when actual = predicted then n / t else 0 end) as hit from (select *, sum(n) over (partition by item) as t from s) group by all)
select round(avg(1 - hit), 6) as error, round(avg((1 - 2 * hit + q2) / 2), 6) as bias2, round(avg((1 - q2) / 2), 6) as variance from q""")
def e_bias_variance(spark, d):
    return r6(evaluation.bias_variance(_modules(spark, d)))


@query("with r as (select l_linenumber as method, l_returnflag as dataset, l_linestatus as fold, avg(l_discount) as accuracy from lineitem group by all) select method, dataset, count(*) as folds, round(avg(accuracy), 6) as mean, round(stddev_samp(accuracy), 6) as sd from r group by all")
def e_collate(spark, d):
    x = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("method"), F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("fold")).agg(F.avg("l_discount").alias("accuracy"))
    return r6(evaluation.collate(x, "accuracy"))


PAIRED = "r as (select l_linenumber as method, l_returnflag || l_linestatus as dataset, avg(l_discount) as mean from lineitem group by all), d as (select a.method, b.method as other, a.mean - b.mean as d from r a join r b on a.dataset = b.dataset and a.method < b.method)"


@query(f"""with {PAIRED}, k as (select method, other, d, rank() over (partition by method, other order by abs(d)) + (count(*) over (partition by method, other, abs(d)) - 1) / 2 as r from (select method, other, round(d, 9) as d from d) where d <> 0), w as (select method, other, greatest(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w from k group by all)
select d.method, d.other, count(*) as datasets, round(avg(d), 6) as mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as t, sum((d > 0)::int)::bigint as above, round(any_value(w), 6) as w from d left join w using (method, other) group by d.method, d.other""")
def e_pairwise_tests(spark, d):
    # means as they are: rounded ones make differences that lie halfway between two sixth digits
    means = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("dataset")).agg(F.avg("l_discount").alias("mean"))
    x = evaluation.pairwise_tests(means)
    return x.select("method", "other", "datasets", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 4).alias("t"), "above", F.round("w", 6).alias("w"))


# Every set of methods none of whose pairs has |t| over the point of 0.9 / 21, and that no such set holds.
@query(f"""with {PAIRED}, t as (select method, other, abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) > 2.0250995525245683 as differ from d group by all), m as (select unnest(range(1, 128)) as m),
bad as (select distinct m from m, t where differ and m >> (method - 1) & 1 = 1 and m >> (other - 1) & 1 = 1), ok as (select m from m where m not in (select m from bad)), top as (select m from ok where not exists (select 1 from ok o where o.m <> ok.m and o.m & ok.m = ok.m)),
l as (select list_filter(range(1, 8), lambda i: m >> (i - 1) & 1 = 1)::int[] as methods from top) select row_number() over (order by len(methods) desc, methods)::int as clique, methods from l""")
def e_cliques(spark, d):
    means = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("dataset")).agg(F.avg("l_discount").alias("mean"))
    return evaluation.cliques(evaluation.pairwise_tests(means), 0.9, "p_t")


@query("select l_linenumber as method, l_returnflag as dataset, round(avg(l_discount) filter (where l_linestatus = 'O') - avg(l_discount) filter (where l_linestatus = 'F'), 6) as difference from lineitem group by all having difference is not null")
def e_train_test_difference(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), F.col("l_returnflag").alias("dataset"), F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("part"), F.col("l_discount").alias("accuracy"))
    return r6(evaluation.train_test_difference(x, "accuracy"))


@query("with r as (select l_linenumber as method, l_returnflag || l_linestatus as dataset, round(avg(l_discount), 6) as mean from lineitem group by all), g as (select method, dataset, substr(dataset, 1, 1) as grouping, mean, rank() over (partition by dataset order by mean desc) = 1 as best from r) select grouping, method, round(avg(mean), 6) as mean, sum(best::int)::bigint as wins from g group by all")
def e_grouped(spark, d):
    groups = _results(spark, d).select("dataset", F.substring("dataset", 1, 1).alias("grouping")).distinct()
    return r6(evaluation.by_grouping(_results(spark, d), groups))


@query("select count(*) as n_rows, 64::int as shortest, 64::int as longest, count(distinct label) as classes from embeddings")
def e_dataset_statistics(spark, d):
    return evaluation.dataset_statistics(read(spark, d, "embeddings"), "label", "embedding")


@query("with r as (select l_linenumber as method, l_returnflag || l_linestatus as dataset, count(*) as folds, avg(l_discount) as m, var_samp(l_discount) as v from lineitem group by all), p as (select a.method, b.method as other, a.m - b.m as d, (a.m - b.m) / sqrt(a.v / a.folds + b.v / b.folds) as t from r a join r b on a.dataset = b.dataset and a.method <> b.method) select method, other, sum((t > 1.959964)::int)::bigint as wins, sum((abs(t) <= 1.959964)::int)::bigint as draws, sum((t < -1.959964)::int)::bigint as losses from p group by all")
def e_significant_wins(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.col("l_discount").alias("accuracy"))
    return evaluation.significant_wins(x, "accuracy", 1.959964)


# --- P, Q ------------------------------------------------------------------------------------------------------------


@query("with s as (select count(*) as n, sum((c_acctbal > 4500)::int) + sum((c_acctbal = 4500)::int) / 2 as a, sum((c_acctbal < 4500)::int) + sum((c_acctbal = 4500)::int) / 2 as b from customer) select n, round(a, 6) as above, round(b, 6) as below, round((greatest(a, b) - n / 2) / sqrt(n / 4), 6) as z from s")
def p_sign(spark, d):
    return r6(tests.sign_test(read(spark, d, "customer"), "c_acctbal", 4500).drop("p"))


RANKS = "r as (select *, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2 as r from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))"


@query(f"with {RANKS}, s as (select sum((c_mktsegment = 'BUILDING')::int) as n, sum((c_mktsegment <> 'BUILDING')::int) as m, sum(case when c_mktsegment = 'BUILDING' then r else 0 end) as w from r) select round(w, 6) as rank_sum, round((w - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) as z from s")
def p_rank_sum(spark, d):
    return r6(tests.mann_whitney(read(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").select(F.col("rank_sum").cast("double").alias("rank_sum"), F.col("z").cast("double").alias("z")))


@query("""with d as (select user_id, ts, event_id, value - 50 as v from events where value <> 50), n as (select user_id, v, sign(v) <> lag(sign(v)) over (partition by user_id order by ts, event_id) as c from d)
select user_id, sum(coalesce(c, true)::int)::bigint as runs, sum((v > 0)::int)::bigint as n1, sum((v < 0)::int)::bigint as n2, round(2 * sum((v > 0)::int) * sum((v < 0)::int) / count(*) + 1, 6) as expected from n group by 1""")
def p_runs(spark, d):
    return r6(tests.runs_test(read(spark, d, "events").withColumn("v", F.col("value") - 50), ["ts", "event_id"], "v", ["user_id"]))


@query("select p_partkey, round(exp(p_retailprice / 1000), 6) as up, round(ln(p_retailprice), 6) as log, round(1 / p_retailprice, 9) as reciprocal, round(p_retailprice, 6) as back from part")
def p_response_transforms(spark, d):
    y = F.col("p_retailprice")
    back = tests.inverse_response(tests.response(y, "log"), "log")
    return read(spark, d, "part").select("p_partkey", F.round(tests.response(y / 1000, "exp"), 6).alias("up"), F.round(tests.response(y, "log"), 6).alias("log"), F.round(tests.response(y, "reciprocal"), 9).alias("reciprocal"), F.round(back, 6).alias("back"))


LINE = "f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem), e as (select a + b * l_quantity as fitted, l_extendedprice - a - b * l_quantity as e from lineitem, f)"


@query(f"with {LINE} select round(corr(abs(e), fitted), 5) as spread, round(sum(e * e * (fitted - m)) / (sum(e * e) / count(*)) / sum(power(fitted - m, 2)), 6) as anscombe from e, (select avg(fitted) as m from e)")
def p_residuals(spark, d):
    x = diagnostics.residual_tests(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return x.select(F.round("spread", 5).alias("spread"), F.round("anscombe", 6).alias("anscombe"))


@query("""with g as (select corr(l_quantity, l_extendedprice) as r1, corr(l_discount, l_extendedprice) as r2, corr(l_tax, l_extendedprice) as r3 from lineitem) select unnest(['l_quantity', 'l_discount', 'l_tax']) as first, round(unnest([r1 * r1, r2 * r2, r3 * r3]), 6) as r2 from g order by unnest([r1 * r1, r2 * r2, r3 * r3]) desc limit 1""")
def p_stepwise(spark, d):
    steps = tests.stepwise(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1e-12)
    return spark.createDataFrame([(s["column"], round(s["r2"], 6)) for s in steps[:1]], "first string, r2 double")


@query("with m as (select avg(l_quantity) as a, avg(l_discount) as b, var_samp(l_quantity) as va, var_samp(l_discount) as vb, covar_samp(l_quantity, l_discount) as c from lineitem) select l_orderkey, l_linenumber, round((power(l_quantity - a, 2) * vb - 2 * c * (l_quantity - a) * (l_discount - b) + power(l_discount - b, 2) * va) / (va * vb - c * c), 5) as distance from lineitem, m")
def q_mahalanobis(spark, d):
    x = density.mahalanobis(read(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return x.select("l_orderkey", "l_linenumber", (F.round("distance", 5) + 0.0).alias("distance"))


@query("select 'l_discount' as a, 'l_discount' as b, round(var_samp(l_discount), 9) as cov from lineitem union all select 'l_discount', 'l_tax', round(covar_samp(l_discount, l_tax), 9) from lineitem union all select 'l_tax', 'l_tax', round(var_samp(l_tax), 9) from lineitem")
def q_covariance(spark, d):
    x = density.covariance(read(spark, d, "lineitem"), ["l_discount", "l_tax"])
    return x.select("a", "b", (F.round("cov", 9) + 0.0).alias("cov"))


@query("with r as (select l_returnflag, avg(l_linenumber) as rate from lineitem group by 1), k as (select l_returnflag, k::int as k from r, range(6) t(k)) select l_returnflag, k, round(rate, 6) as rate, round(k * ln(rate) - rate - case k when 0 then 0 when 1 then 0 when 2 then ln(2) when 3 then ln(6) when 4 then ln(24) else ln(120) end, 6) as log_mass from k join r using (l_returnflag)")
def q_poisson(spark, d):
    r = density.poisson(read(spark, d, "lineitem"), "l_linenumber", ["l_returnflag"])
    return r6(r.select("l_returnflag", F.explode(F.expr("sequence(0, 5)")).alias("k"), "rate").select("l_returnflag", "k", "rate", density.poisson_log_mass(F.col("k"), F.col("rate")).alias("log_mass")))


@query("""with b as (select l_linenumber as bucket, l_extendedprice - 1500 * l_quantity as r from lineitem) select bucket, quantile_cont(r, [0.1, 0.9])[1] as a, quantile_cont(r, [0.1, 0.9])[2] as b from b group by 1""")
def q_intervals(spark, d):
    x = read(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") * 1500).alias("predicted"), "l_extendedprice")
    return density.residual_intervals(x, "l_extendedprice", "predicted", "l_linenumber", 0.8).select(F.col("l_linenumber").alias("bucket"), F.col("low").alias("a"), F.col("high").alias("b"))
