"""Queries of attribute selection, mining, clustering and count-table learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import columns, evaluation, graphs, mining, models, scoring, series, text
from .catalog import CELLS, ORACLE_SQL, PRED, ZN, V, _flags, _predictions, query, r6, read, vectors

# --- A ---------------------------------------------------------------------------------------------------------------


@query(f"""with {CELLS}, x as (select attribute, sum(power(coalesce(n, 0) - nv * nc / t, 2) / (nv * nc / t)) as x, any_value(t) as t, count(distinct value) as kv, count(distinct label) as kc, sum(power(coalesce(n, 0), 2) / nv / t) as a from v join k using (attribute) join t using (attribute) left join c using (attribute, value, label) group by 1),
b as (select attribute, sum(power(nc / t, 2)) as b from k join t using (attribute) group by 1) select attribute, round(sqrt(x / (t * (least(kv, kc) - 1))), 6) as cramers_v, round((a - b) / (1 - b), 6) as tau from x join b using (attribute)""")
def a_cramers_tau(spark, d):
    return r6(scoring.chi_squared(_flags(spark, d)).select("attribute", "cramers_v", "tau"))


SU = """y as (select l_returnflag as r, l_linenumber::varchar as n, l_quantity::int::varchar as q, l_linestatus as s from lineitem),
h as (select 'r' as k, -sum(p * log2(p)) as h from (select count(*) / (select count(*) from y) as p from y group by r) union all select 'n', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by n) union all select 'q', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by q) union all select 's', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by s)),
j as (select 'r' as a, 's' as b, -sum(p * log2(p)) as h from (select count(*) / (select count(*) from y) as p from y group by r, s) union all select 'n', 's', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by n, s) union all select 'q', 's', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by q, s)
union all select 'n', 'r', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by n, r) union all select 'n', 'q', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by n, q) union all select 'q', 'r', -sum(p * log2(p)) from (select count(*) / (select count(*) from y) as p from y group by q, r)),
u as (select a, b, 2 * (x.h + z.h - j.h) / (x.h + z.h) as su from j join h x on x.k = a join h z on z.k = b)"""


def _merits(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("r"), F.col("l_linenumber").cast("string").alias("n"), F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_linestatus").alias("s"))
    own = {r.attribute: r.symmetrical_uncertainty for r in scoring.entropy_scores(scoring.contingency(x, ["n", "q", "r"], "s")).collect()}
    pairs = {(r.a, r.b): r.su for r in scoring.pair_uncertainty(x, ["n", "q", "r"]).collect()}
    return lambda s: scoring.subset_merit(s, own, pairs)


MERITS = f"""with {SU}, c as (select * from (values (['n']), (['q']), (['r']), (['n', 'q']), (['n', 'r']), (['q', 'r']), (['n', 'q', 'r'])) t(c)),
m as (select c, (select sum(su) from u where b = 's' and list_contains(c, a)) / sqrt(len(c) + 2 * coalesce((select sum(su) from u where b <> 's' and list_contains(c, a) and list_contains(c, b)), 0)) as merit from c)"""


@query(f"{MERITS} select array_to_string(c, ',') as subset, round(merit, 6) as merit from m")
def a_subset_merits(spark, d):
    merit = _merits(spark, d)
    return spark.createDataFrame([(",".join(s), round(merit(s), 6)) for s in scoring.all_subsets(["n", "q", "r"])], "subset string, merit double")


@query(f"{MERITS} select unnest(['exhaustive', 'random', 'backward', 'genetic', 'greedy']) as method, round(max(merit), 6) as merit from m")
def a_subset_searches(spark, d):
    merit, names = _merits(spark, d), ["n", "q", "r"]
    found = [(m, scoring.search_subsets(names, merit, m)) for m in ("exhaustive", "random", "backward", "genetic")]
    found.append(("greedy", scoring.greedy_subset(names, merit)))
    return spark.createDataFrame([(m, round(merit(s), 6)) for m, s in found], "method string, merit double")


@query("""with y as (select l_returnflag as r, l_linenumber as n, l_quantity as q, l_linestatus as s from lineitem), p as (select 0 as subset, r || '' as k, s from y union all select 1, n::varchar, s from y union all select 2, r || '/' || n, s from y union all select 3, n || '/' || q, s from y), c as (select subset, k, s, count(*) as n from p group by all), m as (select subset, k, max(n) as m, sum(n) as n from c group by all) select subset::int as subset, round(sum(m) / sum(n), 6) as accuracy from m group by 1""")
def a_wrapper(spark, d):
    return r6(scoring.subset_accuracy(read(spark, d, "lineitem"), [["l_returnflag"], ["l_linenumber"], ["l_returnflag", "l_linenumber"], ["l_linenumber", "l_quantity"]], "l_linestatus"))


@query(f"with {CELLS}, h as (select attribute, (select -sum(nc / t.t * log2(nc / t.t)) from k where k.attribute = t.attribute) as hc, (select -sum(nv / t.t * log2(nv / t.t)) from v where v.attribute = t.attribute) as ha, (select -sum(n / t.t * log2(n / t.t)) from c where c.attribute = t.attribute) as hj from t) select attribute, round(hc + ha - hj, 6) as info_gain from h order by 2 desc, 1 limit 2")
def a_ranker(spark, d):
    return r6(scoring.rank(scoring.entropy_scores(_flags(spark, d)).select("attribute", "info_gain"), "info_gain", 2))


@query("select l_orderkey, l_linestatus, l_returnflag from lineitem where l_orderkey % 3 = 0")
def a_select_then_apply(spark, d):
    x = read(spark, d, "lineitem")
    # the return flag follows the ship date as the status does; the line number does not
    y = x.select("l_orderkey", "l_linestatus", "l_returnflag", F.lit("same").alias("constant"))
    return scoring.select_then_apply(y.where("l_orderkey % 3 <> 0"), y.where("l_orderkey % 3 = 0"), ["constant", "l_returnflag"], "l_linestatus", ["l_orderkey", "l_linestatus"], 1)


@query()
def a_svm_ranking(spark, d):
    x = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return r6(scoring.svm_ranking(x, ["l_quantity", "l_discount", "l_tax"], "y", maxIter=20))


ORACLE_SQL["a_relief"] = """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings), l as (select vec_id, unnest(range(64)) as i, unnest(s) as x from v), r as (select i, min(x) as a, max(x) - min(x) as w from l group by 1), n as (select vec_id, list((x - a) / w order by i) as x from l join r using (i) group by 1),
x as (select v.vec_id, label, n.x from v join n using (vec_id)), p as (select label, count(*) / (select count(*) from v) as p from v group by 1), d as (select q.vec_id as q, q.label as lq, t.vec_id as t, t.label as lt, q.x as a, t.x as b, list_sum(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i]))) as d from x q, x t where q.vec_id <> t.vec_id),
k as (select *, row_number() over (partition by q, lt order by d, t) as r from d), s as (select case when lq = lt then -1.0 else pt.p / (1 - pq.p) end / 10 as s, list_transform(range(1, 65), lambda i: abs(a[i] - b[i])) as g from k join p pt on pt.label = lt join p pq on pq.label = lq where r <= 10)
select i::int as attribute, round(sum(s * g[i + 1]) / (select count(*) from v), 6) as weight from s, range(64) t(i) group by i"""

# --- M ---------------------------------------------------------------------------------------------------------------

ITEMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
SETS = """t as (select 'l_returnflag=' || l_returnflag as a, 'l_linestatus=' || l_linestatus as b, 'l_linenumber=' || l_linenumber as c from lineitem), n as (select count(*)::double as n from lineitem), z as (select list_sort(x) as items from t, lateral (select unnest([[a], [b], [c], [a, b], [a, c], [b, c], [a, b, c]]) as x)), f as (select items, count(*) as freq from z group by 1 having count(*) >= ceil(0.02 * (select n from n))),
r as (select a.items as antecedent, list_filter(s.items, lambda x: not list_contains(a.items, x)) as consequent, s.freq as f, a.freq as fa from f s join f a on len(a.items) < len(s.items) and list_has_all(s.items, a.items)),
u as (select antecedent, consequent, f / n as support, f / fa as confidence, f / fa / (c.freq / n) as lift, f / n - fa / n * c.freq / n as leverage, fa / n * (n - c.freq) / (fa - f + 1) as conviction from r join f c on c.items = consequent, n where f / fa >= 0.3)"""
ORACLE_SQL["m_rules"] = f"with {SETS} select antecedent, consequent, round(support, 6) as support, round(confidence, 6) as confidence, round(lift, 6) as lift, round(leverage, 6) as leverage, round(conviction, 6) as conviction from u"


def _rules(spark, d, keep=None):
    x = read(spark, d, "lineitem")
    x = x.where(keep) if keep else x
    return mining.rules(mining.frequent_items(mining.to_items(x, ITEMS), 0.02), x.count(), 0.3)


@query(f"with {SETS} select antecedent, consequent, round(confidence, 6) as confidence from u where len(consequent) = 1 and starts_with(consequent[1], 'l_returnflag=')")
def m_class_rules(spark, d):
    return r6(mining.class_rules(_rules(spark, d), "l_returnflag").select("antecedent", "consequent", "confidence"))


@query("with " + SETS.replace("from lineitem)", "from lineitem where l_quantity < 20)") + " select antecedent, consequent, round(confidence, 6) as confidence from u where len(antecedent) = 1 and len(consequent) = 1")
def m_filtered(spark, d):
    return r6(_rules(spark, d, "l_quantity < 20").where("size(antecedent) = 1 and size(consequent) = 1").select("antecedent", "consequent", "confidence"))


@query(f"""with {SETS}, k as (select antecedent, consequent[1] as said, row_number() over (order by round(confidence, 9) desc, round(support, 9) desc, len(antecedent), array_to_string(antecedent, ','), consequent[1]) as turn from u where len(consequent) = 1 and starts_with(consequent[1], 'l_returnflag=')),
g as (select l_linestatus, l_linenumber, ['l_linestatus=' || l_linestatus, 'l_linenumber=' || l_linenumber] as have, count(*) as n from lineitem group by all), o as (select said from k group by 1 order by count(*) desc, said limit 1), p as (select l_linestatus, l_linenumber, n, coalesce(arg_min(said, turn), (select said from o)) as predicted from g left join k on list_has_all(have, antecedent) group by all) select predicted, sum(n)::bigint as n from p group by 1""")
def m_associative(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.count("*").alias("n")).withColumn("id", F.concat_ws("/", "l_linestatus", F.col("l_linenumber").cast("string")))
    rows = x.withColumn("items", F.array(F.concat(F.lit("l_linestatus="), "l_linestatus"), F.concat(F.lit("l_linenumber="), F.col("l_linenumber").cast("string"))))
    return mining.associative_predict(_rules(spark, d), rows, "id", "items", "l_returnflag").join(x, "id").groupBy("predicted").agg(F.sum("n").alias("n"))


ORACLE_SQL["m_sequences"] = """with recursive e as (select user_id, ts::date as day, event_type as k, row_number() over (partition by user_id, ts::date order by ts, event_id) as p from events), n as (select count(*) as n from (select distinct user_id, day from e)),
r as (select user_id, day, [[k]] as s, p from e union select r.user_id, r.day, list_append(r.s, [e.k]), e.p from r join e on e.user_id = r.user_id and e.day = r.day and e.p > r.p), f as (select s, count(distinct (user_id, day)) as freq from r group by 1) select s as sequence, freq from f, n where freq >= ceil(0.02 * n)"""

# --- K ---------------------------------------------------------------------------------------------------------------

_D = "list_sum(list_transform(range(1, 65), lambda i: power(v.s[i] - {c}.s[i], 2)))"


def _farthest(source: str) -> str:
    steps = [f"c0 as (select s from {source} order by vec_id limit 1)"]
    for k in range(1, 5):
        d = ", ".join(_D.format(c=f"c{j}") for j in range(k))
        least = f"least({d})" if k > 1 else d
        steps.append(f"c{k} as (select v.s from {source} v, {', '.join(f'c{j}' for j in range(k))} order by {least} desc, vec_id limit 1)")
    every = ", ".join(f"({_D.format(c=f'c{j}')}, {j})" for j in range(5))
    return f"{', '.join(steps)}, p as (select list_min([{every}]) as b from {source} v, c0, c1, c2, c3, c4) select (b[2])::int as cluster, count(*) as n from p group by 1"


ORACLE_SQL["k_farthest_first"] = f"with {V}, {_farthest('v')}"


@query(f"with {V}, {ZN}, {_farthest('z')}")
def k_filtered(spark, d):
    z = vectors(spark, d).select("vec_id", A.z_normalise(F.col("s")).alias("s"))
    return models.farthest_first(z, "vec_id", "s", 5).groupBy("cluster").agg(F.count("*").alias("n"))


REACH = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as s from embeddings), e as (select a.vec_id as x, b.vec_id as y, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2)))) as d from v a, v b where a.vec_id <> b.vec_id), n as (select * from e where d <= {e}),
k as (select vec_id as id from v left join n on n.x = vec_id group by 1 having count(y) + 1 >= {m}), r as (select id as a, id as b from k union select r.a, n.y from r join n on n.x = r.b join k on k.id = n.y), c as (select b as id, min(a) as c from r group by 1)"""


@query(REACH.format(e=1.15, m=3) + ", o as (select n.x as id, arg_min(c.c, (round(n.d, 9), n.y)) as c from n join c on c.id = n.y where n.x not in (select id from c) group by 1) select v.vec_id as id, c.id is not null as core, coalesce(c.c, o.c, -1) as cluster from v left join c on c.id = v.vec_id left join o on o.id = v.vec_id")
def k_density(spark, d):
    return graphs.density_clusters(vectors(spark, d), "vec_id", "s", 1.15, 3).withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@query(REACH.format(e=1.12, m=1) + " select id, c as component from c")
def k_single_link(spark, d):
    return graphs.single_link(vectors(spark, d), "vec_id", "s", 1.12)


@query(f"with {V}, p as (select a.vec_id as id, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2)))) as d from v a, v b where a.vec_id <> b.vec_id), q as (select id, d, row_number() over (partition by id order by d) as r from p) select id, round(d, 6) as core_distance from q where r = 4")
def k_core_distances(spark, d):
    return r6(graphs.core_distances(vectors(spark, d), "vec_id", "s", "label", 5))


_SWEPT = " select {e}::double as epsilon, (select count(distinct c) from c) as clusters, (select count(*) from v where vec_id not in (select id from c) and vec_id not in (select n.x from n join c on c.id = n.y)) as noise"


@query("select * from (" + REACH.format(e=1.1, m=3) + _SWEPT.format(e=1.1) + ") union all select * from (" + REACH.format(e=1.15, m=3) + _SWEPT.format(e=1.15) + ")")
def k_epsilon_sweep(spark, d):
    return graphs.epsilon_sweep(vectors(spark, d), "vec_id", "s", [1.1, 1.15], 3)


@query("with n as (select l_linenumber % 3 as c, l_returnflag as f, count(*) as n from lineitem group by all) select (select count(*) from lineitem) as n, max(a.n + b.n + c.n)::bigint as hits, round(1 - max(a.n + b.n + c.n) / (select count(*) from lineitem), 6) as error from n a, n b, n c where a.c = 0 and b.c = 1 and c.c = 2 and a.f <> b.f and b.f <> c.f and a.f <> c.f")
def k_assignment(spark, d):
    return r6(models.best_assignment(read(spark, d, "lineitem").withColumn("c", F.col("l_linenumber") % 3), "c", "l_returnflag"))


@query("with m as (select l_linenumber as c, count(*) as k, avg(l_quantity) as m1, stddev_samp(l_quantity) as s1, avg(l_discount) as m2, stddev_samp(l_discount) as s2 from lineitem group by 1) select l_orderkey as id, c as cluster, round(ln(k / (select count(*) from lineitem)) - power((l_quantity - m1) / s1, 2) / 2 - ln(s1) - power((l_discount - m2) / s2, 2) / 2 - ln(s2) - ln(2 * pi()), 5) as log_density from lineitem, m")
def k_cluster_densities(spark, d):
    x = read(spark, d, "lineitem")
    each = models.cluster_densities(x, "l_linenumber", ["l_quantity", "l_discount"], "l_orderkey")
    return each.select("id", "cluster", (F.round("log_density", 5) + 0.0).alias("log_density"))


@query("with n as (select l_linenumber as c, l_returnflag as f, count(*) as n from lineitem group by all), t as (select c, arg_min(f, (-n, f)) as p from n group by 1) select l_returnflag as actual, p as predicted, count(*) as n from lineitem join t on t.c = l_linenumber group by all")
def k_via_clustering(spark, d):
    return evaluation.confusion(models.via_clustering(read(spark, d, "lineitem"), "l_linenumber", "l_returnflag").withColumnRenamed("l_returnflag", "actual"))


@query()
def k_diagonal_mixture(spark, d):
    parts, _ = models.diagonal_mixture(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey", 3, 3)
    return spark.createDataFrame([(p["component"], round(p["share"], 5), [round(x, 4) for x in p["mean"]]) for p in parts], "component int, share double, mean array<double>")


# An edge is in the forest unless smaller edges connect its ends.
@query("""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as s from embeddings), e as (select a.vec_id as x, b.vec_id as y, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2)))) as d from v a, v b where a.vec_id < b.vec_id),
k as (select x, y, d, row_number() over (order by round(d, 9), x, y) as k from e where d <= 1.12), b as (select k, x, y from k union all select k, y, x from k), r as (select k, x as a from k union select r.k, b.y from r join b on b.x = r.a and b.k < r.k)
select x, y, round(d, 6) as distance from k where (k, y) not in (select k, a from r)""")
def k_spanning_forest(spark, d):
    x = vectors(spark, d)
    return r6(graphs.minimum_forest(x.select(F.col("vec_id").alias("id")), graphs.radius_join(x, x, "vec_id", "s", 1.12)))


# --- L ---------------------------------------------------------------------------------------------------------------


@query("select o_orderpriority, count(*) as count from orders group by 1 order by 2 desc, 1 limit 1")
def l_zero_rule(spark, d):
    return models.zero_rule(read(spark, d, "orders"), "o_orderpriority")


WORDS = r"""w as (select doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[ \r\n\t.,;:''"()?!]+'), lambda x: x <> '')) as term from documents), o as (select distinct doc_id, toxic from labels), x as (select w.doc_id, term, count(*) as n from w join o using (doc_id) group by all), c as (select toxic, term, sum(n) as n from x join o using (doc_id) group by all), t as (select term, sum(n) as a from c group by 1), s as (select toxic, sum(n) as total from c group by 1)"""


def _bayes_sql(complement: bool) -> str:
    n, total, sign, prior = ("a - coalesce(n, 0)", "(select sum(total) from s) - total", "-", "0.0") if complement else ("coalesce(n, 0)", "total", "", "ln(docs)")
    return f"""with {WORDS}, m as (select s.toxic, t.term, {sign}ln(({n} + 1) / ({total} + (select count(*) from t))) as w from t cross join s left join c on c.term = t.term and c.toxic = s.toxic), p as (select toxic as class, count(*) as docs from o group by 1),
z as (select o.doc_id, o.toxic as actual, p.class, docs, round(coalesce((select sum(x.n * m.w) from x join m on m.term = x.term and m.toxic = p.class where x.doc_id = o.doc_id), 0) + {prior}, 9) as s from o, p), y as (select doc_id, actual, arg_min(class, (-s, -docs, class)) as predicted from z group by all) select actual, predicted, count(*) as n from y group by all"""


def _bayes(spark, d, complement):
    labels = read(spark, d, "labels").select("doc_id", "toxic").distinct()
    docs = read(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    words = text.term_counts(docs, "doc_id", text.tokens(F.col("text")))
    return evaluation.confusion(models.multinomial_bayes(words, labels, "doc_id", "toxic", complement))


@query(_bayes_sql(False))
def l_multinomial_bayes(spark, d):
    return _bayes(spark, d, False)


@query(_bayes_sql(True))
def l_complement_bayes(spark, d):
    return _bayes(spark, d, True)


NOMINAL = "y as (select l_returnflag as r, l_linenumber as n, floor(l_quantity / 10)::int as q, l_linestatus as s from lineitem)"


def _nominal(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("n"), F.floor(F.col("l_quantity") / 10).cast("int").alias("q"), F.col("l_linestatus").alias("s"))


def _ode(parent: str, others: tuple[str, str]) -> str:
    one = f"coalesce((select count(*) from y where y.{parent} = p.{parent} and y.s = c.s), 0)"
    parts = " * ".join(f"((select count(*) from y where y.{parent} = p.{parent} and y.{o} = p.{o} and y.s = c.s) + 1) / ({one} + (select count(distinct {o}) from y))" for o in others)
    return f"({one} + 1) / ((select count(*) from y) + (select count(distinct s) from y) * (select count(distinct {parent}) from y)) * {parts}"


@query(f"with {NOMINAL}, p as (select distinct r, n, q from y), c as (select distinct s from y), z as (select p.r, p.n, p.q, c.s, round({_ode('r', ('n', 'q'))} + {_ode('n', ('r', 'q'))} + {_ode('q', ('r', 'n'))}, 12) as v from p, c) select r, n, q, arg_min(s, (-v, s)) as predicted from z group by all")
def l_one_dependence(spark, d):
    return models.one_dependence(_nominal(spark, d), ["r", "n", "q"], "s")


def _cmi(a: str, b: str) -> str:
    return f"select '{a}' as a, '{b}' as b, sum(m / (select count(*) from y) * log2(m * ms / (ma * mb))) as information from (select count(*) as m, any_value(ms) as ms, any_value(ma) as ma, any_value(mb) as mb from (select {a}, {b}, s, count(*) over (partition by s) as ms, count(*) over (partition by {a}, s) as ma, count(*) over (partition by {b}, s) as mb from y) group by {a}, {b}, s)"


@query(f"with {NOMINAL}, i as ({_cmi('r', 'n')} union all {_cmi('r', 'q')} union all {_cmi('n', 'q')}) select a, b, round(information, 6) as information from i")
def l_conditional_information(spark, d):
    return r6(models.conditional_information(_nominal(spark, d), ["r", "n", "q"], "s"))


@query(f"with {NOMINAL} select r, n, q, count(*) as rows from y group by all")
def l_tree_bayes(spark, d):
    x = _nominal(spark, d)
    said = models.tree_bayes(x, ["r", "n", "q"], "s")
    return x.join(said, ["r", "n", "q"]).where(F.col("predicted").isin("F", "O")).groupBy("r", "n", "q").agg(F.count("*").alias("rows"))


_LINE = "select '{c}' as attribute, regr_slope(l_extendedprice, {c}) as slope, regr_intercept(l_extendedprice, {c}) as intercept, regr_syy(l_extendedprice, {c}) - power(regr_sxy(l_extendedprice, {c}), 2) / regr_sxx(l_extendedprice, {c}) as sse from lineitem"


@query(f"with l as ({_LINE.format(c='l_quantity')} union all {_LINE.format(c='l_discount')} union all {_LINE.format(c='l_tax')}) select attribute, round(slope, 4) as slope, round(intercept, 3) as intercept from l order by sse, attribute limit 1")
def l_simple_linear(spark, d):
    x = models.simple_linear(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return x.select("attribute", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("with m as (select var_pop(l_quantity) as a, var_pop(l_discount) as b, covar_pop(l_quantity, l_discount) as c, covar_pop(l_quantity, l_extendedprice) as x, covar_pop(l_discount, l_extendedprice) as y, avg(l_quantity) as mq, avg(l_discount) as md, avg(l_extendedprice) as mp from lineitem), w as (select (x * b - y * c) / (a * b - c * c) as w1, (y * a - x * c) / (a * b - c * c) as w2, mq, md, mp from m) select round(w1, 4) as w1, round(w2, 3) as w2, round(mp - w1 * mq - w2 * md, 3) as intercept from w")
def l_least_squares(spark, d):
    w, b = models.ridge(read(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(round(w[0], 4), round(w[1], 3), round(b, 3))], "w1 double, w2 double, intercept double")


@query("""with y as (select o_orderkey, o_orderstatus as k, o_totalprice as v from orders), b as (select distinct unnest([min(v), max(v)]) as b from y group by k), i as (select o_orderkey, k, v, (select count(*) from b where b.b <= v) as i from y), s as (select k, count(*) as t from y group by 1), c as (select i, i.k, count(*) / any_value(t) as x from i join s on s.k = i.k group by all), z as (select i, k, round(x / sum(x) over (partition by i), 9) as x from c), g as (select s.k, n.i, coalesce(z.x, 0) as x from s cross join (select distinct i from i) n left join z on z.i = n.i and z.k = s.k), p as (select i, arg_min(k, (-x, k)) as p from g group by 1)
select k as actual, p as predicted, count(*) as n from i join p using (i) group by all""")
def l_voting_intervals(spark, d):
    x = read(spark, d, "orders")
    model = models.voting_intervals(x, ["o_totalprice"], "o_orderstatus")
    return evaluation.confusion(models.interval_predict(x, model).withColumnRenamed("o_orderstatus", "actual"))


@query("""with m as (select min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem), x as (select l_linenumber, l_returnflag, l_extendedprice as y, least(greatest(ceil((l_extendedprice - a) / ((b - a) / 8)) - 1, 0), 7)::int as bin from lineitem, m), g as (select bin, avg(y) as m from x group by 1)
select l_linenumber, l_returnflag, round(sum(m) / count(*), 4) as predicted from x join g using (bin) group by all""")
def l_binned_regression(spark, d):
    p = models.binned_regression(read(spark, d, "lineitem"), ["l_linenumber", "l_returnflag"], "l_extendedprice", 8)
    return p.withColumn("predicted", F.round("predicted", 4))


@query(f"with {PRED}, c as (select actual, case when round(probs[2] * 5, 12) <= round(probs[1], 12) then 0 else 1 end as predicted from p) select actual, predicted, count(*) as n from c group by all")
def l_least_cost(spark, d):
    return evaluation.confusion(models.least_cost(_predictions(spark, d), [[0.0, 1.0], [5.0, 0.0]]))


@query(f"""with {PRED}, s as (select score, sum(actual) as p, sum(1 - actual) as n from p group by 1), c as (select score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as a from s window w as (order by score desc)), f as (select score, 2 * tp / (tp + fp + a) as f from c where tp > 0) select score, round(f, 6) as value from f order by round(f, 9) desc, score desc limit 1""")
def l_best_threshold(spark, d):
    return r6(models.best_threshold(_predictions(spark, d)))


@query("select o_orderkey, o_totalprice, null::double as missing, o_orderstatus from orders")
def l_align(spark, d):
    wanted = spark.createDataFrame([], "o_orderkey long, o_totalprice double, missing double, o_orderstatus string").schema
    x = read(spark, d, "orders").select(F.col("o_totalprice").alias("O_TOTALPRICE"), "o_orderstatus", F.col("o_orderkey").alias("O_OrderKey"), "o_custkey")
    return models.align(x, wanted)


@query("select o_custkey, round(avg(o_totalprice), 6) as mean, round(exp(avg(ln(o_totalprice))), 4) as geometric, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1")
def l_bag_summary(spark, d):
    x = read(spark, d, "orders")
    parts = [models.bag_summary(x, "o_custkey", ["o_totalprice"], k) for k in ("mean", "geometric", "ends")]
    both = parts[0].withColumnRenamed("o_totalprice", "mean").join(parts[1].withColumnRenamed("o_totalprice", "geometric"), "o_custkey").join(parts[2], "o_custkey")
    return both.select("o_custkey", F.round("mean", 6).alias("mean"), F.round("geometric", 4).alias("geometric"), F.col("o_totalprice_min").alias("low"), F.col("o_totalprice_max").alias("high"))


@query("with p as (select o_custkey as bag, (l_quantity > 25)::int as said from lineitem join orders on o_orderkey = l_orderkey), v as (select bag, avg(0.2 + 0.6 * said) as v1 from p group by 1) select bag, 0 as actual, case when round(v1, 12) > round(1 - v1, 12) then 1 else 0 end as predicted from v")
def l_bag_vote(spark, d):
    p = (F.col("l_quantity") > 25).cast("int")
    x = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("bag"), F.lit(0).alias("actual"), F.array(0.8 - 0.6 * p, 0.2 + 0.6 * p).alias("probs"))
    return models.bag_vote(x, "bag")


@query(f"""with {V}, c as (select vec_id, label, k, s[16 * k + 1 : 16 * k + 16] as s from v, range(4) t(k)), n as (select a.vec_id, a.label as actual, a.k, b.label as said, row_number() over (partition by a.vec_id, a.k order by list_sum(list_transform(range(1, 17), lambda i: power(a.s[i] - b.s[i], 2))), b.vec_id) as r from c a join c b on a.k = b.k and a.vec_id <> b.vec_id),
g as (select vec_id, actual, said, count(*) as n from n where r = 1 group by all), p as (select vec_id, actual, arg_min(said, (-n, said)) as predicted from g group by all) select actual, predicted, count(*) as n from p group by all""")
def l_channel_vote(spark, d):
    x = series.to_channels(vectors(spark, d), "s", 16)
    return evaluation.confusion(models.channel_vote(x, "vec_id", "channels", "label"))


@query()
def l_boosted_rules(spark, d):
    x = _nominal(spark, d)
    rules = models.boosted_rules(x, ["r", "n", "q"], "s", 4)
    return r6(evaluation.accuracy(models.rules_predict(x, rules, ["F", "O"]).withColumnRenamed("s", "actual")))


@query()
def l_bagging(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("r"), F.col("l_linenumber").alias("n"), F.col("l_linestatus").alias("s"))
    p = models.bagged_tables(x, ["r", "n"], "s", "id", 7, subspace=0.8)
    return r6(evaluation.accuracy(x.join(p, ["r", "n"]).withColumnRenamed("s", "actual")))


@query("""with b as (select distinct l_orderkey, l_linenumber, (l_quantity > 25)::int as b0, (l_discount > 0.05)::int as b1, (l_tax > 0.04)::int as b2 from lineitem), c as (select * from (values ('x', 1, 1, null), ('y', 0, null, 1), ('z', null, 0, 0)) t(k, c0, c1, c2)),
g as (select l_orderkey, l_linenumber, b0, b1, b2, k, round((coalesce(abs(b0 - c0), 0) + coalesce(abs(b1 - c1), 0) + coalesce(abs(b2 - c2), 0)) / 2, 9) as g from b, c), p as (select l_orderkey, l_linenumber, b0, b1, b2, arg_min(k, (g, k)) as predicted from g group by all) select distinct l_orderkey, l_linenumber, predicted from p""")
def l_code_words(spark, d):
    codes = models.pairwise_codes(["x", "y", "z"])
    bit = lambda c, v: (F.col(c) > v).cast("int")
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bit("l_quantity", 25).alias("b0"), bit("l_discount", 0.05).alias("b1"), bit("l_tax", 0.04).alias("b2"))
    return models.decode(x, ["b0", "b1", "b2"], codes, ["x", "y", "z"]).select("l_orderkey", "l_linenumber", "predicted").distinct()


def _learner(name, **params):
    def run(spark, d):
        x = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
        return evaluation.accuracy(models.cross_validate(name, x, "y", "s", "vec_id", 2, **params))

    return run


for _name, _params in {"tree": {"maxDepth": 4}, "boosted": {"maxIter": 3, "maxDepth": 3}, "svm": {"maxIter": 10}, "perceptron": {"layers": [64, 8, 2], "maxIter": 20, "seed": 1}, "one_vs_rest": {}}.items():
    _f = _learner(_name, **_params)
    _f.__name__ = f"l_{_name}"
    query()(_f)


@query()
def l_isotonic(spark, d):
    from pyspark.ml.functions import array_to_vector

    x = read(spark, d, "part").select(F.array(F.col("p_size").cast("double")).alias("f"), F.col("p_retailprice").alias("y"))
    m = models.fit("isotonic", x, "f", "y")
    grid = spark.range(1, 51, 10).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), "id")
    return r6(m.transform(grid).select("id", "prediction"))


@query()
def l_radial_basis(spark, d):
    x = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    _, model, activate = models.radial_basis(x, "s", "y", 8, maxIter=20)
    p = model.transform(models.as_vectors(activate(x), "__act", "y")).select(F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))
    return evaluation.accuracy(p)


@query()
def l_stacking(spark, d):
    x = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return evaluation.accuracy(models.stacked(x, "y", "s", "vec_id", {"tree": {"maxDepth": 3}, "logistic": {"maxIter": 10}}, 2))


@query()
def l_grid(spark, d):
    x = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return r6(models.grid("tree", x, "y", "s", "vec_id", [{"maxDepth": 2}, {"maxDepth": 4}], 2))
