"""Queries of the diagnostic operators."""

from __future__ import annotations

from ..operators import diagnostics
from .catalog import PRED, VP, _modules, _predictions, query, r6, read


@query(f"""with {PRED}, c as (select actual, predicted, count(*)::double as n from p group by all), e as (select unnest([actual, predicted]) as label, actual <> predicted as wrong, n from c),
x as (select *, n / sum(n) over (partition by label) as x from e), t as (select label, sum(n) as s, sum(case when wrong then -x * ln(x) else 0 end) as e from x group by 1)
select label, round(s / sum(s) over (), 6) as share, round(e / ln(2 * (count(*) over () - 1)), 6) as confusion_entropy from t""")
def v_confusion_entropy(spark, d):
    return r6(diagnostics.confusion_entropy(_predictions(spark, d)))


@query(f"""with {PRED}, s as (select score, sum(actual) as p, sum(1 - actual) as n from p group by 1), c as (select score, sum(p) over w / sum(p) over () as recall, sum(n) over w / sum(n) over () as fallout from s window w as (order by score desc))
select score, 0.0::double as probability_cost, round(fallout, 6) as expected_cost from c union all select score, 1.0::double, round(1 - recall, 6) from c""")
def e_cost_curve(spark, d):
    return r6(diagnostics.cost_curve(_predictions(spark, d)))


@query(f"""with {VP} select item, actual, list(predicted order by module, predicted) as predictions, list(0.75::double order by module, predicted) as confidences,
flatten(list([0.75::double - 0.5 * predicted, 0.25::double + 0.5 * predicted] order by module, predicted)) as distribution from p group by 1, 2""")
def v_stacking_features(spark, d):
    return r6(diagnostics.stacking_features(_modules(spark, d)))


@query("""with c as (select c_acctbal as v, sum((c_mktsegment = 'BUILDING')::int)::double as x, sum((c_mktsegment = 'MACHINERY')::int)::double as y from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal is not null group by 1),
q as (select x, y, sum(y) over w - y / 2 as px, sum(x) over w - x / 2 as py from c window w as (order by v)),
s as (select sum(x) as n1, sum(y) as n2, sum(x * px) as sx, sum(y * py) as sy, sum(x * px * px) as qx, sum(y * py * py) as qy from q)
select n1::bigint as n1, n2::bigint as n2, round(sx / n1, 6) as placement1, round(sy / n2, 6) as placement2, round((sx - sy) / (2 * sqrt(qx - sx * sx / n1 + qy - sy * sy / n2 + sx / n1 * sy / n2)), 6) as z from s""")
def p_robust_rank_order(spark, d):
    return r6(diagnostics.robust_rank_order(read(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").drop("p"))


def _part(keep: str, name: str) -> str:
    a, b = f"case when {keep} then l_extendedprice end", f"case when {keep} then l_quantity end"
    return f"regr_count({a}, {b})::bigint as n_{name}, (regr_syy({a}, {b}) - power(regr_sxy({a}, {b}), 2) / regr_sxx({a}, {b})) / (regr_count({a}, {b}) - 2) as v_{name}"


@query(f"select n_low, n_high, round(v_high / v_low, 6) as f from (select {_part('l_quantity <= 20', 'low')}, {_part('l_quantity >= 31', 'high')} from lineitem)")
def p_goldfeld_quandt(spark, d):
    return r6(diagnostics.goldfeld_quandt(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20, 31).select("n_low", "n_high", "f"))
