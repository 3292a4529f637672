"""Queries of the streaming operators: each runs a stream over all files of a driver table and equals the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, series, table, text
from ..sources.files import scratch
from ..streaming import operators as streaming
from .catalog import query, r6, read


#: Rows of a file of a stream.
FILE_ROWS = 100_000


def source(spark, d, name, parts=3, dealt=False):
    """A stream over a driver table, in some files so that several micro-batches arrive: ranges of the first column, or its remainders if ``dealt``."""
    path = scratch(spark, name)
    x = read(spark, d, name)
    # a batch is a file while tables are small; a larger one has more files, so that a task reads one of them
    pieces = max(1, -(-x.count() // (parts * FILE_ROWS)))

    def put(rows):
        (rows.coalesce(1) if pieces == 1 else rows.repartition(pieces)).write.mode("append").parquet(path)

    if dealt:
        for i in range(parts):
            put(x.where(F.col(x.columns[0]) % parts == i))
        return streaming.row_source(spark, path, x.schema, pieces)
    # one after the other, so that they arrive in the order of the first column
    cuts = [float("-inf"), *x.approxQuantile(x.columns[0], [i / parts for i in range(1, parts)], 0.01), float("inf")]
    for a, b in zip(cuts, cuts[1:], strict=False):
        put(x.where((F.col(x.columns[0]) > a) & (F.col(x.columns[0]) <= b)))
    return streaming.row_source(spark, path, x.schema, pieces)


@query("select o_orderkey, o_totalprice from orders")
def w_rows(spark, d):
    return streaming.run_to_table(source(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("select l_orderkey, l_linenumber, (l_returnflag in ('A', 'R'))::int as sent, case when l_linestatus in ('O') then 'open' else l_linestatus end as l_linestatus, round(sqrt(l_quantity), 6) as l_quantity, coalesce(case when l_tax > 0.01 then l_tax end, -1) as l_tax, (l_discount <> 0)::int as l_discount, strftime(l_shipdate, '%Y-%m') as month from lineitem where l_quantity < 30")
def w_filters(spark, d):
    x = source(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    steps = (
        lambda t: table.filter_value(t, "l_quantity", below=30), lambda t: columns.indicator(t, "l_returnflag", ["A", "R"], "sent"), lambda t: columns.merge_labels(t, "l_linestatus", ["O"], "open"),
        lambda t: columns.apply_unary(t, ["l_quantity"], "sqrt"), lambda t: columns.impute_constant(t, {"l_tax": -1.0}), lambda t: columns.to_binary(t, ["l_discount"]), lambda t: t.withColumn("month", columns.date_text(F.col("l_shipdate"), "yyyy-MM")),
    )
    y = table.apply_all(x, *steps).select("l_orderkey", "l_linenumber", "sent", "l_linestatus", "l_quantity", "l_tax", "l_discount", "month")
    return r6(streaming.run_to_table(y))


@query("select p_partkey, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_samp(p_retailprice) from part), 6) as p_retailprice from part")
def w_fit_then_apply(spark, d):
    model = columns.Standardizer(["p_retailprice"]).fit(read(spark, d, "part"))
    return r6(streaming.run_to_table(model.transform(source(spark, d, "part").select("p_partkey", "p_retailprice"))))


@query("select user_id, event_id, round(value - lag(value) over (partition by user_id order by event_id), 6) as delta from events")
def w_delta(spark, d):
    x = streaming.delta(source(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return r6(streaming.run_to_table(x).select("user_id", "event_id", "delta"))


@query()
def w_reservoir(spark, d):
    state = streaming.TableState(spark, "o_orderkey long, o_totalprice double")
    streaming.feed(source(spark, d, "orders"), streaming.reservoir_sink(100, "o_orderkey", 1, state))
    return state.before()


@query("select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as l_quantity_mean, round(stddev_samp(l_quantity), 6) as l_quantity_sd, round(avg(l_tax), 6) as l_tax_mean, round(stddev_samp(l_tax), 6) as l_tax_sd from lineitem group by 1")
def w_naive_bayes(spark, d):
    names = ["l_quantity", "l_tax"]
    s = streaming.run_to_table(streaming.class_statistics(source(spark, d, "lineitem"), "l_returnflag", names), "complete")
    return r6(streaming.class_model(s, "l_returnflag", names))


@query(r"""with w as (select lang, unnest(list_filter(string_split_regex(coalesce(text, ''), '[ \r\n\t.,;:''"()?!]+'), lambda x: x <> '')) as term from documents) select lang, term, count(*) as n from w group by all""")
def w_multinomial(spark, d):
    return streaming.run_to_table(streaming.term_statistics(source(spark, d, "documents"), "lang", text.tokens(F.col("text"))), "complete")


@query("select event_id, user_id, value from events order by ts desc, event_id desc limit 200")
def w_recent_rows(spark, d):
    state = streaming.TableState(spark, "event_id long, user_id long, ts timestamp, value double")
    x = source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    streaming.feed(x, streaming.recent_sink(200, ["ts", "event_id"], state))
    return state.before().select("event_id", "user_id", "value")


# Three batches, by the remainder of the order's key; a step of rate 0.5 along the mean gradient of each, for each class against the rest.
_STEP = """, w{i} as (select w.c, w.a - 0.5 * avg((1 / (1 + exp(-(w.a * l_discount + w.b * l_tax + w.z))) - (l_returnflag = w.c)::int) * l_discount) as a, w.b - 0.5 * avg((1 / (1 + exp(-(w.a * l_discount + w.b * l_tax + w.z))) - (l_returnflag = w.c)::int) * l_tax) as b,
w.z - 0.5 * avg(1 / (1 + exp(-(w.a * l_discount + w.b * l_tax + w.z))) - (l_returnflag = w.c)::int) as z from lineitem, w{j} w where l_orderkey % 3 = {j} group by w.c, w.a, w.b, w.z)"""
LINEAR = "with w0 as (select c, 0.0::double as a, 0.0::double as b, 0.0::double as z from (values ('A'), ('N'), ('R')) t(c))" + "".join(_STEP.format(i=i + 1, j=i) for i in range(3)) + ", k as (select c, unnest([0, 1, 2])::int as i, round(unnest([a, b, z]), 6) as w from w3)"


@query(f"{LINEAR} select i, w from k where c = 'R'")
def w_linear_model(spark, d):
    state = streaming.TableState(spark, "i int, w double")
    x = source(spark, d, "lineitem", dealt=True).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    streaming.feed(x, streaming.gradient_sink(["l_discount", "l_tax"], "y", 0.5, state, "log"))
    return r6(state.before().select("i", "w"))


@query(f"{LINEAR} select c as class, i, w from k")
def w_multi_class(spark, d):
    states = {c: streaming.TableState(spark, "i int, w double") for c in ("A", "N", "R")}
    streaming.feed(source(spark, d, "lineitem", dealt=True), streaming.per_class_gradients(["l_discount", "l_tax"], "l_returnflag", list(states), 0.5, states))
    out = None
    for c, s in states.items():
        r = s.before().select(F.lit(c).alias("class"), "i", "w")
        out = r if out is None else out.union(r)
    return r6(out)


# A decision table a batch; after the last batch the two members of best accuracy vote, older ones judged by that batch, the new one by its own rows.
@query("""with x as (select l_orderkey % 3 as b, l_returnflag || '/' || l_linenumber as id, l_linestatus as y from lineitem), t as (select b as m, id, arg_min(y, (-n, y)) as predicted from (select b, id, y, count(*) as n from x group by all) group by all),
s as (select t.m, avg((predicted = y)::int) as s from x join t using (id) where b = 2 group by 1), k as (select m, s from s order by s desc, m limit 2), v as (select id, predicted, sum(s) as v from t join k using (m) group by all)
select id, arg_min(predicted, (-round(v, 9), predicted)) as predicted from v group by 1""")
def w_raced_boosting(spark, d):
    state = streaming.TableState(spark, "member int, pattern string, predicted string, score double")
    x = read(spark, d, "lineitem").withColumn("id", F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string")))
    streaming.feed(source(spark, d, "lineitem", dealt=True), streaming.raced_rules(["l_returnflag", "l_linenumber"], "l_linestatus", state, 2))
    rows = x.select("id", "l_returnflag", "l_linenumber").distinct()
    return streaming.committee_vote(state.before(), rows, "id", ["l_returnflag", "l_linenumber"])


@query()
def w_hoeffding_tree(spark, d):
    state = streaming.TableState(spark, "leaf string, attribute string, value string, class string, n long")
    streaming.feed(source(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus"), streaming.hoeffding_sink(["l_returnflag", "l_linenumber"], "l_linestatus", 2, state))
    return state.before().where("class is null").select("leaf", "attribute")


@query("with g as (select l_returnflag as g, count(*) as m from lineitem group by 1), v as (select l_returnflag as g, 's' as a, l_linestatus as v, count(*) as k from lineitem group by all union all select l_returnflag, 'n', l_linenumber::varchar, count(*) from lineitem group by all), n as (select count(*) as n from lineitem), o as (select sum(k * k / n) as o from (select a, v, sum(k) as k from v group by all), n) select round(((select sum(k * k / m) from v join g using (g)) - o) / n / (select count(*) from g), 6) as utility from o, n")
def w_category_utility(spark, d):
    return r6(streaming.category_utility(read(spark, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]))


@query("select l_returnflag, l_linenumber as value, count(*) as n from lineitem group by all")
def w_estimators(spark, d):
    return streaming.run_to_table(streaming.value_statistics(source(spark, d, "lineitem"), "l_linenumber", ["l_returnflag"]), "complete")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def w_windowed_counts(spark, d):
    x = source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = streaming.run_to_table(streaming.windowed_counts(x, "ts", "1 day", "1 day", "event_type"), "complete")
    return c.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select event_id, lag(value) over (partition by user_id order by ts, event_id) as lag1, lead(value) over (partition by user_id order by ts, event_id) as lead1 from events")
def w_lags(spark, d):
    x = series.lag_columns(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", [1, -1])
    return x.select("event_id", F.col("value_lag1").alias("lag1"), F.col("value_lag-1").alias("lead1"))
