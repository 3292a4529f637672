"""Queries of file formats, further relational operators, sampling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import columns, sampling, series, table
from ..sources import files
from .catalog import query, r6, read, vectors

# --- S: every format is written from a driver table and read back ---------------------------------------------------


def _some_orders(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("double").alias("o_orderkey"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))


SOME = "select o_orderkey::double as o_orderkey, case when o_orderkey % 7 <> 0 then o_totalprice end as price, case when o_orderkey % 5 <> 0 then o_orderpriority end as priority, o_orderstatus as status from orders"


@query(SOME)
def s_arff(spark, d):
    path = files.scratch(spark, "arff")
    files.write_arff(_some_orders(spark, d), path, "orders", ("status",))
    return files.read_arff(spark, path)


@query("select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice > 0")
def s_arff_sparse(spark, d):
    path = files.scratch(spark, "arff")
    x = read(spark, d, "orders").select(F.col("o_orderkey").cast("double").alias("o_orderkey"), "o_totalprice", "o_orderstatus")
    head = "@relation o\n@attribute o_orderkey numeric\n@attribute o_totalprice numeric\n@attribute o_orderstatus {F,O,P}\n@data"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(path)
    x.select(F.format_string("{0 %s, 1 %s, 2 %s}", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderstatus").alias("value")).write.mode("append").text(path)
    return files.read_arff(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", "o_orderstatus")


@query(SOME)
def s_csv(spark, d):
    path = files.scratch(spark, "csv")
    files.write_csv(_some_orders(spark, d), path, sep=";")
    return files.read_csv(spark, path, "o_orderkey double, price double, priority string, status string", sep=";")


FEATURES = "select l_linenumber::double as label, l_quantity as q, l_discount as d, l_tax as t, count(*) as n from lineitem group by all"


def _features(x):
    at = lambda i: F.coalesce(F.element_at("features", i), F.lit(0.0))
    return x.select("label", at(1).alias("q"), at(2).alias("d"), at(3).alias("t")).groupBy("label", "q", "d", "t").agg(F.count("*").alias("n"))


@query(FEATURES)
def s_svmlight(spark, d):
    path = files.scratch(spark, "svm")
    dense = F.create_map(F.lit(1), F.col("l_quantity"), F.lit(2), F.col("l_discount"), F.lit(3), F.col("l_tax"))
    files.write_svmlight(read(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("label"), F.map_filter(dense, lambda _, v: v != 0).alias("features")), path)
    return _features(files.read_svmlight(spark, path))


@query(FEATURES)
def s_libsvm(spark, d):
    from pyspark.ml.functions import vector_to_array

    path = files.scratch(spark, "svm")
    dense = F.create_map(F.lit(1), F.col("l_quantity"), F.lit(2), F.col("l_discount"), F.lit(3), F.col("l_tax"))
    files.write_svmlight(read(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("label"), dense.alias("features")), path)
    x = spark.read.format("libsvm").option("numFeatures", 3).load(path).select("label", vector_to_array("features").alias("v"))
    return x.groupBy("label", F.col("v")[0].alias("q"), F.col("v")[1].alias("d"), F.col("v")[2].alias("t")).agg(F.count("*").alias("n"))


@query("select o_orderkey, price, priority, status as class from (" + SOME + ")")
def s_names_data(spark, d):
    names, data = files.scratch(spark, "names"), files.scratch(spark, "data")
    files.write_names_data(_some_orders(spark, d), names, data, "status")
    return files.read_names_data(spark, names, data)


@query("select vec_id, list_transform(embedding, lambda x: round(x::double, 6)) as row from embeddings")
def s_matrix(spark, d):
    path = files.scratch(spark, "matrix")
    files.write_matrix(vectors(spark, d).select(F.concat(F.array(F.col("vec_id").cast("double")), "s").alias("row")), path)
    x = files.read_matrix(spark, path)
    return r6(x.select(F.col("row")[0].cast("long").alias("vec_id"), F.slice("row", 2, 64).alias("row")))


@query("select p_partkey, p_brand, p_retailprice from part")
def s_xml(spark, d):
    path = files.scratch(spark, "xml")
    files.write_xml(read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), path)
    return files.read_xml(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query(r"select lang as label, regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') as text, count(*) as n from documents where lang is not null group by all")
def s_text_folders(spark, d):
    path = files.scratch(spark, "folders")
    files.write_text_folders(read(spark, d, "documents").where("lang is not null"), path, "lang", "text")
    return files.read_text_lines(spark, path).groupBy("label", "text").agg(F.count("*").alias("n"))


@query("select label, list_transform(embedding, lambda x: round(x::double, 6)) as series, count(*) as n from embeddings group by all")
def s_series(spark, d):
    path = files.scratch(spark, "series")
    files.write_series(vectors(spark, d), path, "label", "s")
    x = r6(files.read_series(spark, path).select("label", "series"))
    # a grouping key loses the sign of zero, so the series is taken from a row of the group
    return x.groupBy("label", F.col("series").alias("key")).agg(F.first("series").alias("series"), F.count("*").alias("n")).drop("key")


@query("select (l_returnflag = 'R')::int as actual, (l_quantity > 25)::int as predicted, [round(1 - l_tax, 6), round(l_tax, 6)] as probs, count(*) as n from lineitem group by all")
def s_predictions(spark, d):
    path = files.scratch(spark, "predictions")
    p = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("actual"), (F.col("l_quantity") > 25).cast("int").alias("predicted"), F.array(1 - F.col("l_tax"), F.col("l_tax")).alias("probs"))
    files.write_prediction_text(p, path, "lineitem", "threshold")
    return r6(files.read_predictions(spark, path).select("actual", "predicted", "probs")).groupBy("actual", "predicted", "probs").agg(F.count("*").alias("n"))


@query("select method, dataset, fold, count(*) as n, sum(actual)::bigint as actual from (select l_linenumber as method, l_returnflag as dataset, (l_orderkey % 3)::int as fold, (l_linestatus = 'O')::int as actual from lineitem) group by all")
def s_predictions_by_method(spark, d):
    path = files.scratch(spark, "predictions")
    files.write_predictions(read(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), F.col("l_returnflag").alias("dataset"), (F.col("l_orderkey") % 3).cast("int").alias("fold"), (F.col("l_linestatus") == "O").cast("int").alias("actual")), path)
    return spark.read.parquet(path).groupBy("method", "dataset", "fold").agg(F.count("*").alias("n"), F.sum("actual").alias("actual"))


@query(SOME)
def s_load(spark, d):
    path = files.scratch(spark, "orders") + ".arff"
    files.write_arff(_some_orders(spark, d), path)
    return files.load(spark, path)


@query("select o_orderkey, o_totalprice, o_orderstatus as label from orders")
def s_label(spark, d):
    return files.set_label(read(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus")


@query("select vec_id, unnest(range(64))::int as t, unnest(list_transform(embedding, lambda x: round(x::double, 6))) as value from embeddings")
def s_reshape(spark, d):
    long = series.to_long(vectors(spark, d), "vec_id", "s")
    return r6(series.to_long(series.to_array(long, "vec_id", ["t"], "value"), "vec_id", "series"))


# --- R ---------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def r_drop_matching(spark, d):
    x = table.drop_matching(read(spark, d, "orders"), ".*(price|date|priority)")
    return table.drop_matching(x, "o_.*", invert=True)


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def r_drop_type(spark, d):
    return table.drop_type(table.drop_type(read(spark, d, "orders"), T.StringType), (T.TimestampType, T.TimestampNTZType))


@query("select o_orderkey, o_orderstatus, 1 as n from orders")
def r_drop_useless(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("same").alias("constant"), F.concat(F.lit("name"), "o_orderkey").alias("unique_name"))
    return table.drop_useless(x).withColumn("n", F.lit(1))


@query("select 'twin' as name union all select 'copy'")
def r_redundant_columns(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("twin"), F.col("o_orderstatus").alias("copy"), "o_orderpriority")
    return spark.createDataFrame([(c,) for c in table.redundant_columns(x)], "name string")


@query("select o_totalprice as price, o_orderkey as orderkey, o_orderkey as again from orders")
def r_rename(spark, d):
    x = read(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return table.rename_matching(x, "^o_(total)?", "").withColumn("again", F.col("orderkey"))


@query("select doc_id from documents where case when n_chars % 3 <> 0 then n_chars end is not null and case when n_chars % 5 <> 0 then lang end is not null")
def r_drop_missing(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.expr("case when n_chars % 3 <> 0 then n_chars end").alias("n"), F.expr("case when n_chars % 5 <> 0 then lang end").alias("lang"))
    return table.drop_missing(x, ["n", "lang"]).select("doc_id")


@query("select c_custkey, row_number() over (order by case when c_custkey % 4 <> 0 then c_acctbal end nulls last, c_custkey) as place from customer")
def r_sort(spark, d):
    x = read(spark, d, "customer").select("c_custkey", F.expr("case when c_custkey % 4 <> 0 then c_acctbal end").alias("v"))
    return table.sorted_rows(x, ["v", "c_custkey"]).select("c_custkey", "place")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 20")
def r_sub_range(spark, d):
    return table.sub_range(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 50)


@query("select o_orderkey as key, o_totalprice as amount from orders union all select c_custkey, c_acctbal from customer")
def r_union(spark, d):
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    return table.union_all(a, read(spark, d, "customer").select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("key")))


@query("select c_custkey, c_acctbal, n from customer join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def r_merge_columns(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table.merge_columns(read(spark, d, "customer").select("c_custkey", "c_acctbal"), n, "c_custkey")


@query("select o_orderkey, round(o_totalprice / 1000, 6) as o_totalprice, upper(o_orderpriority) as o_orderpriority, year(o_orderdate)::int as y from orders where o_orderstatus = 'F' and o_totalprice < 100000")
def r_pipeline(spark, d):
    x = table.apply_all(read(spark, d, "orders"), lambda t: table.filter_value(t, "o_orderstatus", labels=["F"]), lambda t: table.filter_value(t, "o_totalprice", below=100000))
    parts = {("o_totalprice",): lambda t: t.withColumn("o_totalprice", F.col("o_totalprice") / 1000), ("o_orderpriority",): lambda t: t.withColumn("o_orderpriority", F.upper("o_orderpriority")), ("o_orderdate",): lambda t: t.select("o_orderkey", F.year("o_orderdate").alias("y"))}
    return r6(table.apply_parts(x, "o_orderkey", parts))


@query("select l_orderkey, l_linenumber, abs(l_discount - l_tax) < 1e-6 as same from lineitem")
def r_roughly_equal(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", table.roughly_equal(F.col("l_discount"), F.col("l_tax")).alias("same"))


# --- X ---------------------------------------------------------------------------------------------------------------


def seeded(seed: int, *columns: str) -> str:
    """SQL of :func:`sampling.seeded`."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 15))::bigint"


@query(f"select o_orderkey, row_number() over (order by {seeded(3, 'o_orderkey')}, o_orderkey) as place from orders")
def x_randomise(spark, d):
    return sampling.random_places(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3)


@query(f"select o_orderkey, {seeded(1, 'o_orderkey')} % 1000000 < 300000 as chosen from orders")
def x_resample_and_rest(spark, d):
    x = read(spark, d, "orders").select("o_orderkey")
    part = lambda rest: sampling.resample(x, "o_orderkey", 30, invert=rest).select("o_orderkey", F.lit(not rest).alias("chosen"))
    return part(False).union(part(True))


@query("with c as (select o_orderpriority, count(*) as n from orders group by 1), t as (select sum(n) as t, count(*) as k from c) select o_orderpriority, round(0.5 * (0.4 * t / k + 0.6 * n))::bigint as n from c, t")
def x_supervised_resample(spark, d):
    x = sampling.supervised_resample(read(spark, d, "orders"), "o_orderpriority", "o_orderkey", 50, 0.4)
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"with x as (select l_orderkey * 10 + l_linenumber as id, l_discount from lineitem where l_discount > 0) select id, l_discount from x order by -ln(({seeded(1, 'id')} % 2147483647 + 1) / 2147483648) / l_discount, id limit 200")
def x_weighted_sample(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount")
    return sampling.weighted_sample(x, "id", "l_discount", 200)


@query("select o_orderstatus, sum((o_orderkey % 4 > 0)::int)::bigint as train, sum((o_orderkey % 4 = 0)::int)::bigint as test from orders group by 1")
def x_resample_split(spark, d):
    x = sampling.resample_split(read(spark, d, "orders").withColumn("is_train", F.col("o_orderkey") % 4 > 0), "o_orderstatus", "o_orderkey", "is_train", 5)
    return x.groupBy("o_orderstatus").agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query("with c as (select o_orderstatus, count(*) as n from orders group by 1) select o_orderstatus, greatest(1, round(300 * n / (select count(*) from orders)))::bigint as n from c")
def x_stratified_amount(spark, d):
    return sampling.stratified_amount(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 300).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("with c as (select label, count(*) as n from embeddings group by 1) select label, ceil(n * 0.6)::bigint as train, (n - ceil(n * 0.6))::bigint as test, 4::int as channels from c")
def x_multivariate(spark, d):
    x = series.to_channels(vectors(spark, d), "s", 16)
    s = sampling.train_test(x, "label", "vec_id", 0.6)
    return s.groupBy("label").agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"), F.max(F.size("channels")).alias("channels"))


@query("""with c as (select l_returnflag as f, l_linenumber as k, l_linestatus as s, count(*) as n from lineitem group by all), m as (select f, k, arg_max(s, (n, s)) as s from c group by all)
select f as l_returnflag, k as l_linenumber, s as l_linestatus, n from c join m using (f, k, s)""")
def x_remove_misclassified(spark, d):
    from ..operators import models

    x = read(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus")
    predict = lambda t: t.join(models.decision_table(t, ["l_returnflag", "l_linenumber"], "l_linestatus"), ["l_returnflag", "l_linenumber"])
    return sampling.remove_misclassified(x, "l_linestatus", predict).groupBy("l_returnflag", "l_linenumber", "l_linestatus").agg(F.count("*").alias("n"))


@query("select vec_id, len(list_filter(embedding, lambda x: x > 0))::int as entries, list_transform(embedding, lambda x: case when x > 0 then round(x::double, 6) else 0.0 end) as dense from embeddings")
def x_sparse_dense(spark, d):
    x = vectors(spark, d).select("vec_id", F.transform("s", lambda v: F.greatest(v, F.lit(0.0))).alias("s"))
    m = x.select("vec_id", sampling.to_sparse(F.col("s")).alias("m"))
    return r6(m.select("vec_id", F.size("m").alias("entries"), sampling.to_dense(F.col("m"), 64).alias("dense")))


SMOTE = """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as s from embeddings where label = 3),
n as (select a.vec_id as q, a.s as a, b.s as b, row_number() over (partition by a.vec_id order by list_sum(list_transform(range(1, 65), lambda i: power(a.s[i] - b.s[i], 2))), b.vec_id) as rank from v a, v b where a.vec_id <> b.vec_id),
p as (select vec_id as q, unnest(range(1, {per} + 1)) as i from v), m as (select a, b, {u} % 10000 / 10000.0::double as u from p join n on n.q = p.q and n.rank = {r} % 5 + 1)"""
SMOTE = SMOTE.replace("{u}", seeded(2, "p.q", "i")).replace("{r}", seeded(1, "p.q", "i"))


@query(SMOTE.replace("{per}", "1") + " select 3::int as label, count(*) as n, round(sum(a[1] + u * (b[1] - a[1])), 5) as first from m")
def x_smote_counts(spark, d):
    made = sampling.smote(vectors(spark, d), "label", 3, "vec_id", "s", 100)
    return made.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("s")[0]), 5).alias("first"))


# --- C: further column transforms ------------------------------------------------------------------------------------


@query("select p_partkey, round(sqrt(p_retailprice), 6) as p_retailprice, round(sqrt(p_size), 6) as p_size from part")
def c_unary(spark, d):
    return r6(columns.apply_unary(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], "sqrt"))


@query("select p_partkey, round(p_retailprice - (select avg(p_retailprice) from part), 6) as p_retailprice from part")
def c_center(spark, d):
    x = read(spark, d, "part").select("p_partkey", "p_retailprice")
    return r6(columns.Standardizer(["p_retailprice"], "center").fit(x).transform(x))


@query("select vec_id, list_transform(embedding, lambda x: round(2 * x::double / pow(list_sum(list_transform(embedding, lambda y: pow(abs(y::double), 3))), 1.0 / 3), 6)) as s from embeddings")
def c_row_norm(spark, d):
    return r6(vectors(spark, d).select("vec_id", columns.normalise_row(F.col("s"), 3.0, 2.0).alias("s")))


@query("with x as (select p_partkey, p_size, p_retailprice, p_partkey % 5 = 0 as test from part), t as (select min(p_size) as a, max(p_size) as b, avg(p_retailprice) as m, stddev_samp(p_retailprice) as s from x where not test) select p_partkey, round((p_size - a) / (b - a), 6) as p_size, round((p_retailprice - m) / s, 6) as p_retailprice from x, t where test")
def c_fit_then_apply(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    train, test = x.where("p_partkey % 5 <> 0"), x.where("p_partkey % 5 = 0")
    return r6(columns.Standardizer(["p_retailprice"]).fit(train).transform(columns.Standardizer(["p_size"], "range").fit(train).transform(test)))


@query("select (least(greatest(ceil((p_size - a) / ((b - a) / 5.0)) - 1, 0), 4))::int as bin, count(*) as n from part, (select min(p_size) as a, max(p_size) as b from part) group by 1")
def c_equal_width_five(spark, d):
    x = read(spark, d, "part")
    return x.select(columns.bin_of(F.col("p_size"), columns.equal_width_cuts(x, "p_size", 5)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderkey::varchar as as_text, case o_orderstatus when 'F' then 0.0 when 'O' then 1.0 when 'P' then 2.0 end as status, case o_orderstatus when 'F' then 'F' when 'O' then 'O' when 'P' then 'P' end as back from orders")
def c_types(spark, d):
    x = columns.to_text(read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("as_text"), "o_orderstatus"), ["as_text"])
    labels = columns.label_list(x, "o_orderstatus")
    coded = columns.nominal_to_numeric(x, "o_orderstatus", labels, "status")
    return columns.numeric_to_nominal(coded, "status", labels, "back").drop("o_orderstatus")


@query("select l_orderkey, l_linenumber, (l_discount <> 0)::int as l_discount from lineitem")
def c_to_binary(spark, d):
    return columns.to_binary(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ["l_discount"])


@query("with m as (select p_brand, row_number() over (order by avg(p_retailprice), p_brand) - 1 as r from part group by 1) select p_partkey, (r >= 1)::int as first, (r >= (select max(r) from m))::int as last from part join m using (p_brand)")
def c_supervised_one_hot(spark, d):
    x = columns.supervised_one_hot(read(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice")
    steps = [c for c in x.columns if c.startswith("p_brand>")]
    return x.select("p_partkey", F.col(f"`{steps[0]}`").alias("first"), F.col(f"`{steps[-1]}`").alias("last"))


@query("select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' else o_orderpriority end as o_orderpriority from orders")
def c_merge_labels(spark, d):
    return columns.merge_labels(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"], "high")


@query("with c as (select o_orderpriority, row_number() over (order by count(*) desc, o_orderpriority) - 1 as place from orders group by 1) select o_orderkey, place::int as by_count, (dense_rank() over (order by o_orderpriority) - 1)::int as by_name, case o_orderpriority when '1-URGENT' then '5-LOW' when '5-LOW' then '1-URGENT' else o_orderpriority end as swapped from orders join c using (o_orderpriority)")
def c_label_order(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    by_count, by_name = columns.label_list(x, "o_orderpriority", "count"), columns.label_list(x, "o_orderpriority")
    place = lambda labels: columns.label_place(F.col("o_orderpriority"), labels)
    return x.select("o_orderkey", place(by_count).alias("by_count"), place(by_name).alias("by_name"), columns.swap_labels(F.col("o_orderpriority"), "1-URGENT", "5-LOW").alias("swapped"))


@query("select doc_id, coalesce(case when n_chars % 3 <> 0 then n_chars end, -1) as n, coalesce(case when n_chars % 5 <> 0 then lang end, 'none') as lang from documents")
def c_impute_constant(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.expr("case when n_chars % 3 <> 0 then n_chars end").alias("n"), F.expr("case when n_chars % 5 <> 0 then lang end").alias("lang"))
    return columns.impute_constant(x, {"n": -1, "lang": "none"})


@query("""with x as (select event_id, user_id, ts, case when event_id % 4 <> 0 then value end as v from events), y as (select *, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b, first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as a from x)
select event_id, round(coalesce(v, (b + a) / 2, b, a), 6) as value from y""")
def c_impute_neighbours(spark, d):
    x = read(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("t"), F.expr("case when event_id % 4 <> 0 then value end").alias("value"))
    return r6(columns.impute_neighbours(x, "user_id", "t", "value").select("event_id", "value"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%d/%m/%Y') as day from orders")
def c_date_format(spark, d):
    x = read(spark, d, "orders")
    return x.select("o_orderkey", columns.date_text(F.col("o_orderdate"), "yyyy-MM").alias("month"), columns.date_text(F.col("o_orderdate"), "dd/MM/yyyy").alias("day"))


@query("""select o_orderkey, 'V' || dense_rank() over (order by o_orderpriority) as "A1", 'V' || dense_rank() over (order by o_orderstatus) as "A2" from orders""")
def c_obfuscate(spark, d):
    return columns.obfuscate(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


@query(f"""with l as (select list(distinct o_orderstatus order by o_orderstatus) as l from orders), x as (select o_orderkey, o_orderstatus, {seeded(1, 'o_orderkey')} as u, {seeded(2, 'o_orderkey')} as p, list_filter(l, lambda v: v <> o_orderstatus) as others from orders, l)
select o_orderkey, case when u % 10000 / 100 < 10 then others[p % len(others) + 1] else o_orderstatus end as o_orderstatus from x""")
def c_label_noise(spark, d):
    return columns.label_noise(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 10, "o_orderkey")


@query("select vec_id, list_transform(range(1, 64), lambda i: round(embedding[i]::double - embedding[i + 1]::double, 6)) as d from embeddings")
def c_first_order(spark, d):
    return r6(vectors(spark, d).select("vec_id", series.differences(F.col("s"), 1).alias("d")))


@query()
def c_latent_semantics(spark, d):
    return r6(columns.latent_semantics(vectors(spark, d), "vec_id", "s", 64, 5).select("vec_id", F.transform("scores", F.abs).alias("scores")))


@query("""with m as (select avg(l_quantity) as mq, avg(l_discount) as md, avg(l_tax) as mt, covar_pop(l_quantity, l_extendedprice) as a, covar_pop(l_discount, l_extendedprice) as b, covar_pop(l_tax, l_extendedprice) as c from lineitem),
t as (select l_orderkey * 10 + l_linenumber as id, l_quantity - mq as q, l_discount - md as d, l_tax - mt as x, l_extendedprice as y, (a * (l_quantity - mq) + b * (l_discount - md) + c * (l_tax - mt)) / sqrt(a * a + b * b + c * c) as t from lineitem, m),
p as (select sum(q * t) / sum(t * t) as pq, sum(d * t) / sum(t * t) as pd, sum(x * t) / sum(t * t) as px, avg(y) as my from t), r as (select id, t, q - t * pq as q, d - t * pd as d, x - t * px as x, y - my as y from t, p), w as (select sum(q * y) as wq, sum(d * y) as wd, sum(x * y) as wx from r)
select id, round(t, 5) as first, round(abs(q * wq + d * wd + x * wx) / sqrt(wq * wq + wd * wd + wx * wx), 5) as second from r, w""")
def c_partial_least_squares(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return columns.partial_least_squares(x, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2).select("id", (F.round(F.col("scores")[0], 5) + 0.0).alias("first"), (F.round(F.abs(F.col("scores")[1]), 5) + 0.0).alias("second"))


@query(f"select vec_id, list_transform({columns.projection_matrix(10, 64).round(12).tolist()}, lambda w: round(list_sum(list_transform(range(1, 65), lambda i: w[i] * embedding[i]::double)), 6)) as p from embeddings")
def c_random_projection(spark, d):
    return r6(vectors(spark, d).select("vec_id", columns.random_projection(F.col("s"), 10, 64).alias("p")))


@query("select l_orderkey, l_linenumber, l_tax, l_quantity from lineitem")
def c_random_columns(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return columns.random_columns(x, 2, keep=["l_orderkey", "l_linenumber"], seed=1)


# The pair of groups of least chi-squared value merges while that is under the 0.05 point of one degree of freedom.
@query("""with recursive c as (select l_linenumber::varchar as v, sum((l_quantity > 25)::int) as a, sum((l_quantity <= 25)::int) as b from lineitem group by 1), t(step, v, g, a, b) as (select 0, v, v, a, b from c union all
select t.step + 1, t.v, case when t.g = m.m.h then m.m.g else t.g end, t.a, t.b from t, (select arg_min({'g': g, 'h': h}, x) as m, min(x) as x from (select p.g, q.g as h, (p.a + p.b + q.a + q.b) * power(p.a * q.b - p.b * q.a, 2) / ((p.a + p.b) * (q.a + q.b) * (p.a + q.a) * (p.b + q.b)) as x
  from (select g, sum(a)::double as a, sum(b)::double as b from t group by 1) p, (select g, sum(a)::double as a, sum(b)::double as b from t group by 1) q where p.g < q.g) having count(*) > 1 and min(x) < 3.841458820694124) m),
e as (select v, g from t where step = (select max(step) from t)), n as (select g, string_agg(v, '_or_' order by v) as l_linenumber from e group by 1)
select n.l_linenumber, l_quantity > 25 as large, count(*) as n from lineitem join e on e.v = l_linenumber::varchar join n using (g) group by all""")
def c_chaid_kept(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("l_linenumber"), (F.col("l_quantity") > 25).alias("large"))
    return columns.merge_by_chaid(x, "l_linenumber", "large").groupBy("l_linenumber", "large").agg(F.count("*").alias("n"))
