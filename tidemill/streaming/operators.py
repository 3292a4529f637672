"""Streaming forms: stateless operators are the batch functions; these keep state by key, by aggregate, or in written tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import scratch


def row_source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now and return what it wrote: appended rows, or the last full result (complete)."""
    spark = stream.sparkSession
    path, state = scratch(spark, "stream"), scratch(spark, "state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:08d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last:08d}")


def delta(stream: DataFrame, key: str, order: str, value: str, offset: int = 1, forget: str | None = None) -> DataFrame:
    """(key, order, value, delta): value less the one ``offset`` arrivals before in the key; the last values are the state.

    With ``forget`` (a duration) a key that stays away that long loses its state.
    """

    def step(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        held = np.asarray(state.get[0] if state.exists else [], float)
        v = rows[value].to_numpy(float)
        all_ = np.r_[held, v]
        gap = np.full(len(v), np.nan)
        known = np.arange(len(v)) + len(held) >= offset
        gap[known] = v[known] - all_[np.flatnonzero(known) + len(held) - offset]
        state.update((all_[-offset:].tolist(),))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: v, "delta": [None if np.isnan(x) else x for x in gap]})

    kinds = dict(stream.dtypes)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, delta double", "held array<double>", "append", timeout)


def class_statistics(stream: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Sufficient statistics of an updateable naive Bayes model, kept by a streaming aggregate."""
    return stream.groupBy(label).agg(F.count("*").alias("n"), *(x for c in columns for x in (F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sq"))))


def class_model(statistics: DataFrame, label: str, columns: list[str], least_sd: float = 1e-3) -> DataFrame:
    """(label, n, means and deviations) of a table of :func:`class_statistics`."""
    def sd(c: str):
        var = (F.col(f"{c}_sq") - F.col(f"{c}_sum") * F.col(f"{c}_sum") / F.col("n")) / (F.col("n") - 1)
        return F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(least_sd)).alias(f"{c}_sd")

    return statistics.select(label, "n", *(x for c in columns for x in ((F.col(f"{c}_sum") / F.col("n")).alias(f"{c}_mean"), sd(c))))


def term_statistics(stream: DataFrame, label: str, words) -> DataFrame:
    """(label, term, n): word counts of an updateable multinomial model."""
    return stream.select(label, F.explode(words).alias("term")).groupBy(label, "term").agg(F.count("*").alias("n"))


def value_statistics(stream: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, value, n): counts of an updateable discrete estimator."""
    return stream.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class TableState:
    """A small table that micro-batches replace: version n is written by batch n, so a batch that runs again writes the same one."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None):
        self.spark, self.schema, self.path = spark, schema, path or scratch(spark, "held")

    def _versions(self) -> list[int]:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        done = lambda p: fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if done(s.getPath())) if fs.exists(path) else []

    def before(self, number: int | None = None) -> DataFrame:
        """The last version, or the last one before a batch."""
        known = [v for v in self._versions() if number is None or v < number]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{known[-1]:08d}")

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{number:08d}")


def feed(stream: DataFrame, step) -> None:
    """Give every micro-batch of what the source has now to ``step(batch, number)``."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", scratch(stream.sparkSession, "state")).trigger(availableNow=True).start()
    q.awaitTermination()


def reservoir_sink(k: int, id_col: str, seed: int, state: TableState):
    """A foreachBatch function that keeps the k rows of smallest hash in a written table: equal to the batch reservoir over all rows so far,
    and whole again after a restart."""
    from ..operators.sampling import reservoir

    def step(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        state.write(reservoir(held.unionByName(batch.select(*held.columns)), id_col, k, seed), number)

    return step


def recent_sink(size: int, order: list[str], state: TableState):
    """Keeps the ``size`` most recent rows: the memory of an instance-based learner."""

    def step(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        state.write(held.unionByName(batch.select(*held.columns)).orderBy(*(F.desc(c) for c in order)).limit(size), number)

    return step


def recent_neighbours(held: DataFrame, queries: DataFrame, id_col: str, features: str, label: str, k: int = 1) -> DataFrame:
    """(query, actual, predicted): the vote of the k nearest rows of ``held`` (a state of :func:`recent_sink`) other than the query itself."""
    from ..operators.distances import knn_join, vote

    return vote(knn_join(queries, held, k, id_col, features, label))


def gradient_sink(columns: list[str], target: str, rate: float, state: TableState, loss: str = "squared"):
    """One gradient step a micro-batch of a linear model; the gradient is one aggregate over the batch. ``state``: (i int, w double), the last is the bias.

    Loss: squared, log (target 0 or 1) or hinge (target -1 or 1).
    """

    def step(batch: DataFrame, number: int) -> None:
        held = {r.i: r.w for r in state.before(number).collect()}
        w = [held.get(i, 0.0) for i in range(len(columns) + 1)]
        x = [*(F.col(c) for c in columns), F.lit(1.0)]
        z = sum((v * float(a) for v, a in zip(x, w, strict=True)), F.lit(0.0))
        y = F.col(target).cast("double")
        slope = {"squared": z - y, "log": 1 / (1 + F.exp(-z)) - y, "hinge": F.when(y * z < 1, -y).otherwise(0.0)}[loss]
        known = batch.where(" and ".join(f"`{c}` is not null" for c in [*columns, target]))
        g = known.agg(*(F.avg(slope * v).alias(f"g{i}") for i, v in enumerate(x))).first()
        rows = [(i, float(a - rate * (g[f"g{i}"] or 0.0))) for i, a in enumerate(w)]
        state.write(state.spark.createDataFrame(rows, state.schema), number)

    return step


def per_class_gradients(columns: list[str], label: str, classes: list, rate: float, states: dict):
    """One updateable log-loss model a class against the rest: ``states`` has a :class:`TableState` for each class."""
    steps = {c: gradient_sink(columns, "__y", rate, states[c], "log") for c in classes}

    def step(batch: DataFrame, number: int) -> None:
        for c, s in steps.items():
            s(batch.withColumn("__y", (F.col(label) == c).cast("double")), number)

    return step


def raced_rules(columns: list[str], label: str, state: TableState, most: int = 10):
    """A committee of decision tables: a batch judges the committee's members, the worst over ``most`` goes, and the batch's own table joins.

    ``state``: (member int, pattern string, predicted string, score double), one row a member and pattern.
    """
    key = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns))

    def step(batch: DataFrame, number: int) -> None:
        x = batch.select(key.alias("pattern"), F.col(label).cast("string").alias("__y"))
        held = state.before(number)
        hit = held.join(x, "pattern").groupBy("member").agg(F.avg((F.col("predicted") == F.col("__y")).cast("double")).alias("now"))
        judged = held.join(hit, "member", "left").withColumn("score", F.coalesce("now", "score")).drop("now")
        own = x.groupBy("pattern", "__y").count().groupBy("pattern").agg(F.min_by("__y", F.struct(-F.col("count"), "__y")).alias("predicted"))
        score = x.join(own, "pattern").agg(F.avg((F.col("predicted") == F.col("__y")).cast("double"))).first()[0]
        both = judged.select("member", "pattern", "predicted", "score").unionByName(own.select(F.lit(number).alias("member"), "pattern", "predicted", F.lit(score).alias("score")))
        keep = both.select("member", "score").distinct().orderBy(F.desc("score"), "member").limit(most).select("member")
        state.write(both.join(F.broadcast(keep), "member", "left_semi").select("member", "pattern", "predicted", "score"), number)

    return step


def committee_vote(members: DataFrame, rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, predicted): votes of the members weighted by their scores."""
    key = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns))
    v = rows.select(F.col(id_col).alias("id"), key.alias("pattern")).join(members, "pattern").groupBy("id", "predicted").agg(F.sum("score").alias("v"))
    return v.groupBy("id").agg(F.min_by("predicted", F.struct(-F.round("v", 9), "predicted")).alias("predicted"))


def hoeffding_bound(n, classes: int, delta: float = 1e-7):
    """How far a mean gain of ``n`` rows can be from the true one, at confidence 1 - delta."""
    return F.sqrt(F.lit(np.log2(max(2, classes)) ** 2 * np.log(1 / delta)) / (2 * n))


def hoeffding_sink(columns: list[str], label: str, classes: int, state: TableState, grace: int = 200, delta: float = 1e-7, tie: float = 0.05):
    """A tree over nominal columns grown a micro-batch at a time: rows are routed by the broadcast tree, leaf statistics are one aggregate, and a
    leaf splits where its best column leads the next by the Hoeffding bound (or both are within ``tie``).

    ``state``: (leaf string, attribute string, value string, class string, n long); a leaf is its path ``a=v`` joined by "/"; an inner node
    has a row with class null and its column as attribute.
    """
    from ..operators.scoring import contingency, entropy_scores

    def route(batch: DataFrame, splits: DataFrame) -> DataFrame:
        # a path tests a column once, as a leaf's rows are equal in the columns above it
        batch, value = batch.withColumn("leaf", F.lit("")), F.lit(None)
        for c in columns:
            value = F.when(F.col("__by") == c, F.coalesce(F.col(c).cast("string"), F.lit("?"))).otherwise(value)
        grown = F.concat(F.when(F.col("leaf") == "", "").otherwise(F.concat("leaf", F.lit("/"))), "__by", F.lit("="), value)
        for _ in columns:
            batch = batch.join(F.broadcast(splits), F.col("leaf") == F.col("__leaf"), "left").withColumn("leaf", F.coalesce(grown, "leaf")).drop("__leaf", "__by")
        return batch

    def step(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        splits = held.where("class is null")
        routed = route(batch, splits.select(F.col("leaf").alias("__leaf"), F.col("attribute").alias("__by")))
        long = routed.unpivot([F.col("leaf"), F.col(label).cast("string").alias("class")], [F.col(c).cast("string").alias(c) for c in columns], "attribute", "value")
        new = long.where("value is not null and class is not null").groupBy("leaf", "attribute", "value", "class").agg(F.count("*").alias("n"))
        counts = held.where("class is not null").unionByName(new).groupBy("leaf", "attribute", "value", "class").agg(F.sum("n").alias("n"))
        counts = counts.persist()
        marked = counts.select(F.concat_ws("\x01", "leaf", "attribute").alias("attribute"), "value", F.col("class").alias("label"), "n")
        gains = entropy_scores(marked).select(F.split("attribute", "\x01")[0].alias("leaf"), F.split("attribute", "\x01")[1].alias("attribute"), "info_gain")
        size = counts.groupBy("leaf", "attribute").agg(F.sum("n").alias("m")).groupBy("leaf").agg(F.max("m").alias("m"))
        two = gains.join(size, "leaf").groupBy("leaf", "m").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("info_gain", "attribute")))), 1, 2).alias("t"))
        first, second = F.col("t")[0], F.coalesce(F.get("t", F.lit(1))["info_gain"], F.lit(0.0))
        bound = hoeffding_bound(F.col("m"), classes, delta)
        ready = two.where((F.col("m") >= grace) & (first["info_gain"] > 0) & ((first["info_gain"] - second > bound) | (bound < tie))).select("leaf", first["attribute"].alias("attribute")).collect()
        inner = splits.unionByName(state.spark.createDataFrame([(r.leaf, r.attribute, None, None, 0) for r in ready], state.schema))
        rest = counts.where(~F.col("leaf").isin([r.leaf for r in ready])) if ready else counts
        state.write(rest.select("leaf", "attribute", "value", "class", "n").unionByName(inner), number)
        counts.unpersist()

    return step


def category_utility(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """(utility): how much better a grouping foretells nominal values than the table does, over the number of groups."""
    n = df.count()
    long = df.unpivot([F.col(cluster).alias("g")], [F.col(c).cast("string").alias(c) for c in columns], "attribute", "value")
    own = long.groupBy("g", "attribute", "value").agg(F.count("*").alias("k"))
    size = df.groupBy(F.col(cluster).alias("g")).agg(F.count("*").alias("m"))
    inside = own.join(F.broadcast(size), "g").agg(F.sum(F.col("k") * F.col("k") / F.col("m")).alias("inside"))
    every = own.groupBy("attribute", "value").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k") / n).alias("outside"))
    groups = size.agg(F.count("*").alias("groups"))
    return inside.join(F.broadcast(every)).join(F.broadcast(groups)).select(((F.col("inside") - F.col("outside")) / n / F.col("groups")).alias("utility"))


def _category_choice(pattern: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """(p, w, c, opens): for each pattern the cluster of most category utility, and whether one of its own would have more."""
    k = held.where("column = ''").select("cluster", F.col("n").alias("size"))
    squares = held.where("column <> ''").groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    clusters = k.join(squares, "cluster").withColumn("s", F.col("q") / F.col("size"))
    whole = clusters.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all"), F.count("*").alias("k")).first()
    parts = pattern.select("p", "w", F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("p").alias("value"))).alias("x")).select("p", "w", "x.*")
    same = parts.join(held, ["column", "value"]).groupBy("p", "w", "cluster").agg(F.sum("n").alias("hit"))
    each = pattern.join(F.broadcast(clusters)).join(same, ["p", "w", "cluster"], "left").na.fill(0.0, ["hit"])
    m = float(len(columns))
    grown = (F.col("q") + 2 * F.col("w") * F.col("hit") + m * F.col("w") * F.col("w")) / (F.col("size") + F.col("w"))
    utility = F.round((whole["all"] - F.col("s") + grown) / max(1, whole["k"]), 9)
    choice = each.select("p", F.struct((-utility).alias("u"), F.col("cluster").alias("c")).alias("o")).groupBy("p").agg(F.min("o").alias("o"))
    own = F.round((whole["all"] + m * F.col("w")) / (whole["k"] + 1), 9)
    return pattern.join(choice, "p", "left").select("p", "w", F.col("o.c").alias("c"), (F.col("o").isNull() | (own > -F.col("o.u"))).alias("opens"))


def category_sink(columns: list[str], state: TableState):
    """Clusters of nominal rows that grow with the stream. Equal rows of a batch are one pattern; while patterns would rather open a cluster, the one of
    most rows (ties by its values) does, and the rest are judged anew; then all join the clusters of most category utility at once.

    ``state``: (cluster long, column string, value string, n double), one row a cluster, column and value; the row of column "" has the cluster's size.
    Category utility is ((sum over clusters of squared counts / size) - a part that no choice changes) / number of clusters. Nulls are a value of
    their own. The state is as large as there are different clusters and values.
    """

    def rows_of(told: DataFrame) -> DataFrame:
        pairs = F.concat(F.array(F.struct(F.lit("").alias("column"), F.lit("").alias("value"))), F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("p").alias("value")))
        return told.select("c", "w", F.explode(pairs).alias("x")).select(F.col("c").cast("long").alias("cluster"), "x.column", "x.value", F.col("w").alias("n"))

    def step(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
        path = scratch(state.spark, "patterns")
        batch.select(F.array(*(value(c) for c in columns)).alias("p")).groupBy("p").agg(F.count("*").cast("double").alias("w")).write.parquet(path)
        left, opened = state.spark.read.parquet(path), []
        while True:
            now = held.unionByName(rows_of(state.spark.createDataFrame(opened, "p array<string>, w double, c long"))) if opened else held
            judged = _category_choice(left, now, columns)
            first = judged.where("opens").orderBy(F.desc("w"), "p").limit(1).collect()
            if not first:
                break
            last = now.agg(F.coalesce(F.max("cluster"), F.lit(-1)).alias("c")).first().c
            opened.append((list(first[0].p), first[0].w, last + 1))
            left = left.where(F.col("p") != F.array(*map(F.lit, first[0].p)))
        more = now.unionByName(rows_of(judged.select("p", "w", "c")))
        state.write(more.groupBy("cluster", "column", "value").agg(F.sum("n").alias("n")), number)

    return step


def category_clusters(rows: DataFrame, columns: list[str], held: DataFrame) -> DataFrame:
    """``rows`` with ``cluster``: the cluster of ``held`` (a state of :func:`category_sink`) with the most matched counts a member, the smaller on ties."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    size = held.where("column = ''").select("cluster", F.col("n").alias("size"))
    patterns = rows.select(F.array(*(value(c) for c in columns)).alias("__p")).distinct()
    parts = patterns.select("__p", F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("__p").alias("value"))).alias("x")).select("__p", "x.*")
    hit = parts.join(held, ["column", "value"]).groupBy("__p", "cluster").agg(F.sum("n").alias("hit")).join(size, "cluster")
    best = hit.groupBy("__p").agg(F.min(F.struct((-F.round(F.col("hit") / F.col("size"), 9)).alias("u"), "cluster")).alias("b")).select("__p", F.col("b.cluster").alias("cluster"))
    return rows.withColumn("__p", F.array(*(value(c) for c in columns))).join(best, "__p", "left").drop("__p")
