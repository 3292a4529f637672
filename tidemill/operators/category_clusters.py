"""Clusters of counted words and of item sets: reassignment by information lost, and by the profit of shared items.

A step moves one share of the rows (by a seeded hash), all at once, against the clusters as they stand; then the clusters are summed again. So a
step is a join and two aggregates, and no more rows move against stale clusters than a share holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import _written
from .sampling import seeded

#: Words in most documents whose sums each task holds, and the words of a document in one row of their lists.
HELD, PIECE = 1 << 18, 1024


def _dealt(df: DataFrame, id_col: str, parts: int, seed: int) -> DataFrame:
    return df.withColumn("part", F.pmod(seeded(seed, id_col), F.lit(parts)).cast("int"))


def _split_words(p: DataFrame, held: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows of ``p`` (doc, word, p) by how many documents have the word, and how many words are held: (doc, ids, ps) of the ``held`` words of most
    documents, ``PIECE`` words a row; (doc, word, p) of the others; (doc, single), the sum over words that no other document has."""
    spread = _written(p.groupBy("word").agg(F.count("*").alias("docs")), "spread")
    top = spread.where("docs > 1").orderBy(F.desc("docs"), "word").limit(held)
    top = _written(top.select("word", (F.row_number().over(Window.orderBy(F.desc("docs"), "word")) - 1).alias("id")), "held")
    lists = p.join(F.broadcast(top), "word").groupBy("doc").agg(F.collect_list(F.struct("id", "p")).alias("c"))
    lists = lists.select("doc", F.explode(F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(PIECE)), lambda i: F.slice("c", i, F.lit(PIECE)))).alias("c"))
    rest = p.join(F.broadcast(top), "word", "left_anti").join(spread, "word")
    rest = _written(rest, "rest")
    single = _written(rest.where("docs = 1").groupBy("doc").agg(F.sum("p").alias("single")), "single")
    return _written(lists.select("doc", F.col("c.id").alias("ids"), F.col("c.p").alias("ps")), "lists"), rest.where("docs > 1").select("doc", "word", "p"), single, top.count()


def _held_sums(lists: DataFrame, now: DataFrame, k: int, each: float, held: int) -> np.ndarray:
    """The sums of p * each of every held word (a row) and cluster."""

    def run(batches):
        sums = np.zeros(held * k)
        for b in batches:
            ids, ps = (b.column(c).flatten().to_numpy() for c in ("ids", "ps"))
            own = np.repeat(b.column("cluster").to_numpy(), b.column("ids").value_lengths().to_numpy())
            sums += np.bincount(ids.astype(np.int64) * k + own, ps * each, held * k)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "q"])

    out = np.zeros(held * k)
    if held:
        got = lists.join(now.select("doc", "cluster"), "doc").mapInArrow(run, "at long, q double").groupBy("at").agg(F.sum("q").alias("q")).toPandas()
        out[got["at"].to_numpy()] = got["q"].to_numpy()
    return out.reshape(held, k)


def _held_parts(lists: DataFrame, mine: DataFrame, k: int, each: float, sizes: dict[int, int], sums: np.ndarray) -> DataFrame:
    """(doc, cluster, i0, s0, i1, ...) of the pieces of the documents in ``mine``, as :func:`information_clusters` sums them over words."""
    sent = lists.sparkSession.sparkContext.broadcast(sums)
    names = [f"{c}{t}" for t in range(k) for c in "is"]

    def run(batches):
        for b in batches:
            ids, ps = (b.column(c).flatten().to_numpy() for c in ("ids", "ps"))
            ends = np.r_[0, np.cumsum(b.column("ids").value_lengths().to_numpy())]
            cluster = b.column("cluster").to_numpy()
            out = np.zeros((2 * k, len(cluster)))
            for lo in range(0, len(cluster), 256):
                hi = min(lo + 256, len(cluster))
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                i, p, own = ids[ends[lo] : ends[hi]], ps[ends[lo] : ends[hi]], cluster[lo:hi][row]
                for t in range(k):
                    is_own = (own == t).astype(float)
                    mass = (sizes.get(t, 0) - is_own) * each
                    with np.errstate(all="ignore"):  # a cluster without mass costs nothing
                        q = np.maximum(sent.value[i, t] - is_own * p * each, 0.0) / mass
                        x, y = each / (mass + each), mass / (mass + each)
                        m = x * p + y * q
                        v = x * p * np.log(p / m) + np.where(q > 1e-15, y * q * np.log(q / m), 0.0)
                    out[2 * t, lo:hi], out[2 * t + 1, lo:hi] = (np.bincount(row, np.where(mass > 0, z, 0.0), hi - lo) for z in (v, q))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("cluster"), *(pa.array(c) for c in out)], ["doc", "cluster", *names])

    return lists.join(mine, "doc").mapInArrow(run, f"doc {dict(lists.dtypes)['doc']}, cluster int, " + ", ".join(f"{c} double" for c in names))


def information_clusters(terms: DataFrame, k: int, sweeps: int = 15, parts: int = 4, seed: int = 1, least_change: int = 0, held: int = HELD) -> tuple[DataFrame, list[float]]:
    """(doc, cluster) and the mutual information of clusters and words after each sweep.

    ``terms``: (doc, word, n), n over 0. Every document weighs the same and is the distribution of its words. It starts in a cluster by hash and moves to the
    one where it costs least: the weights of both times the Jensen-Shannon divergence of their distributions, its own cluster taken without it
    (an empty one costs nothing; ties to the smaller number). Sweeps end when no more than ``least_change`` documents move. Documents without a word are left out.
    The ``held`` words of most documents are numbers in lists, their sums an array in each task; the others meet their sums by a join. A word of one document
    is in no cluster but by that document, so it needs no sums.
    """
    rows = terms.where("doc is not null and word is not null and n > 0")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("doc"))
    p = _written(rows.groupBy("doc", "word").agg(F.sum("n").cast("double").alias("n")).select("doc", "word", share.alias("p")), "shares")
    docs = p.select("doc").distinct()
    count = docs.count()
    now = _written(_dealt(docs, "doc", parts, seed).withColumn("cluster", F.pmod(seeded(seed + 1, "doc"), F.lit(k)).cast("int")), "clusters")
    if not count:
        return now.select("doc", "cluster"), []
    each, known = 1.0 / count, []
    lists, rare, single, n_held = _split_words(p, held)

    def sums(now: DataFrame) -> tuple[np.ndarray, DataFrame, dict[int, int]]:
        q = [F.sum(F.when(F.col("cluster") == t, F.col("p") * each).otherwise(0.0)).alias(f"q{t}") for t in range(k)]
        words = _written(rare.join(now.select("doc", "cluster"), "doc").groupBy("word").agg(*q), "words")
        return _held_sums(lists, now, k, each, n_held), words, {r.cluster: r["count"] for r in now.groupBy("cluster").count().collect()}

    state = sums(now)
    for _ in range(sweeps):
        moved = 0
        for part in range(parts):
            frequent, words, sizes = state
            mine = now.where(F.col("part") == part).select("doc", "cluster")
            rest, alone = [], []
            for t in range(k):
                own = (F.col("cluster") == t).cast("int")
                mass = (F.lit(sizes.get(t, 0)) - own) * each
                q = F.greatest(F.col(f"q{t}") - own * F.col("p") * each, F.lit(0.0)) / mass
                a, b = each / (mass + each), mass / (mass + each)
                m = a * F.col("p") + b * q
                part_of = a * F.col("p") * F.log(F.col("p") / m) + F.when(q > 1e-15, b * q * F.log(q / m)).otherwise(0.0)
                rest += [F.sum(F.when(mass > 0, part_of).otherwise(0.0)).alias(f"i{t}"), F.sum(F.when(mass > 0, q).otherwise(0.0)).alias(f"s{t}")]
                alone += [(-a * F.log(a) * F.col("single")).alias(f"i{t}"), F.lit(0.0).alias(f"s{t}")]
            every = rare.join(mine, "doc").join(words, "word").groupBy("doc", "cluster").agg(*rest).unionByName(single.join(mine, "doc").select("doc", "cluster", *alone))
            every = every.unionByName(_held_parts(lists, mine, k, each, sizes, frequent))
            total = every.groupBy("doc", "cluster").agg(*(F.sum(f"{c}{t}").alias(f"{c}{t}") for t in range(k) for c in "is"))
            costs = []
            for t in range(k):
                mass = (F.lit(sizes.get(t, 0)) - (F.col("cluster") == t).cast("int")) * each
                beyond = mass / (mass + each) * F.log((mass + each) / mass) * (1 - F.col(f"s{t}"))
                costs.append(F.struct(F.round(F.when(mass > 0, (mass + each) * (F.col(f"i{t}") + beyond)).otherwise(0.0) / each, 9).alias("cost"), F.lit(t).alias("t")))
            told = _written(total.select("doc", F.col("cluster").alias("old"), F.least(*costs)["t"].alias("new")).where("old <> new"), "moves")
            n = told.count()
            if n:
                moved += n
                now = _written(now.join(told.select("doc", "new"), "doc", "left").select("doc", "part", F.coalesce("new", "cluster").alias("cluster")), "clusters")
                state = sums(now)
        known.append(_information(state, single.join(now, "doc"), count))
        if moved <= least_change:
            break
    return now.select("doc", "cluster"), known


def _information(state: tuple[np.ndarray, DataFrame, dict[int, int]], single: DataFrame, count: int) -> float:
    """Mutual information of clusters and words, in nats, from the words' sums."""
    frequent, words, sizes = state
    k = frequent.shape[1]
    t = np.array([sizes.get(i, 0) / count for i in range(k)])
    with np.errstate(all="ignore"):
        out = np.where(frequent > 0, frequent * np.log(frequent / (t * frequent.sum(1, keepdims=True))), 0.0).sum()
    every = sum((F.col(f"q{i}") for i in range(1, k)), F.col("q0"))
    rest = sum((F.when(F.col(f"q{i}") > 0, F.col(f"q{i}") * F.log(F.col(f"q{i}") / (float(t[i]) * every))).otherwise(0.0) for i in range(k)), F.lit(0.0))
    alone = single.groupBy("cluster").agg(F.sum("single").alias("s")).collect()
    return float(out + (words.agg(F.sum(rest).alias("i")).first().i or 0.0) - sum(r.s / count * np.log(t[r.cluster]) for r in alone))


def item_clusters(baskets: DataFrame, repulsion: float = 2.6, sweeps: int = 50, parts: int = 2, seed: int = 1) -> DataFrame:
    """(id, cluster): baskets by the profit of shared items, S * N / W ** repulsion of a cluster of N baskets with S items, W of them different.

    ``baskets``: (id, items array<string>); equal item sets move as one. A set moves where its profit grows most: to a cluster that has one of its items, or to a
    new one; of the sets of a step that want a new cluster the one of most baskets (ties by the smallest id) opens it and the others take the best there is.
    Clusters are named by the smallest id in them. Empty, null and all-null baskets get no cluster (null).
    """
    own = baskets.select("id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items"))
    sets = own.where("size(items) > 0").groupBy("items").agg(F.min("id").alias("s"), F.count("*").cast("double").alias("w"))
    sets = _written(_dealt(sets, "s", parts, seed), "sets")
    long = _written(sets.select("s", "w", F.size("items").cast("double").alias("m"), F.explode("items").alias("item"), "part"), "items")
    kind = dict(sets.dtypes)["s"]
    now = sets.sparkSession.createDataFrame([], f"s {kind}, c {kind}")
    power = lambda x: F.pow(x, F.lit(repulsion))
    profit = lambda s, n, w: F.when(n > 0, s * n / power(w)).otherwise(0.0)
    for _ in range(sweeps):
        moved = False
        for part in range(parts):
            held = long.join(now, "s")
            hist = held.groupBy("c", "item").agg(F.sum("w").alias("occ"))
            size = held.groupBy("c").agg(F.sum("w").alias("s_c"), F.count_distinct("item").cast("double").alias("w_c")).join(sets.join(now, "s").groupBy("c").agg(F.sum("w").alias("n_c")), "c")
            mine = long.where(F.col("part") == part).join(now.withColumnRenamed("c", "old"), "s", "left")
            hit = mine.join(hist, "item")
            is_own = F.col("c") == F.col("old")
            # own cluster: as it is without the set, whose items that no other set has are not there then
            matched = hit.groupBy("s", "w", "m", "old", "c").agg(F.count_if(F.when(is_own, F.col("occ") > F.col("w")).otherwise(F.lit(True))).cast("double").alias("same")).join(size, "c")
            less = F.when(is_own, 1.0).otherwise(0.0)
            s0, n0 = F.col("s_c") - less * F.col("w") * F.col("m"), F.col("n_c") - less * F.col("w")
            w0 = F.col("w_c") - less * (F.col("m") - F.col("same"))
            gain = profit(s0 + F.col("w") * F.col("m"), n0 + F.col("w"), w0 + F.col("m") - F.col("same")) - profit(s0, n0, w0)
            best = matched.where(n0 > 0).groupBy("s").agg(F.min(F.struct(F.round(-gain, 9).alias("loss"), (~F.coalesce(is_own, F.lit(False))).alias("other"), "c")).alias("g"))
            base = sets.where(F.col("part") == part).join(now.withColumnRenamed("c", "old"), "s", "left").join(best, "s", "left")
            alone = F.round(F.col("w") * F.col("m1") * F.col("w") / power(F.col("m1")), 9)
            base = base.withColumn("m1", F.size("items").cast("double")).withColumn("wants", F.col("g").isNull() | (alone > -F.col("g.loss")))
            base = _written(base.select("s", "w", "old", "wants", F.col("g.c").alias("to")), "wishes")
            # a set that is alone in its cluster and wants to be alone stays
            single = sets.join(now, "s").groupBy("c").agg(F.count("*").alias("sets")).where("sets = 1").select(F.col("c").alias("old"), F.lit(True).alias("single"))
            base = base.join(single, "old", "left").withColumn("opens", F.col("wants") & F.col("single").isNull())
            first = base.where("opens").orderBy(F.desc("w"), "s").limit(1).select("s").collect()
            opener = first[0].s if first else None
            to = F.when(F.col("s") == opener, F.col("s")) if opener is not None else F.lit(None).cast(kind)
            told = base.select("s", "old", F.coalesce(to, F.when(F.col("wants") & F.col("single").isNotNull(), F.col("old")), F.col("to"), F.col("old")).alias("c"))
            told = _written(told, "moves")
            if told.where("not (c <=> old)").limit(1).count():
                moved = True
            rest = now.join(told.select("s"), "s", "left_anti")
            joined = rest.unionByName(told.where("c is not null").select("s", "c"))
            named = joined.groupBy("c").agg(F.min("s").alias("name"))
            now = _written(joined.join(named, "c").select("s", F.col("name").alias("c")), "clusters")
        if not moved:
            break
    of = own.join(sets.join(now, "s", "left").select("items", F.col("c").alias("cluster")), "items", "left")
    return of.select("id", "cluster")
