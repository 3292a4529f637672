"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of one label are dealt to the two nearest of some centroids, so the shards overlap. A shard that is large because the
table is, not because its vectors are alike, is dealt again by centroids of its own. On each shard a graph is built with robust
pruning; the adjacency lists of a vector's shards are united; every vector then searches its shards greedily from medoids and
expands every hit within range. What the search finds is verified in double precision. Equal vectors are searched once. A dense
shard over MAX_SHARD rows is cut in blocks: a graph for each block, and every block of queries searches every block, so no group is
larger than two blocks and no link of it is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, join_split, mix

THRESHOLD = 0.98
#: Vectors that a set of centroids is fitted on at most (of the table, then of each large shard); aimed and largest rows of a shard.
SAMPLE, SHARD, MAX_SHARD = 20_000, 400, 2048
#: A large shard whose rows have this cosine with their centroids on average is dense: it is cut in blocks, not dealt again.
DENSE = 0.9
#: Rows of a task that deals a shard again; candidates, degree, slack of pruning; beam of the search; medoids.
DEALT = 50_000
CANDIDATES, DEGREE, SLACK, BEAM, MEDOIDS = 40, 16, 1.2, 24, 8


def _unit(rows) -> np.ndarray:
    x = np.asarray(list(rows), np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _centroids(sample: pd.DataFrame, share: float) -> dict:
    """Centroids for each (label, size): some rounds of spherical k-means on the sample, which is ``share`` of all rows."""
    out = {}
    for key, g in sample.groupby(["label", "size"]):
        x = _unit(g["v"])
        out[key] = _spherical_means(x, round(len(x) / share / SHARD))
    return out


def _spherical_means(x: np.ndarray, k: int) -> np.ndarray:
    k = int(min(max(1, k), max(1, len(x) // 8)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


KEY = ["label", "size", "shard"]
_DEALT = "label string, size int, shard long, rep long, m long, v array<double>"


def _deal_again(shards: DataFrame, before: float = float("inf")) -> DataFrame:
    """``shards`` with rows of large, loose shards dealt to the two nearest of centroids fitted on a sample of that shard, again and again while
    that leaves fewer rows in large shards (by a fifth at least); new shards have hashes of their path as ids."""
    sized = cut(shards.groupBy(*KEY).agg(F.count("*").alias("rows")).where(F.col("rows") > MAX_SHARD))
    held = sized.agg(F.sum("rows").alias("n")).first().n or 0
    if not held or held > 0.8 * before:
        return shards

    def fit(key, g: pd.DataFrame) -> pd.DataFrame:
        x = _unit(g["v"])
        c = _spherical_means(x, round(int(g["rows"].iloc[0]) / SHARD))
        if len(c) < 2 or float((x @ c.T).max(1).mean()) >= DENSE:
            c = c[:0]
        return pd.DataFrame({"label": key[0], "size": key[1], "shard": key[2], "c": pd.Series(list(c), dtype=object)})

    large = shards.join(sized, KEY)
    some = large.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < (1 << 20) * float(SAMPLE) / F.col("rows"))
    centroids = cut(some.groupBy(*KEY).applyInPandas(fit, "label string, size int, shard long, c array<float>"))
    split = cut(centroids.select(*KEY).distinct().join(sized, KEY))
    if not split.count():
        return shards
    parts = split.withColumn("parts", F.ceil(F.col("rows") / DEALT).cast("int")).select(*KEY, "parts")

    def deal(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.drop(columns="part")
        two = np.argsort(-(_unit(rows["v"]) @ np.stack(own["c"]).T), axis=1)[:, :2]
        both = pd.concat([rows, rows])
        both["shard"] = mix(both["shard"].to_numpy().view(np.uint64) * np.uint64(SAMPLE + 1) + np.uint64(1) + two.T.ravel().astype(np.uint64)).view(np.int64)
        return both[["label", "size", "shard", "rep", "m", "v"]]

    rows = shards.join(parts, KEY).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    sent = centroids.join(parts, KEY).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    again = rows.groupBy(*KEY, "part").cogroup(sent.groupBy(*KEY, "part")).applyInPandas(deal, _DEALT)
    rest = shards.join(split.select(*KEY), KEY, "left_anti")
    return _deal_again(cut(rest.select("label", "size", "shard", "rep", "m", "v").union(again)), held)


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    """Adjacency lists as a matrix, short ones filled up with -1."""
    table = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1)
    for i, e in enumerate(lists):
        table[i, : len(e)] = e
    return table


def _pruned(x: np.ndarray, of: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> list[list[int]]:
    """Robust pruning: of a node's candidates the nearest is taken, and those that are much nearer to it than to the node go, until DEGREE are taken.

    ``cand``, ``sims``: a row of candidates a node with their cosines; those under -8 are none.
    """
    d = np.sqrt(np.maximum(2 - 2 * sims, 0))
    order = np.argsort(d, axis=1)
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    alive = (np.take_along_axis(sims, order, 1) > -8) & (cand != of[:, None])
    picks: list[list[int]] = [[] for _ in range(len(of))]
    for _ in range(DEGREE):
        some = np.flatnonzero(alive.any(1))
        if not len(some):
            break
        best = alive[some].argmax(1)
        p = cand[some, best]
        for i, j in zip(some.tolist(), p.tolist(), strict=True):
            picks[i].append(j)
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("id,icd->ic", x[p], x[cand[some]]), 0))
        alive[some] &= (SLACK * between > d[some]) & (cand[some] != p[:, None])
    return picks


def _graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard: nodes join in growing batches, each by a greedy search of the graph so far and robust pruning, with the edges back;
    then all search the whole graph once more. Only what the searches meet is compared.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, int)]
    rng = np.random.default_rng(n)
    order = rng.permutation(n)
    links: list[set] = [set() for _ in range(n)]

    def join(nodes: np.ndarray, base: np.ndarray, sims: np.ndarray) -> None:
        c = min(CANDIDATES, len(base))
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        full = []
        for i, js in zip(nodes.tolist(), _pruned(x, nodes, base[near], np.take_along_axis(sims, near, 1)), strict=True):
            links[i].update(js)
            for j in js:
                links[j].add(i)
                full.append(j)
        over = np.array(sorted({j for j in [*full, *nodes.tolist()] if len(links[j]) > 3 * DEGREE}), int)
        for a in range(0, len(over), 256):
            some = over[a : a + 256]
            cand = _padded([np.array(sorted(links[j]), int) for j in some.tolist()])
            s = np.where(cand >= 0, np.einsum("id,icd->ic", x[some], x[cand]), -9)
            for j, js, row, own in zip(some.tolist(), _pruned(x, some, cand, s), s, cand, strict=True):
                links[j] = set(js) | set(own[np.argsort(-row)[:DEGREE]].tolist())

    first = order[:64]
    join(first, first, x[first] @ x[first].T)
    done = len(first)
    place = np.full(n, -1)
    while done < n:
        batch, base = order[done : 2 * done], order[:done]
        place[base] = np.arange(done)
        table = _padded([place[np.array(sorted(links[j]), int)] for j in base.tolist()])
        join(batch, base, _beam(x[batch], x[base], table)[0])
        done += len(batch)
    table = _padded([np.array(sorted(e), int) for e in links])
    for a in range(0, n, 512):
        nodes = np.arange(a, min(n, a + 512))
        join(nodes, np.arange(n), _beam(x[nodes], x, table)[0])
    far = rng.integers(0, n, (n, 2))
    return [np.unique(np.r_[np.array(sorted(e), int), f]) for e, f in zip(links, far, strict=True)]


def _beam(q: np.ndarray, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of every query with what its greedy search from medoids met (-9: not met), and which nodes it expanded."""
    n, m, width = len(q), len(x), table.shape[1]
    sims = np.full((n, m), -9, np.float32)
    done = np.zeros((n, m), bool)
    centre = x.mean(0)
    starts = [int((x @ centre).argmax())]
    far = x @ x[starts[0]]
    for _ in range(min(MEDOIDS, m) - 1):
        starts.append(int(far.argmin()))
        far = np.maximum(far, x @ x[starts[-1]])
    sims[:, starts] = q @ x[starts].T
    live = np.arange(n)
    for turn in range(m):
        open_sims = np.where(done[live], -9, sims[live])
        best = open_sims.argmax(1)
        top = open_sims[np.arange(len(live)), best]
        if turn % 4 == 0:
            kth = np.partition(sims[live], m - BEAM, axis=1)[:, m - BEAM] if m > BEAM else np.full(len(live), -9.0, np.float32)
        go = (top > -8) & (top >= kth) if len(kth) == len(live) else top > -8
        live, best, kth = live[go], best[go], kth[go]
        if not len(live):
            break
        done[live, best] = True
        next_ = table[best]
        row = np.repeat(live, width)[(ok := (next_ >= 0).ravel())]
        col = next_.ravel()[ok]
        new = sims[row, col] < -8
        row, col = row[new], col[new]
        sims[row, col] = np.einsum("ij,ij->i", q[row], x[col])
    return sims, done


def range_search(q: np.ndarray, x: np.ndarray, edges: list[np.ndarray], least: float) -> np.ndarray:
    """Which of ``x`` each query finds at cosine ``least`` or more: greedy search from medoids, then every hit is expanded."""
    m, table = len(x), _padded(edges)
    width = table.shape[1]
    sims, done = _beam(q, x, table)
    while True:
        row, col = np.nonzero((sims >= least) & ~done)
        if not len(row):
            return sims >= least
        for a in range(0, len(row), 20_000):
            r, c = row[a : a + 20_000], col[a : a + 20_000]
            done[r, c] = True
            next_ = table[c]
            ok = (next_ >= 0).ravel()
            r2, c2 = np.repeat(r, width)[ok], next_.ravel()[ok]
            new = sims[r2, c2] < -8
            both = np.unique(r2[new] * m + c2[new])
            r2, c2 = both // m, both % m
            sims[r2, c2] = np.einsum("ij,ij->i", q[r2], x[c2])


def _build(g: pd.DataFrame) -> pd.DataFrame:
    edges = _graph(_unit(g["v"]))
    ids = g["rep"].to_numpy()
    return pd.DataFrame({"rep": ids, "near": [ids[e] for e in edges]})


def _search(g: pd.DataFrame) -> pd.DataFrame:
    """One block of queries against one block's graph: links counted once a pair, and each vector's smallest connected one."""
    member, query = g[g["member"]], g[g["query"]]
    if not len(member) or not len(query):
        return pd.DataFrame({"rep": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
    place = {r: i for i, r in enumerate(member["rep"])}
    x, q = _unit(member["v"]), _unit(query["v"])
    edges = [np.array(sorted({place[r] for r in near if r in place}), int) for near in member["near"]]
    row, col = np.nonzero(range_search(q, x, edges, THRESHOLD - 1e-4))
    a, b = (np.asarray(list(f["v"]), np.float64) for f in (query, member))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ok = np.zeros(len(row), bool)
    for s in range(0, len(row), 50_000):
        r, c = row[s : s + 50_000], col[s : s + 50_000]
        ok[s : s + 50_000] = np.einsum("ij,ij->i", a[r], b[c]) / (na[r] * nb[c]) >= THRESHOLD
    ids_q, ids_m = query["rep"].to_numpy(), member["rep"].to_numpy()
    ok &= ids_q[row] != ids_m[col]
    row, col = row[ok], col[ok]
    # a pair that shares several shards counts in the smallest
    shard, width = int(g["shard"].iloc[0]), max(map(len, g["homes"]))
    homes = lambda f, none: np.array([[*h, *[none] * (width - len(h))] for h in f["homes"]], np.int64)
    hq, hm = homes(query, -1), homes(member, -2)
    here = np.ones(len(row), bool)
    for s in range(0, len(row), 50_000):
        x, y = hq[row[s : s + 50_000]], hm[col[s : s + 50_000]]
        here[s : s + 50_000] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1) == shard
    links = np.bincount(row[here], member["m"].to_numpy()[col[here]], len(query)).astype(np.int64)
    root_q, root_m = ids_q.copy(), ids_m.copy()
    while True:
        before = root_q.sum() + root_m.sum()
        np.minimum.at(root_m, col, root_q[row])
        np.minimum.at(root_q, row, root_m[col])
        if root_q.sum() + root_m.sum() == before:
            break
    out = pd.DataFrame({"rep": ids_q, "links": links, "root": root_q})
    return pd.concat([out, pd.DataFrame({"rep": ids_m, "links": 0, "root": root_m})])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: links are pairs of equal label at cosine 0.98 or more.

    Rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite numbers, have no link and
    are their own component (null id: null). Vectors of different length never link. Rows that repeat are vectors of
    their own and link to each other. The search is approximate, the links are exact; :func:`audit` measures recall.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")).withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    good = rows.where("usable")
    reps = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))).withColumn("size", F.size("v"))
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("label", "size", "v").toPandas()
    centroids = spark.sparkContext.broadcast(_centroids(sample, min(1.0, SAMPLE / max(n, 1))) if n else {})

    def deal(frames):
        for f in frames:
            for (label, size), g in f.groupby(["label", "size"]):
                c = centroids.value.get((label, size))
                two = np.zeros((len(g), 1), np.int64) if c is None or len(c) == 1 else np.argsort(-(_unit(g["v"]) @ c.T), axis=1)[:, :2]
                yield pd.concat([g.assign(shard=two[:, i]) for i in range(two.shape[1])])[["label", "size", "shard", "rep", "m", "v"]]

    shards = cut(reps.select("label", "size", "rep", "m", "v").mapInPandas(deal, _DEALT))
    shards = _deal_again(shards)
    homes = shards.groupBy("rep").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    blocks = shards.groupBy(*KEY).agg(F.ceil(F.count("*") / MAX_SHARD).cast("int").alias("blocks"))
    shards = shards.join(blocks, KEY).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    graph = shards.select(*KEY, "block", "rep", "v").groupBy(*KEY, "block").applyInPandas(_build, "rep long, near array<long>")
    united = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    known = shards.join(united.join(homes, "rep"), "rep")
    both = F.expr("transform(sequence(0, blocks - 1), i -> struct(block as mb, i as qb, true as member, block = i as query))"), F.expr("filter(transform(sequence(0, blocks - 1), i -> struct(i as mb, block as qb, false as member, true as query)), s -> s.mb <> s.qb)")
    sent = known.withColumn("x", F.explode(F.concat(*both))).select(*KEY, "rep", "m", "v", "homes", "near", "x.*")
    found = cut(sent.groupBy(*KEY, "mb", "qb").applyInPandas(_search, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> root").select("rep", "root"), "rep", "root")
    of_rep = cut(reps.join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select("label", "v", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = join_split(good, of_rep, ["label", "v"], "m").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, found: DataFrame, every: int = 100, most: int = 2000) -> float:
    """Share of the links of some rows that the search found, against brute force over all rows.

    Those rows are the ones whose id is divisible by ``every``; of more than ``most``, as many with the least hash of the id.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label").where("label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    queries = v.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    sent = v.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(), np.asarray(list(queries["v"])), queries["label"].to_numpy()))

    def count(frames):
        ids, q, label = sent.value
        total = np.zeros(len(ids), np.int64)
        for f in frames:
            x = np.asarray(list(f["v"]))
            cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
            total += ((cos >= THRESHOLD) & (label[:, None] == f["label"].to_numpy()) & (ids[:, None] != f["vec_id"].to_numpy())).sum(1)
        yield pd.DataFrame({"vec_id": ids, "n": total})

    if not len(queries):
        return 1.0
    truth = v.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    r = truth.join(found, "vec_id").agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("all")).first()
    return 1.0 if not r["all"] else r["got"] / r["all"]
