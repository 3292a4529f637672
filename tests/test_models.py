"""Operators without SQL against plain versions on small fixtures."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import columns, distances, evaluation, graphs, mining, models, sampling, series, symbols
from tidemill.sources import files
from tidemill.streaming import operators as streaming


def frame(spark, x, **more):
    rows = [(i, v.tolist(), *(c[i] for c in more.values())) for i, v in enumerate(np.asarray(x, float))]
    return spark.createDataFrame(rows, ["id", "s", *more])


def test_partial_autocorrelations_solve_the_equations(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=(4, 50)), axis=1)
    df = frame(spark, x)
    got = df.select("id", series.partial_autocorrelation("s").alias("p"), series.autoregression("s").alias("a"), series.autoregression_by_aic("s").alias("b")).orderBy("id").collect()
    for r, v in zip(got, x, strict=True):
        c = v - v.mean()
        acf = np.array([(c[: 50 - k] * c[k:]).sum() for k in range(11)]) / (c @ c)
        phi = [np.linalg.solve(acf[np.abs(np.arange(k)[:, None] - np.arange(k))], acf[1 : k + 1]) for k in range(1, 11)]
        assert np.allclose(r.p, [p[-1] for p in phi]) and np.allclose(r.a, phi[-1])
        k = np.count_nonzero(r.b)
        assert np.allclose(r.b[:k], phi[k - 1])


def test_latent_semantics_and_components(spark):
    x = np.random.default_rng(2).normal(size=(60, 6)) @ np.diag([5, 4, 3, 1, 1, 1])
    got = np.array([r.scores for r in columns.latent_semantics(frame(spark, x), "id", "s", 6, 3).orderBy("id").collect()])
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ v[:3].T))
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(6)])
    k = columns.principal_components(wide, [f"c{i}" for i in range(6)], 0.8, standardise=False).select(F.size("components").alias("k")).first().k
    share = np.cumsum(np.linalg.eigvalsh(np.cov(x.T))[::-1]) / np.trace(np.cov(x.T))
    assert k == int(np.searchsorted(share, 0.8) + 1)


def test_partial_least_squares_scores_are_uncorrelated(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = x @ [1, 2, 0, -1] + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ["a", "b", "c", "d", "y"])
    s = np.array([r.scores for r in columns.partial_least_squares(df, ["a", "b", "c", "d"], "y", 3).collect()])
    assert np.allclose(np.corrcoef(s.T) - np.eye(3), 0, atol=1e-6)
    c = s - s.mean(0)
    assert 1 - ((y - y.mean() - c @ np.linalg.lstsq(c, y - y.mean(), rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.97


def test_chaid_merges_labels_that_do_not_differ(spark):
    rows = [(v, c) for v, k in (("a", 50), ("b", 52), ("z", 95)) for c in ["x"] * k + ["y"] * (100 - k)]
    df = spark.createDataFrame(rows, "v string, c string")
    assert {r.v for r in columns.merge_by_chaid(df, "v", "c").select("v").distinct().collect()} == {"a_or_b", "z"}
    assert abs(columns.chi_squared_p(3.841459, 1) - 0.05) < 1e-6 and abs(columns.chi_squared_p(40.0, 30) - 0.104864) < 1e-5


def test_components_and_forest(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2)) if a != b] + [(i, i + 1) for i in range(60, 90)]
    parent = list(range(95))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(95)
    got = {r.id: r.component for r in graphs.component_labels(nodes, spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: root(i) for i in range(95)}
    w = {(a, b): float(rng.random()) for a, b in itertools.combinations(range(12), 2)}
    table = spark.createDataFrame([(a, b, d) for (a, b), d in w.items()], "x long, y long, distance double")
    forest = {(r.x, r.y) for r in graphs.minimum_forest(spark.range(12), table).collect()}
    parent = list(range(12))
    want = set()
    for (a, b), _ in sorted(w.items(), key=lambda e: e[1]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b))
    assert forest == want


def test_spheres_cover_every_row(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (40, 3))]
    y = [0] * 40 + [1] * 40
    got = distances.sphere_cover(frame(spark, x, y=y), "id", "s", "y").collect()
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for r in got:
        assert abs(r.radius - far[r.centre][np.array(y) != y[r.centre]].min()) < 1e-9
    assert all(any(y[i] == r["class"] and far[i, r.centre] < r.radius for r in got) for i in range(80))


def test_multivariate_warping_and_alignment():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(3, 2, 9)), rng.normal(size=(3, 2, 9))

    def path(cost):
        d = np.full((10, 10), np.inf)
        d[0, 0] = 0
        for i in range(9):
            for j in range(9):
                d[i + 1, j + 1] = cost[i, j] + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    each = lambda x, y: (x[:, None] - y) ** 2
    assert np.allclose(distances.multivariate_dtw(a, b), [math.sqrt(path(each(x[0], y[0]) + each(x[1], y[1]))) for x, y in zip(a, b, strict=True)])
    assert np.allclose(distances.multivariate_dtw(a, b, dependent=False), [sum(math.sqrt(path(each(x[c], y[c]))) for c in (0, 1)) for x, y in zip(a, b, strict=True)])
    u, v = np.array([[1, 1, 2, 2, 3, 3, 2, 2, 1, 1.0]]), np.array([[1, 2, 3, 2, 1, 1, 1, 1, 1, 2.0]])
    assert distances.time_aligned(u, u)[0] == 0 and distances.time_aligned(u, v, band=2)[0] <= distances.time_aligned(u, v, band=1)[0]


def test_best_shapelets_are_those_of_a_full_search(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(18, 20))
    y = [i % 3 for i in range(18)]
    for i in range(18):
        x[i, 4 + y[i] : 10 + y[i]] += [0, 3, -3, 3, -3, 0] if y[i] else [3, 0, 0, 0, -3, 3]
    z = lambda w: (w - w.mean()) / w.std() if w.std() > 0 else w * 0
    scored = []
    for i in range(18):
        for n in (5, 7):
            for s in range(20 - n + 1):
                h = z(x[i, s : s + n])
                d = np.array([min(((z(v[k : k + n]) - h) ** 2).mean() for k in range(20 - n + 1)) for v in x])
                groups = [d[np.array(y) == c] for c in range(3)]
                between = sum(len(g) * (g.mean() - d.mean()) ** 2 for g in groups) / 2
                within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 15
                scored.append((-round(between / within, 9), n, i, s))
    own, want = collections.defaultdict(list), []
    for q, n, i, s in sorted(scored, key=lambda e: (e[0], e[1], e[3])):
        if all(s >= b + m or b >= s + n for b, m in own[i]):
            own[i].append((s, n))
            want.append((q, n, i, s))
    want = sorted(want)[:4]
    got = symbols.best_shapelets(frame(spark, x, y=y), "id", "s", "y", [5, 7], 4)
    assert [(g["length"], g["series_id"], g["start"]) for g in got] == [w[1:] for w in want]
    tree = symbols.shapelet_tree(frame(spark, x, y=y), "id", "s", "y", [5], 2)
    p = symbols.tree_predict(frame(spark, x, y=y), ["id", "y"], "s", tree).collect()
    assert np.mean([r.y == r.predicted for r in p]) > 0.8
    assert sum(map(len, symbols.merge_shapelets(got, 2))) == 4


def test_boosting_against_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 3, (300, 3))]
    rows = [(a, b, c, "y" if a + b > 2 or (c == 2 and a > 0) else "n") for a, b, c in rows]
    df = spark.createDataFrame(rows, "a int, b int, c int, y string")
    w = np.ones(300)
    want = []
    for _ in range(4):
        best = None
        for j, name in enumerate("abc"):
            hit, rule = 0.0, {}
            for v in range(3):
                t = collections.Counter()
                for r, x in zip(rows, w, strict=True):
                    if r[j] == v:
                        t[r[3]] += x
                rule[v] = min(t, key=lambda k: (-round(t[k], 12), k))
                hit += t[rule[v]]
            e = 1 - hit / w.sum()
            if best is None or e < best[1] - 1e-12:
                best = (name, e, rule, j)
        want.append((best[0], best[1]))
        w = w * [best[1] / (1 - best[1]) if best[2][r[best[3]]] == r[3] else 1.0 for r in rows]
    got = models.boosted_rules(df, ["a", "b", "c"], "y", 4)
    assert [g["column"] for g in got] == [a for a, _ in want] and np.allclose([g["error"] for g in got], [e for _, e in want])
    said = models.rules_predict(df, got, ["n", "y"])
    assert said.where("predicted = y").count() > 230
    p = df.withColumn("id", F.monotonically_increasing_id())
    bagged = p.join(models.bagged_tables(p, ["a", "b", "c"], "y", "id", 9), ["a", "b", "c"])
    assert bagged.count() == 300 and bagged.where("predicted = y").count() > 280


def test_mixture_and_medians(spark):
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal([0, 0], 0.5, (60, 2)), rng.normal([6, 3], 0.5, (40, 2))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    parts, shares = models.diagonal_mixture(df, ["a", "b"], "id", 2, 4)
    assert np.allclose([p["share"] for p in parts], [0.6, 0.4], atol=1e-3) and np.allclose(parts[0]["mean"], x[:60].mean(0), atol=1e-2)
    assert shares.groupBy("id").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    centres, _ = models.k_medians(frame(spark, x), "id", "s", 2, 10)
    c = x[:2].copy()
    for _ in range(10):
        near = np.round(np.abs(x[:, None] - c).sum(2), 9).argmin(1)
        c = np.array([np.median(x[near == i], axis=0) if (near == i).any() else c[i] for i in (0, 1)])
    assert np.allclose(centres, c)
    found = models.x_means(frame(spark, x), "s", 1, 4).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [40, 60]


def test_code_words_and_isotonic(spark):
    for kind, n in (("one_vs_one", 3), ("one_vs_rest", 3), ("exhaustive", 3)):
        codes = models.pairwise_codes(["x", "y", "z"], kind)
        assert len(codes) == n
        for k in "xyz":
            row = spark.createDataFrame([tuple(float(c.get(k, 0.5)) for c in codes)], [f"b{i}" for i in range(n)])
            assert models.decode(row, row.columns, codes, ["x", "y", "z"]).first().predicted == k
    y = [1.0, 3.0, 2.0, 4.0, 3.5, 6.0]
    df = spark.createDataFrame([([float(i)], v) for i, v in enumerate(y)], "f array<double>, y double")
    m = models.fit("isotonic", df, "f", "y")
    assert np.allclose(sorted(m.transform(models.as_vectors(df, "f", "y")).toPandas()["prediction"]), [1, 2.5, 2.5, 3.75, 3.75, 6])


def test_large_item_sets_and_long_sequences(spark):
    big = [f"i{k:02d}" for k in range(14)]
    items = spark.createDataFrame([(big,)] * 9 + [(["i00"],)], "items array<string>")
    f = mining.frequent_items(items, 0.8).where("size(items) in (1, 13, 14)")
    r = mining.rules(f, 10, 0.5).where("size(antecedent) = 13")
    assert {x.consequent[0] for x in r.collect()} == set(big)
    rows = [(u, t, f"e{t}") for u in range(4) for t in range(9)]
    s = mining.sequences(spark.createDataFrame(rows, "u long, t long, e string"), ["u"], ["t"], "e", 0.9)
    assert s.count() == 2**9 - 1


def test_cliques(spark):
    rows = [("a", "b", 0.9), ("a", "c", 0.001), ("b", "c", 0.5), ("a", "d", 0.9), ("b", "d", 0.9), ("c", "d", 0.0001)]
    got = evaluation.cliques(spark.createDataFrame(rows, "method string, other string, p_signed_rank double"), 0.05).collect()
    assert sorted(tuple(r.methods) for r in got) == [("a", "b", "d"), ("b", "c")]


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    rng = np.random.default_rng(10)
    path = str(tmp_path_factory.mktemp("arriving") / "in")
    rows = [(i, int(a), int(b), int(a) if rng.random() < 0.95 else 1 - int(a), float(u), float(v)) for i, (a, b, u, v) in enumerate(zip(rng.integers(0, 2, 1200), rng.integers(0, 3, 1200), rng.normal(size=1200), rng.normal(size=1200), strict=True))]
    df = spark.createDataFrame(rows, "id long, a int, b int, y int, u double, v double")
    for k in range(4):
        df.where(F.col("id").between(300 * k, 300 * k + 299)).coalesce(1).write.mode("append").parquet(path)
    return path, df, rows


def test_stream_learners(spark, arriving):
    path, df, rows = arriving
    source = lambda: streaming.row_source(spark, path, df.schema)
    tree = streaming.TableState(spark, "leaf string, attribute string, value string, class string, n long")
    streaming.feed(source(), streaming.hoeffding_sink(["a", "b"], "y", 2, tree))
    inner = {r.leaf: r.attribute for r in tree.before().where("class is null").collect()}
    assert inner[""] == "a"
    x = df.withColumn("t", 2 * F.col("u") - F.col("v") + 1)
    path2 = files.scratch(spark, "linear")
    for k in range(4):
        x.where(F.col("id").between(300 * k, 300 * k + 299)).coalesce(1).write.mode("append").parquet(path2)
    state = streaming.TableState(spark, "i int, w double")
    streaming.feed(streaming.row_source(spark, path2, x.schema), streaming.gradient_sink(["u", "v"], "t", 0.5, state))
    w = np.zeros(3)
    for k in range(4):
        part = np.array([[r[4], r[5], 1.0] for r in rows[300 * k : 300 * k + 300]])
        w = w - 0.5 * (part * (part @ w - (part @ [2, -1, 1]))[:, None]).mean(0)
    assert np.allclose([r.w for r in state.before().orderBy("i").collect()], w)
    committee = streaming.TableState(spark, "member int, pattern string, predicted string, score double")
    streaming.feed(source(), streaming.raced_rules(["a", "b"], "y", committee, 2))
    p = streaming.committee_vote(committee.before(), df, "id", ["a", "b"]).join(df, "id")
    assert p.where("predicted = string(y)").count() > 1080 and committee.before().select("member").distinct().count() == 2
    recent = streaming.TableState(spark, "id long, a int")
    streaming.feed(source(), streaming.recent_sink(50, ["id"], recent))
    assert {r.id for r in recent.before().collect()} == set(range(1150, 1200))


def test_weighted_and_smoted_rows(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(400)], "id long, w double")
    got = [r.id % 4 for r in sampling.weighted_sample(df, "id", "w", 150).collect()]
    assert got.count(0) == 0 and got.count(3) > got.count(1)
    x = np.random.default_rng(11).normal(size=(12, 3))
    made = sampling.smote(frame(spark, x, y=[1] * 12), "y", 1, "id", "s", 300, 4)
    assert made.count() == 36 and all((np.array(r.s) <= x.max(0) + 1e-9).all() and (np.array(r.s) >= x.min(0) - 1e-9).all() for r in made.collect())
