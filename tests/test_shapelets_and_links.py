"""Learned shapelets, bounded and hashed searches, linkage trees and pivot searches against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import learned_shapelets as learned
from tidemill.operators import distances, linkage, pivots, shapelet_search, symbols


def bumps(rng, n, size=40):
    """Series of noise with one of three shapes somewhere."""
    shapes = [np.hanning(12) * 6, np.r_[np.linspace(-3, 3, 6), np.linspace(3, -3, 6)], np.sin(np.arange(12)) * 4]
    x = rng.normal(0, 0.6, (n, size))
    y = np.arange(n) % 3
    for i in range(n):
        at = rng.integers(0, size - 12)
        x[i, at : at + 12] += shapes[y[i]]
    return x, y


def series_frame(spark, x, y):
    return spark.createDataFrame([(int(i), int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, label int, s array<double>")


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(7, 20)), rng.integers(0, 3, 7)
    m = learned.ShapeletModel([rng.normal(size=(2, 5)), rng.normal(size=(3, 8))], rng.normal(size=(3, 5)), rng.normal(size=3), [0, 1, 2])
    _, g = learned.loss_and_gradient(x, y, m, -5.0)
    flat = m.packed()
    for i in range(flat.size):
        step = np.zeros(flat.size)
        step[i] = 1e-5
        up, down = (learned.loss_and_gradient(x, y, m.unpacked(flat + s), -5.0)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-5 * max(1, abs(g[i]))


def test_soft_minimum_comes_near_the_minimum():
    rng = np.random.default_rng(2)
    x, s = rng.normal(size=(4, 30)), rng.normal(size=(3, 7))
    w = learned._windows(x, 7)
    least = ((w[:, None] - s[None, :, None]) ** 2).mean(3).min(2)
    assert np.allclose(learned.soft_minima(x, [s], -500.0), least, atol=1e-2) and (learned.soft_minima(x, [s]) >= least - 1e-9).all()


def test_learned_shapelets(spark):
    x, y = bumps(np.random.default_rng(5), 150)
    df = series_frame(spark, x, y)
    model, losses = learned.learn_shapelets(df, "s", "label", [8, 12], 3, epochs=40)
    assert all(b <= a for a, b in itertools.pairwise(losses)) and losses[-1] < 0.6 * losses[0]
    got = {r.id: r for r in learned.shapelet_predict(df, ["id", "label"], "s", model).collect()}
    assert np.mean([r.predicted == r.label for r in got.values()]) > 0.9
    z = learned.soft_minima(x, model.shapelets) @ model.weights.T + model.bias
    assert all(got[i].predicted == int(z[i].argmax()) for i in range(len(x)))
    one = learned._total(df.selectExpr("label as __y", "s as __x"), model, -30.0)
    whole = learned.loss_and_gradient(x, y, model)
    assert abs(one[0] - whole[0]) < 1e-6 and np.allclose(one[1], whole[1])
    with pytest.raises(ValueError):
        learned.learn_shapelets(df.where("label = 0"), "s", "label", [8], 2)


def plain_tree(x, link):
    """(x, y, height, size) by merging the nearest two clusters, one pair after the other, distances straight from the members."""
    groups = {i: [i] for i in range(len(x))}

    def far(a, b):
        p = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
        if link == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"single": p.min(), "complete": p.max(), "average": p.mean()}[link]

    out = []
    while len(groups) > 1:
        d, a, b = min((round(far(groups[a], groups[b]), 8), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        out.append((a, b, d, len(groups[a]) + len(groups[b])))
        groups[a] += groups.pop(b)
    return sorted(out)


@pytest.mark.parametrize("link", linkage.LINKS)
def test_links(spark, link):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1, (6, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    pairs = linkage.pair_distances(df, "id", "v", link)
    got = linkage.agglomerate(pairs, link)
    want = plain_tree(x, link)
    assert sorted((r.x, r.y, round(r.height, 6), r.size) for r in got.collect()) == [(a, b, round(h, 6), n) for a, b, h, n in want]
    ids = df.select("id").where("id < 99")
    parts = {}
    for r in linkage.cut_tree(ids, got, clusters=3).collect():
        parts.setdefault(r.component, set()).add(r.id)
    low = sorted(want, key=lambda m: m[2])[: len(x) - 3]
    names = {i: i for i in range(len(x))}
    for a, b, _, _ in low:
        names = {i: a if c == b else c for i, c in names.items()}
    assert sorted(map(sorted, parts.values())) == sorted(sorted(i for i in names if names[i] == c) for c in set(names.values()))
    h = want[len(want) // 2][2]
    some = linkage.agglomerate(pairs, link, height=h)
    assert sorted((r.x, r.y) for r in some.collect()) == [(a, b) for a, b, d, _ in want if d <= h + 1e-9]


def test_links_of_few_rows(spark):
    empty = spark.createDataFrame([], "x long, y long, d double")
    assert linkage.agglomerate(empty, "average").count() == 0
    equal = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if i != j], "x long, y long, d double")
    assert [r.height for r in linkage.agglomerate(equal, "complete").collect()] == [1.0] * 5


def test_bounded_search_keeps_the_best(spark):
    x, y = bumps(np.random.default_rng(6), 90, 30)
    df = series_frame(spark, x, y)
    want = symbols.best_shapelets(df, "id", "s", "label", [8, 12], 5)
    got, report = shapelet_search.bounded_search(df, "id", "s", "label", [8, 12], 5)
    plain = lambda best: [(b["series_id"], b["start"], b["length"], b["class"], round(b["quality"], 6)) for b in best]
    assert plain(got) == plain(want)
    r = report.orderBy("round").collect()
    done, whole = sum(a.candidates * a.series for a in r), r[0].candidates * len(x)
    assert sum(a.series for a in r) == len(x) and done < 0.9 * whole, done / whole


def test_no_candidate_passes_its_bound(spark):
    x, y = bumps(np.random.default_rng(1), 60, 24)
    df = series_frame(spark, x, y)
    c = symbols.shapelet_candidates(df, "id", "s", "label", [10]).select("series_id", "class", "start", "length")
    sizes = df.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("size"))
    whole = symbols._f_statistic(shapelet_search.judged(c, df, df, "id", "s", "label"), shapelet_search.KEY)
    for part in ("id < 20", "id % 7 <> 0", "true"):
        b = shapelet_search.f_bounds(shapelet_search.judged(c, df, df.where(part), "id", "s", "label"), sizes)
        both = b.join(whole, shapelet_search.KEY)
        assert both.count() == whole.count() and both.where("bound < f_statistic - 1e-9").count() == 0
    assert both.where("bound > f_statistic + 1e-6").count() == 0  # all seen: the bound is the value
    none = shapelet_search.f_bounds(shapelet_search.judged(c, df, df.where("label = 0"), "id", "s", "label"), sizes)
    assert none.where("bound < double('infinity')").count() == 0


def test_word_powers(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i) % 3, 0, "".join(rng.choice(list("abc"), 5, p=[0.6, 0.3, 0.1]))) for i in rng.integers(0, 40, 300)]
    masks = [[0, 1], [2], [3, 4]]
    near, power = shapelet_search.word_powers(spark.createDataFrame(rows, "series_id long, class int, start int, word string"), masks, 5)
    of, cls = {}, {i: c for i, c, _, _ in rows}
    for i, _, _, w in rows:
        of.setdefault(w, set()).add(i)
    hide = lambda w, m: "".join("*" if i in m else a for i, a in enumerate(w))
    want, powers = {}, {}
    for w in of:
        for m in masks:
            for i in set().union(*(of[v] for v in of if hide(v, m) == hide(w, m))):
                want[w, cls[i]] = want.get((w, cls[i]), 0) + 1
        d = [2 * want.get((w, c), 0) - len(masks) * sum(v == c for v in cls.values()) for c in range(3)]
        powers[w] = sum(map(abs, d)) - abs(max(d)) - abs(min(d)) + max(d) - min(d)
    assert {(r["word"], r["class"]): r.near for r in near.collect()} == want and {r["word"]: r.power for r in power.collect()} == powers


def test_hashed_search(spark):
    x, y = bumps(np.random.default_rng(9), 90, 30)
    df = series_frame(spark, x, y)
    best = shapelet_search.hashed_search(df, "id", "s", "label", [12], 3, words=40)
    scored = {(r.series_id, r.start): r.f_statistic for r in symbols.scored_candidates(df, "id", "s", "label", [12]).collect()}
    assert len(best) == 3 and all(abs(scored[b["series_id"], b["start"]] - b["quality"]) < 1e-6 for b in best)
    assert best[0]["quality"] > np.quantile(list(scored.values()), 0.9)


@pytest.mark.parametrize("case", ["clusters", "one point", "few", "copies"])
def test_pivot_knn(spark, case):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.5, (150, 4)) for c in (0, 8, 20)])
    if case == "one point":
        x[:] = 1.0
    elif case == "copies":
        x[100:300] = x[0]
    elif case == "few":
        x = x[:5]
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(9000, 0, None)], "id long, label int, v array<double>")
    got, met = pivots.pivot_knn(df, df, 4, "id", "v", "label", ring=16)
    want = distances.knn_join(df, df, 4, "id", "v", "label")
    plain = lambda f: sorted((r["query"], r["actual"], r.neighbour, r.label, round(r.distance, 9), r["rank"]) for r in f.collect())
    assert plain(got) == plain(want)
    total = met.agg(F.sum("met")).first()[0]
    assert total <= len(x) ** 2 and (case != "clusters" or total < len(x) ** 2 / 3), total / len(x) ** 2
    if case != "clusters":
        return
    other = df.where("id < 60")
    assert plain(pivots.pivot_knn(other, df, 2, "id", "v", "label", pivots=5)[0]) == plain(distances.knn_join(other, df, 2, "id", "v", "label"))
    assert pivots.pivot_knn(df.limit(0), df, 2, "id", "v", "label")[0].count() == pivots.pivot_knn(df, df.limit(0), 2, "id", "v", "label")[0].count() == 0
