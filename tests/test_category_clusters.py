"""Information clusters, item clusters and rotation forests against plain versions."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import category_clusters, refined, rotation, string_kernels
from tidemill.streaming import operators as streaming


def seeded(seed, *values):
    return int(hashlib.md5(":".join([str(seed), *map(str, values)]).encode()).hexdigest()[:15], 16)


def plain_information(counts, k, parts, seed, sweeps):
    docs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    x = np.array([[counts[d].get(w, 0) for w in words] for d in docs], float)
    x /= x.sum(1, keepdims=True)
    mass = 1 / len(docs)
    at = np.array([seeded(seed + 1, d) % k for d in docs])
    part = np.array([seeded(seed, d) % parts for d in docs])
    entropy = lambda v: -(v[v > 0] * np.log(v[v > 0])).sum()
    known = []
    for _ in range(sweeps):
        moved = 0
        for g in range(parts):
            later = at.copy()
            for i in np.flatnonzero(part == g):
                costs = []
                for t in range(k):
                    members = [j for j in range(len(docs)) if at[j] == t and j != i]
                    if not members:
                        costs.append(0.0)
                        continue
                    m, q = len(members) * mass, x[members].mean(0)
                    a, b = mass / (m + mass), m / (m + mass)
                    costs.append(round((m + mass) * (entropy(a * x[i] + b * q) - a * entropy(x[i]) - b * entropy(q)) / mass, 9))
                later[i] = min(range(k), key=lambda t: (costs[t], t))
            moved += (later != at).sum()
            at = later
        j = np.array([x[at == t].sum(0) * mass for t in range(k)])
        outer = j.sum(1, keepdims=True) * j.sum(0)
        known.append((j[j > 0] * np.log(j[j > 0] / outer[j > 0])).sum())
        if not moved:
            break
    return dict(zip(docs, at.tolist(), strict=True)), known


def test_information_clusters(spark):
    rng = np.random.default_rng(3)
    counts = {}
    for d in range(45):
        own = [f"t{d % 3}w{i}" for i in range(12)]
        counts[d] = {}
        for w in [*rng.choice(own, 14), *rng.choice([f"c{i}" for i in range(8)], 6)]:
            counts[d][str(w)] = counts[d].get(str(w), 0) + 1
    rows = [(d, w, n) for d, c in counts.items() for w, n in c.items()] + [(None, "a", 1), (90, None, 3), (91, "a", 0)]
    got, known = category_clusters.information_clusters(spark.createDataFrame(rows, "doc long, word string, n int"), 3, sweeps=3, parts=2)
    want, plain = plain_information(counts, 3, 2, 1, 3)
    assert {r.doc: r.cluster for r in got.collect()} == want
    assert np.allclose(known, plain) and len({(c, d % 3) for d, c in want.items()}) == 3  # the planted topics
    none, nothing = category_clusters.information_clusters(spark.createDataFrame([], "doc long, word string, n int"), 3)
    assert none.count() == 0 and nothing == []


@pytest.mark.parametrize("held", [0, 5, 1 << 18])
def test_information_clusters_by_spread_of_words(spark, monkeypatch, held):
    monkeypatch.setattr(category_clusters, "PIECE", 3)  # a document's words lie in several rows
    rng = np.random.default_rng(4)
    counts = {d: {f"t{d % 3}w{w}": int(rng.integers(1, 4)) for w in rng.choice(12, 7, False)} | {f"c{w}": 1 for w in rng.choice(8, 3, False)} | ({f"own{d}": 2} if d % 2 else {}) for d in range(40)}
    counts |= {40: {"alone": 1}, 41: {"c1": 1}}
    rows = [(d, w, n) for d, c in counts.items() for w, n in c.items()]
    got, known = category_clusters.information_clusters(spark.createDataFrame(rows, "doc long, word string, n int"), 3, sweeps=3, parts=2, held=held)
    want, plain = plain_information(counts, 3, 2, 1, 3)
    assert {r.doc: r.cluster for r in got.collect()} == want and np.allclose(known, plain)


def plain_items(baskets, r, parts, seed, sweeps):
    sets = {}
    for i, items in baskets:
        s = tuple(sorted({x for x in items or [] if x is not None}))
        if s:
            a, n = sets.get(s, (i, 0))
            sets[s] = (min(a, i), n + 1)
    rows = {a: (frozenset(s), n) for s, (a, n) in sets.items()}
    part = {a: seeded(seed, a) % parts for a in rows}
    at = {}

    def profit(members):
        n = sum(rows[m][1] for m in members)
        items = sum(rows[m][1] * len(rows[m][0]) for m in members)
        return items * n / len(set().union(*(rows[m][0] for m in members))) ** r if members else 0.0

    for _ in range(sweeps):
        moved = False
        for g in range(parts):
            clusters = {}
            for m, c in at.items():
                clusters.setdefault(c, set()).add(m)
            wishes = {}
            for m in sorted(x for x in rows if part[x] == g):
                best = None
                for c, members in clusters.items():
                    rest = members - {m}
                    if rest and any(rows[m][0] & rows[o][0] for o in members):
                        k = (round(-(profit(rest | {m}) - profit(rest)), 9), at.get(m) != c, c)
                        best = k if best is None or k < best else best
                alone = round(profit({m}), 9)
                wishes[m] = (best is None or alone > -best[0], best[2] if best else None)
            single = {m for m, c in at.items() if len(clusters[c]) == 1}
            opens = [m for m, (wants, _) in wishes.items() if wants and m not in single]
            first = min(opens, key=lambda m: (-rows[m][1], m), default=None)
            for m, (wants, to) in wishes.items():
                new = m if m == first else at[m] if wants and m in single else to if to is not None else at.get(m)
                moved |= new != at.get(m)
                if new is not None:
                    at[m] = new
            names = {}
            for m, c in at.items():
                names[c] = min(m, names.get(c, m))
            at = {m: names[c] for m, c in at.items()}
        if not moved:
            break
    return {i: at.get(sets[s][0]) if (s := tuple(sorted({x for x in items or [] if x is not None}))) else None for i, items in baskets}


@pytest.mark.parametrize("repulsion", [2.6, 1.2])
def test_item_clusters(spark, repulsion):
    rng = np.random.default_rng(5)
    baskets = []
    for i in range(60):
        base = [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "a"]][i % 3]
        baskets.append((i, [*base[: int(rng.integers(2, 4))], *(["z"] if i % 7 == 0 else [])]))
    baskets += [(100, []), (101, None), (102, [None]), (103, ["a", "a", None, "b"])]
    got = category_clusters.item_clusters(spark.createDataFrame(baskets, "id long, items array<string>"), repulsion, sweeps=4)
    assert {r.id: r.cluster for r in got.collect()} == plain_items(baskets, repulsion, 2, 1, 4)


def test_rotations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))
    y = rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(v.tolist(), float(c), i * 7919) for i, (v, c) in enumerate(zip(x, y, strict=True))], "__x array<double>, __y double, __u long").repartition(3)
    turns = rotation.random_turns(7, 3, 2, 3, 1)
    assert all(len(p) == 3 and len(set(p)) == 3 for t in turns for p in t.groups) and all({i for p in t.groups for i in p} == set(range(7)) for t in turns)
    sums = rotation.group_sums(rows, turns, keep=1.0)
    for (t, g), (n, s, q) in sums.items():
        own = x[np.isin(y, turns[t].classes[g])][:, turns[t].groups[g]]
        assert n == len(own) and np.allclose(s, own.sum(0)) and np.allclose(q, own.T @ own)
    half = rotation.group_sums(rows, turns)
    assert all(0.3 < half[k][0] / sums[k][0] < 0.7 for k in sums)
    for t, m in enumerate(rotation.rotations(turns, sums, 7)):
        for g, at in enumerate(turns[t].groups):
            block = m[at][:, 3 * g : 3 * g + 3]
            own = x[np.isin(y, turns[t].classes[g])][:, at]
            turned = (own - own.mean(0)) @ block
            c = np.cov(turned.T)
            assert np.allclose(block.T @ block, np.eye(3)) and np.allclose(c, np.diag(np.diag(c)), atol=1e-6) and (np.diff(np.diag(c)) <= 1e-9).all()


def test_rotation_forest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = np.where(x[:, 0] + x[:, 1] + x[:, 2] - x[:, 3] > 0, "up", "down")
    rows = [(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, "up"), (901, [0.0] * 4, None)], "id long, x array<double>, y string")
    model = rotation.RotationForest(trees=6, depth=3).fit(df.where("id < 200 or id >= 900"), "id", "x", "y")
    got = model.predict(df.where("id between 200 and 899"), ["id", "y"], "x").collect()
    assert len(got) == 200 and all(abs(sum(r.probs) - 1) < 1e-9 for r in got)
    assert np.mean([r.predicted == r.y for r in got]) > 0.8 and math.isclose(len({tuple(r.probs) for r in got}) > 3, True)


def test_nested_dichotomies(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 3)) * 5
    y = np.arange(250) % 5
    x = centres[y] + rng.normal(size=(250, 3))
    rows = [(i, v.tolist(), "abcde"[c]) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, "a"), (901, [0.0] * 3, None)], "id long, features array<double>, label string")
    model = refined.NestedDichotomies("tree", maxDepth=3).fit(df.where("id < 150"), "features", "label")
    assert len(model.nodes) == 4 and sorted(model.nodes[0][0] + model.nodes[0][1]) == [0, 1, 2, 3, 4] and all(not set(a) & set(b) for a, b in model.nodes)
    got = model.predict(df.where("id between 150 and 899"), ["id", "label"], "features").collect()
    assert len(got) == 100 and all(abs(sum(r.probs) - 1) < 1e-9 for r in got) and np.mean([r.predicted == r.label for r in got]) > 0.85
    one = refined.NestedDichotomies().fit(df.where("label = 'a'"), "features", "label")
    assert {r.predicted for r in one.predict(df.where("id < 9"), ["id"], "features").collect()} == {"a"}


def test_discriminative_bayes(spark):
    rng = np.random.default_rng(9)
    labels = {d: "xyz"[d % 3] for d in range(30)}
    counts = {(d, f"w{w}"): int(rng.integers(1, 4)) for d in range(30) for w in {*rng.integers(0, 20, 6).tolist(), 20 + d % 3}}
    model = refined.DiscriminativeBayes(3).fit(spark.createDataFrame([(*k, n) for k, n in counts.items()] + [(99, "w1", 3)], "doc long, word string, f int"), spark.createDataFrame([*labels.items(), (50, None)], "doc long, class string"))
    n, vocabulary = {}, len({w for _, w in counts})

    def probabilities(words):
        z = {c: math.log(10 / 30) + sum(f * math.log((n.get((w, c), 0) + 1) / (sum(v for (_, k), v in n.items() if k == c) + vocabulary)) for w, f in words.items()) for c in "xyz"}
        e = {c: math.exp(v - max(z.values())) for c, v in z.items()}
        return {c: v / sum(e.values()) for c, v in e.items()}

    docs = {d: {w: f for (k, w), f in counts.items() if k == d} for d in labels}
    for _ in range(3):
        p = {d: probabilities(docs[d])[labels[d]] for d in labels}
        for (d, w), f in counts.items():
            n[w, labels[d]] = n.get((w, labels[d]), 0) + f * (1 - p[d])
    got = {(r["word"], r["class"]): r.n for r in model.counts.collect()}
    assert set(got) == set(n) and all(abs(got[k] - n[k]) < 1e-9 for k in n)
    ask = spark.createDataFrame([(1, "w20", 2), (1, "new", 5), (2, "w22", 1)], "doc long, word string, f int")
    said = {r.doc: (r.predicted, r.p) for r in model.predict(ask, spark.createDataFrame([(1,), (2,), (3,)], "doc long")).collect()}
    for d, words in {1: {"w20": 2, "new": 5}, 2: {"w22": 1}, 3: {}}.items():
        p = probabilities(words)
        assert abs(said[d][1] - max(p.values())) < 1e-9 and p[said[d][0]] > max(p.values()) - 1e-9


def test_category_clusters_of_a_stream(spark):
    rng = np.random.default_rng(10)
    kinds = [("a", "x", "1"), ("b", "y", "2"), ("c", "z", None)]
    batches = [[tuple(v if rng.random() < 0.9 else "q" for v in kinds[int(rng.integers(3))]) for _ in range(25)] for _ in range(3)]
    state = streaming.TableState(spark, "cluster long, column string, value string, n double")
    step = streaming.category_sink(["p", "q", "r"], state)
    clusters = {}  # number -> (size, counts)
    for number, rows in enumerate(batches):
        step(spark.createDataFrame(rows, "p string, q string, r string"), number)
        left = {}
        for r in rows:
            p = tuple("" if v is None else f"={v}" for v in r)
            left[p] = left.get(p, 0) + 1

        def add(c, p, w):
            size, n = clusters.get(c, (0, {}))
            clusters[c] = (size + w, n | {(i, v): n.get((i, v), 0) + w for i, v in enumerate(p)})

        def part(c):
            return sum(v * v for v in clusters[c][1].values()) / clusters[c][0]

        def best(p, w):
            whole, k = sum(map(part, clusters)), len(clusters)
            out = []
            for c, (size, n) in clusters.items():
                grown = sum((v + w * (p[i] == x)) ** 2 for (i, x), v in n.items()) + sum(w * w for i, x in enumerate(p) if (i, x) not in n)
                out.append((-round((whole - part(c) + grown / (size + w)) / k, 9), c))
            own = round((whole + 3 * w) / (k + 1), 9)
            return (None, True) if not out else (min(out)[1], own > -min(out)[0])

        while opens := [p for p, w in left.items() if best(p, w)[1]]:
            p = min(opens, key=lambda p: (-left[p], p))
            add(max(clusters, default=-1) + 1, p, left.pop(p))
        for p, c in [(p, best(p, w)[0]) for p, w in left.items()]:
            add(c, p, left[p])
    want = {(c, "pqr"[i], v): n for c, (_, counts) in clusters.items() for (i, v), n in counts.items()} | {(c, "", ""): size for c, (size, _) in clusters.items()}
    assert {(r.cluster, r.column, r.value): r.n for r in state.before().collect()} == want
    told = streaming.category_clusters(spark.createDataFrame([("a", "x", "1"), ("c", "z", None), ("?", "?", "?")], "p string, q string, r string"), ["p", "q", "r"], state.before()).collect()
    assert {r.p: r.cluster for r in told}["?"] is None and {r.p: r.cluster for r in told}["a"] is not None


def plain_kernel(a, b, k, decay):
    spans = lambda x: [("".join(x[i] for i in at), at[-1] - at[0] + 1) for at in itertools.combinations(range(len(x)), k)]
    return sum(decay ** (m + n) for u, m in spans(a) for v, n in spans(b) if u == v)


@pytest.mark.parametrize(("length", "decay"), [(1, 0.5), (2, 0.5), (3, 0.7)])
def test_subsequence_kernel(spark, length, decay):
    rng = np.random.default_rng(1)
    words = ["", "a", "ab", "axb", "abb", "cat", "car", "bat", "é😀é", *("".join(rng.choice(list("abc"), int(rng.integers(3, 9)))) for _ in range(8))]
    pairs = list(itertools.product(words, words))
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    got = df.select("a", "b", string_kernels.subsequence_kernel(F.col("a"), F.col("b"), length, decay).alias("k"), string_kernels.subsequence_kernel(F.col("a"), F.col("b"), length, decay, True).alias("n")).collect()
    assert len(got) == len(pairs) + 2
    for r in got:
        if r.a is None or r.b is None:
            assert r.k is None and r.n is None
            continue
        own = plain_kernel(r.a, r.a, length, decay) * plain_kernel(r.b, r.b, length, decay)
        assert abs(r.k - plain_kernel(r.a, r.b, length, decay)) < 1e-9 and abs(r.n - (r.k / math.sqrt(own) if own else 0)) < 1e-9


def test_ordered_classes(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 4, 240)
    y = np.minimum(3, np.floor(x + rng.normal(0, 0.1, 240)).clip(0)).astype(int)
    df = spark.createDataFrame([(i, [float(v), 0.0], int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(900, None, 1), (901, [0.0, 0.0], None)], "id long, x array<double>, y int")
    model = refined.OrderedClasses("tree", maxDepth=2).fit(df.where("id < 160"), "x", "y")
    got = model.predict(df.where("id between 160 and 899"), ["id", "y"], "x").collect()
    assert len(got) == 80 and all(abs(sum(r.probs) - 1) < 1e-9 and len(r.probs) == 4 for r in got)
    assert np.mean([r.predicted == r.y for r in got]) > 0.85
    one = refined.OrderedClasses().fit(df.where("y = 2"), "x", "y").predict(df.where("id < 3"), ["id"], "x").collect()
    assert {(r.predicted, tuple(r.probs)) for r in one} == {(2, (1.0,))}
