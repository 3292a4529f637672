"""Local descriptors against a plain version, and their bags."""

import numpy as np
import pytest

from tidemill.operators import descriptors as local
from tidemill.operators import distances, symbols


def plain(x, blocks, width, scales, dense=False):
    """Descriptors of one series, point by point."""
    n = len(x)

    def smooth(sigma):
        r = int(np.ceil(3 * sigma))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        return np.array([sum(k[j + r] * x[min(max(i + j, 0), n - 1)] for j in range(-r, r + 1)) / k.sum() for i in range(n)])

    space = [smooth(1.6 * 2 ** (i / 2)) for i in range(scales)]
    d = [b - a for a, b in zip(space, space[1:], strict=False)]
    points = [(s, t) for s in range(scales) for t in range(0, n, 4)] if dense else []
    for s in range(1, len(d) - 1):
        for t in range(1, n - 1):
            near = [d[s + i][t + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
            if not dense and (d[s][t] > max(near) or d[s][t] < min(near)):
                points.append((s, t))
    out = []
    for s, t in points:
        g, half, row = np.gradient(space[s]), blocks * width // 2, []
        for b in range(blocks):
            part = []
            for i in range(b * width, (b + 1) * width):
                p = t - half + i
                part.append((g[p] if 0 <= p < n else 0.0) * np.exp(-0.5 * ((i - half + 0.5) / half) ** 2))
            row += [sum(v for v in part if v > 0), sum(-v for v in part if v < 0)]
        out.append(row)
    return sorted(map(tuple, np.round(out, 9).tolist()))


@pytest.mark.parametrize("dense", [False, True])
def test_descriptors(spark, dense):
    x = np.random.default_rng(2).normal(size=(6, 50))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(8, x[0][:30].tolist()), (9, [1.0] * 50), (10, None), (11, [2.0]), (12, [])]
    df = spark.createDataFrame(rows, "id long, s array<double>")
    got = {}
    for r in local.local_descriptors(df, ["id"], "s", 4, 4, dense).collect():
        got.setdefault(r.id, []).append(tuple(round(v, 9) + 0.0 for v in r.d))
    for i, v in rows[:7]:
        want = plain(np.array(v), 4, 4, 6, dense)
        own = sorted(got.get(i, []))
        assert len(want) == len(own) and np.allclose(own, want, atol=1e-8)
    assert sum(map(len, got.values())) > 10 and 10 not in got and 12 not in got and (dense or (9 not in got and 11 not in got))


def test_bags_tell_shapes_apart(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (60, 64))
    for i in range(60):
        at = rng.integers(0, 40)
        x[i, at : at + 20] += np.hanning(20) * 4 if i % 2 else np.sin(np.arange(20) / 2) * 3
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(99, 0, [0.0] * 64), (98, 0, None)], "id long, label int, s array<double>")
    words = local.DescriptorWords(12, dense=True).fit(df.where("id < 90"), "s")
    got = {r.id: r for r in words.transform(df, "id", "s", "label").collect()}
    assert len(got) == 62 and got[98].bag == [0.0] * 12
    b = np.array([got[i].bag for i in range(60)])
    assert np.allclose((b * b).sum(1), 1)
    near = b @ b.T - 9 * np.eye(60)
    assert np.mean([near[i].argmax() % 2 == i % 2 for i in range(60)]) > 0.85


def test_windows_share_one_pass(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=(70, 24)), axis=1)
    x[60:] = x[:10]
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(90, 1, None)], "id long, label int, s array<double>")
    windows = [0.2, 0.05, 1.0]
    got = distances.windows_nearest(df, df, "id", "s", "label", windows).collect()
    assert len(got) == 3 * 70
    scores = {r.setting: r for r in distances.window_search(df, df, "id", "s", "label", windows).collect()}
    for k, w in enumerate(windows):
        want = {r["query"]: (r.neighbour, round(r.distance, 9)) for r in distances.nearest(df, df, "id", "s", "label", "dtw", window=w).collect()}
        assert {r["query"]: (r.neighbour, round(r.distance, 9)) for r in got if r.setting == k} == want
        assert abs(scores[k].accuracy - np.mean([i % 3 == n % 3 for i, (n, _) in want.items()])) < 1e-9 and scores[k].window == w
    assert sum(r.met for r in got) < 0.6 * 3 * 70 * 69


def test_nearest_histogram(spark):
    rng = np.random.default_rng(6)
    bags = {i: {f"w{w}": int(rng.integers(1, 6)) for w in rng.choice(30, int(rng.integers(1, 5)), replace=False)} for i in range(40)}
    bags |= {50: {"alone": 9}, 51: {"other": 1}, 52: {"third": 1}}
    got = {r.a: (r.b, r.distance) for r in symbols.nearest_histogram(spark.createDataFrame([(i, w, n) for i, b in bags.items() for w, n in b.items()], "id long, word string, n long"), "id").collect()}
    far = lambda a, b: sum((a.get(w, 0) - b.get(w, 0)) ** 2 for w in a.keys() | b.keys())
    assert got == {i: min((far(bags[i], bags[j]), j) for j in bags if j != i)[::-1] for i in bags}
