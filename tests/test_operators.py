"""Distances against plain loops, sources round trip, streams equal batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import columns, distances, sampling, scoring, tests
from tidemill.sources import files
from tidemill.streaming import operators as streaming


def dtw_loop(a, b, w):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            if abs(i - j) < w:
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_dtw_against_loop():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    for window, w in ((1.0, 13), (0.25, 3)):
        assert np.allclose(distances.dtw(a, b, window), [dtw_loop(x, y, w) for x, y in zip(a, b, strict=True)])
    assert np.allclose(distances.dtw(a, b, 0.01), ((a - b) ** 2).sum(1))


def erp_loop(a, b, g=0.0):
    d = np.zeros((len(a) + 1, len(b) + 1))
    d[1:, 0], d[0, 1:] = np.cumsum((a - g) ** 2), np.cumsum((b - g) ** 2)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] - b[j - 1]) ** 2, d[i - 1, j] + (a[i - 1] - g) ** 2, d[i, j - 1] + (b[j - 1] - g) ** 2)
    return np.sqrt(d[-1, -1])


def lcss_loop(a, b, epsilon=0.2, delta=10):
    d = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = abs(a[i - 1] - b[j - 1]) <= epsilon and abs(i - j) <= delta
            d[i, j] = d[i - 1, j - 1] + 1 if same else max(d[i - 1, j], d[i, j - 1])
    return 1 - d[-1].max() / len(a)


def msm_loop(a, b, c=0.1):
    def gap(new, x, y):
        return c if min(x, y) <= new <= max(x, y) else c + min(abs(new - x), abs(new - y))

    d = np.zeros((len(a), len(b)))
    for i in range(len(a)):
        for j in range(len(b)):
            ways = [abs(a[i] - b[j]) + (d[i - 1, j - 1] if i and j else 0)] if (i and j) or i == j else []
            ways += [d[i - 1, j] + gap(a[i], a[i - 1], b[j])] if i else []
            ways += [d[i, j - 1] + gap(b[j], a[i], b[j - 1])] if j else []
            d[i, j] = min(ways)
    return d[-1, -1]


def twe_loop(a, b, nu=0.001, penalty=1.0):
    a, b = np.r_[0, a], np.r_[0, b]
    d = np.full((len(a), len(b)), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a)):
        for j in range(1, len(b)):
            d[i, j] = min(
                d[i - 1, j - 1] + (a[i] - b[j]) ** 2 + (a[i - 1] - b[j - 1]) ** 2 + 2 * nu * abs(i - j),
                d[i - 1, j] + (a[i] - a[i - 1]) ** 2 + nu + penalty, d[i, j - 1] + (b[j] - b[j - 1]) ** 2 + nu + penalty,
            )
    return d[-1, -1]


def wdtw_loop(a, b, g=0.05):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(n):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 / (1 + np.exp(-g * (abs(i - j) - n / 2))) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@pytest.mark.parametrize("name, loop", [("erp", erp_loop), ("lcss", lcss_loop), ("msm", msm_loop), ("twe", twe_loop), ("wdtw", wdtw_loop)])
def test_kernels_against_loops(name, loop):
    rng = np.random.default_rng(11)
    for n in (2, 3, 13, 25):
        a, b = np.round(rng.normal(size=(6, n)), 1), np.round(rng.normal(size=(6, n)), 1)
        assert np.allclose(distances.KERNELS[name](a, b), [loop(x, y) for x, y in zip(a, b, strict=True)])


@pytest.mark.parametrize("name", sorted(distances.KERNELS))
def test_identity_and_symmetry(name):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(4, 9)), rng.normal(size=(4, 9))
    k = distances.KERNELS[name]
    assert np.allclose(k(a, a), 0)
    assert np.allclose(k(a, b), k(b, a))


def test_pruned_equals_unpruned(spark):
    rng = np.random.default_rng(3)
    for size, rows, window in ((20, 40, 0.2), (300, 60, 0.1), (1, 12, 0.1)):
        df = spark.createDataFrame([(i, i % 3, [float(v) for v in rng.normal(size=size)]) for i in range(rows)], "id long, label int, s array<double>")
        a = distances.pruned_nearest(df, df, "id", "s", "label", window).select("query", "neighbour").orderBy("query").collect()
        b = distances.nearest(df, df, "id", "s", "label", "dtw", window=window).select("query", "neighbour").orderBy("query").collect()
        assert a == b and len(a) == rows
    uneven = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [1.0])], "id long, label int, s array<double>")
    for name in ("pruned", "euclidean"):
        with pytest.raises(Exception, match="length"):
            (distances.pruned_nearest if name == "pruned" else distances.nearest)(uneven, uneven, "id", "s", "label").collect()


def test_knn_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (70, 6)).astype(float)  # many ties
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, label int, s array<double>")
    for name, far in (("euclidean", lambda u: ((x - u) ** 2).sum(1)), ("manhattan", lambda u: np.abs(x - u).sum(1)), ("chebyshev", lambda u: np.abs(x - u).max(1))):
        want = {(i, r, j) for i in range(70) for r, j in enumerate(sorted((j for j in range(70) if j != i), key=lambda j: (far(x[i])[j], j))[:4], 1)}
        assert {(r.query, r["rank"], r.neighbour) for r in distances.knn_join(df, df, 4, "id", "s", "label", name).collect()} == want


def test_arff_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "a b"), (None, "it's"), (3.0, None)], "x double, y string")
    files.write_arff(df, str(tmp_path / "t"))
    assert {tuple(r) for r in files.read_arff(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in df.collect()}


def test_svmlight_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, {1: 0.5, 7: 2.0}), (0.0, {2: 1.0})], "label double, features map<int,double>")
    files.write_svmlight(df, str(tmp_path / "t"))
    assert sorted(map(str, files.read_svmlight(spark, str(tmp_path / "t")).collect())) == sorted(map(str, df.collect()))


def test_power_inverses(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (7.0,)], "x double")
    for p in (0.0, 0.5, 2.0):
        r = df.select((tests.box_cox_inverse(tests.box_cox(F.col("x"), p), p) - F.col("x")).alias("a"), (tests.yeo_johnson_inverse(tests.yeo_johnson(-F.col("x"), p), p) + F.col("x")).alias("b")).collect()
        assert all(abs(v) < 1e-9 for row in r for v in row)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 4.0, None), (3, 2.0, "a")], "id int, x double, y string")
    assert [(r.x, r.y) for r in columns.impute(df, ["x"], ["y"]).orderBy("id").collect()] == [(3.0, "a"), (4.0, "a"), (2.0, "a")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, t, float(u * t % 7)) for u in range(3) for t in range(10)]
    df = spark.createDataFrame(rows, "u long, t long, v double")
    df.where("t < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("t >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = streaming.TableState(spark, "u long, t long, v double", str(tmp_path / "held"))
    source = lambda: streaming.row_source(spark, str(tmp_path / "in"), df.schema)
    q = source().writeStream.foreachBatch(streaming.reservoir_sink(7, "t", 1, held)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(r.t for r in sampling.reservoir(df, "t", 7, 1).collect())
    # a state opened anew, as after a restart, has the sample
    assert sorted(r.t for r in streaming.TableState(spark, held.schema, held.path).before().collect()) == want
    d = streaming.run_to_table(streaming.delta(source(), "u", "t", "v"))
    got = {(r.u, r.t): r.delta for r in d.collect()}
    assert all(got[u, t] == (None if t == 0 else v - float(u * (t - 1) % 7)) for u, t, v in rows)


def test_relief_judges_every_row(spark):
    rng = np.random.default_rng(4)
    x, y = rng.random((30, 3)), np.arange(30) % 3 // 2
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(30)], "id long, label int, s array<double>")
    z = (x - x.min(0)) / (x.max(0) - x.min(0))
    want = np.zeros(3)
    for i in range(30):
        for c in (0, 1):
            rest = [j for j in range(30) if j != i and y[j] == c]
            near = sorted(rest, key=lambda j: np.abs(z[i] - z[j]).sum())[:4]
            want += (-1 if c == y[i] else 1) * np.abs(z[near] - z[i]).sum(0) / 4 / 30
    got = {r.attribute: r.weight for r in scoring.relief(df, "id", "s", "label", 3, 4).collect()}
    assert np.allclose([got[i] for i in range(3)], want)


def test_cuts_against_plain_versions(spark):
    rng = np.random.default_rng(15)
    v = np.round(np.r_[rng.normal(0, 1, 300), rng.normal(4, 1, 200), rng.normal(9, 0.5, 100)], 2)
    y = np.r_[np.zeros(300), np.ones(200), np.zeros(100)].astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, y, strict=True)], "v double, y int")

    def bits(c):
        return -sum(x / sum(c) * np.log2(x / sum(c)) for x in c if x)

    def split(rows):
        values = sorted({r[0] for r in rows})
        counts = lambda part: [sum(r[1] == c for r in part) for c in (0, 1)]
        best = None
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[0] <= a], [r for r in rows if r[0] > a]
            h = (len(low) * bits(counts(low)) + len(high) * bits(counts(high))) / len(rows)
            if best is None or h < best[0] - 1e-12:
                best = (h, (a + b) / 2, low, high)
        if best is None:
            return []
        h, cut, low, high = best
        ks = [sum(x > 0 for x in counts(p)) for p in (rows, low, high)]
        delta = np.log2(3 ** ks[0] - 2) - (ks[0] * bits(counts(rows)) - ks[1] * bits(counts(low)) - ks[2] * bits(counts(high)))
        if bits(counts(rows)) - h <= (np.log2(len(values) - 1) + delta) / len(rows):
            return []
        return [*split(low), cut, *split(high)]

    assert np.allclose(columns.mdl_cuts(df, "v", "y"), split(list(zip(v.tolist(), y.tolist(), strict=True))))
    assert len(columns.mdl_cuts(df, "v", "y", True)) >= 2

    def even(values, bins):
        n = {x: values.count(x) for x in sorted(set(values))}
        keys, cuts, base, seen, last = list(n), [], 0, 0, None
        for a, b in zip(keys, keys[1:], strict=False):
            if bins - len(cuts) <= 1:
                break
            seen += n[a]
            target = (len(values) - base) / (bins - len(cuts))
            if seen - base >= target:
                mid, upto = (a + b) / 2, seen
                if last and target - (last[1] - base) < seen - base - target:
                    mid, upto = last
                cuts.append(mid)
                base, last = upto, ((a + b) / 2, seen) if upto != seen else None
                while last and bins - len(cuts) > 1 and seen - base >= (len(values) - base) / (bins - len(cuts)):
                    cuts.append(last[0])
                    base, last = seen, None
            else:
                last = ((a + b) / 2, seen)
        return cuts

    for bins in (4, 10):
        assert np.allclose(columns.equal_frequency_cuts(df, "v", bins), even(v.tolist(), bins))
    assert len(columns.equal_frequency_cuts(df, "v", None)) == int(600**0.5) - 1


def test_ordered_helpers_with_ties_and_nulls(spark):
    from tidemill.operators import ordered

    rng = np.random.default_rng(3)
    rows = [(int(k), float(v), int(n)) for k, v, n in zip(rng.integers(0, 3, 400), rng.integers(0, 90, 400), rng.integers(1, 5, 400), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, n int")
    for down in (False, True):
        got = ordered.running_sums(df, "v", ["n"], ["k"], down, 7).collect()
        assert len(got) == 400 and all(r.n_upto == sum(n for k, v, n in rows if k == r.k and (v >= r.v if down else v <= r.v)) for r in got)
    x = [v for _, v, _ in rows]
    assert np.allclose(ordered.exact_quantiles(df, "v", [0, 0.1, 0.33, 1]), np.quantile(x, [0, 0.1, 0.33, 1]))
    distinct = sorted(set(x))
    after = {r.v: r.next for r in ordered.next_values(df.select("v").distinct(), "v").collect()}
    assert after == dict(zip(distinct, [*distinct[1:], None], strict=True))
    assert ordered.exact_quantiles(df.limit(0), "v", [0.5]) == []
