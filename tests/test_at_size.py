"""What showed only on larger tables: signs of rounded zeros, row numbers, many cut points, files of streams."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import columns, table
from tidemill.plans import catalog, streams


def test_rounded_elements_keep_their_sign(spark):
    df = spark.createDataFrame([([-1e-7, 1e-7, -0.25, -1e-17],)], "a array<double>")
    got = catalog.r6(df).first().a
    assert got == [0.0, 0.0, -0.25, 0.0] and [math.copysign(1, x) for x in got] == [-1, 1, -1, 1]


def test_transposed_channels_keep_the_sign_of_zero(spark, tmp_path):
    from tidemill.plans import series_queries

    x = [0.25] * 40 + [-1e-7] + [0.5] * 20 + [-0.75] * 3
    spark.createDataFrame([(1, 0, x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    r = series_queries.t_channels(spark, str(tmp_path)).first()
    assert [[w[t] for w in r.channels] for t in range(16)] == r.transposed
    assert math.copysign(1, r.channels[2][8]) == math.copysign(1, r.transposed[8][2]) == -1


def test_rows_are_numbered_in_order(spark):
    df = spark.range(0, 20_000, 1, 8).select("id", (F.xxhash64("id") % 50).alias("v"), F.repeat(F.lit("x"), 200).alias("wide"))
    got = [r.n for r in table.add_id(df, ["v", "id"], "n").orderBy("v", "id").select("n").collect()]
    assert got == list(range(1, 20_001))
    assert table.add_id(df.where("false"), ["v", "id"], "n").count() == 0
    plan = table.add_id(df, ["v", "id"], "n")._jdf.queryExecution().analyzed().toString()
    assert "Range (" not in plan  # ranges are written, not dealt once more


def test_many_cuts(spark):
    cuts = np.sort(np.random.default_rng(1).normal(size=1500)).tolist()
    x = [*np.random.default_rng(2).normal(size=300).tolist(), *cuts[:5], -99.0, 99.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    got = {r.i: r.b for r in df.select("i", columns.bin_of(F.col("v"), cuts).alias("b")).collect()}
    assert got == {i: None if v is None else int(np.searchsorted(cuts, v)) for i, v in enumerate(x)}


def test_streams_have_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    kept = []
    monkeypatch.setattr(streams.streaming, "row_source", lambda s, path, schema, files=1: kept.append((path, files)))
    for dealt in (True, False):
        streams.source(spark, str(tmp_path), "orders", dealt=dealt)
        path, files = kept[-1]
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
        assert files == 4 and len(sizes) == 12 and sum(sizes) == 1000 and max(sizes) <= 200


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    from tidemill.operators import distances, scoring, symbols

    rng = np.random.default_rng(5)
    s, c = rng.normal(size=(90, 6)).round(1), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, int(c[i]), s[i].tolist(), (s[i][::-1] ** 2).tolist()) for i in range(90)], "id long, c int, s array<double>, g array<double>").repartition(3)
    for name in ("BLOCK", "CELLS"):
        monkeypatch.setattr(distances, name, 40)
    gaps = np.abs(s[:, None] - s)
    d = (gaps**2).sum(2)
    got = {(r.x, r.y) for r in distances.radius_join(df, df, "id", "s", 2.0).collect()}
    assert got == {(i, j) for i in range(90) for j in range(90) if i != j and np.sqrt(d[i, j]) <= 2.0}
    e = (((s[:, ::-1] ** 2)[:, None] - s[:, ::-1] ** 2) ** 2).sum(2)
    want = []
    for w in np.linspace(0, np.pi / 2, 3):
        f = np.round(np.cos(w) * d + np.sin(w) * e, 6) + np.where(np.eye(90) > 0, np.inf, 0)
        want.append((c[f.argmin(1)] == c).mean())
    assert np.allclose([r.accuracy for r in distances.weighted_views(df, df, "id", "c", "s", "g", 3).orderBy("setting").collect()], want)
    calls = []
    inner = distances.block_pairs
    monkeypatch.setattr(distances, "block_pairs", lambda q, t, run, schema, *a, **k: calls.append(schema) or inner(q, t, run, schema, *a, **k))
    scoring.relief(df, "id", "s", "c", 6, 3).collect()
    assert "array" not in calls[0]  # a block pair returns no values, only neighbours

    n = rng.integers(0, 3, (90, 12))
    bags = spark.createDataFrame([(i, f"w{j}", int(n[i, j])) for i in range(90) for j in range(12) if n[i, j]], "id long, word string, n long")
    monkeypatch.setattr(symbols, "BAG_BLOCKS", 30)
    plain = symbols.boss_distance(bags, bags, "id").groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "m.b", "m.distance")
    near = symbols.nearest_boss(bags, "id")
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in plain.collect()}
    assert "Join" not in near._jdf.queryExecution().analyzed().toString()  # no row for each shared word of a pair
    m = n.astype(float)
    d = ((m[:, None] - m) ** 2).sum(2) + np.where(np.eye(90) > 0, np.inf, 0)
    assert {(r.a, r.b) for r in symbols.nearest_histogram(bags, "id").collect()} == {(i, int(d[i].argmin())) for i in range(90) if m[i].any()}
    shared = {(r.a, r.b): r.shared for r in symbols.histogram_intersection(bags, bags, "id").collect()}
    assert shared == {(i, j): float(np.minimum(m[i], m[j]).sum()) for i in range(90) for j in range(90) if i != j and (m[i] * m[j]).any()}


def test_candidates_are_judged_a_block_at_a_time(spark, monkeypatch):
    from tidemill.operators import distances, symbols

    rng = np.random.default_rng(6)
    y, x = rng.normal(size=(20, 24)), rng.normal(size=(5, 24))
    z = symbols._windows(x, 7).reshape(-1, 7)
    monkeypatch.setattr(symbols, "STRIP", 8)
    assert np.allclose(symbols._least(symbols._windows(y, 7), z), symbols._sliding(list(z), y), atol=1e-12)
    met = []
    df = spark.createDataFrame([(i, float(i)) for i in range(60)], "id long, v double")
    monkeypatch.setattr(symbols, "CANDIDATE_BLOCKS", (10, 30))
    inner = distances.block_pairs
    monkeypatch.setattr(distances, "block_pairs", lambda q, t, run, schema, size: met.append(size) or inner(q, t, run, schema, size))
    series = df.select("id", (F.col("id") % 2).cast("int").alias("c"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.sin(F.col("v") * (i + 1)).cast("double")).alias("s"))
    got = symbols.scored_candidates(series, "id", "s", "c", [6], 2)
    assert met == [(10, 30)] and got.count() == 60 * 3


def test_pairs_are_valued_in_blocks(spark):
    from tidemill.operators import distances

    rng = np.random.default_rng(7)
    s, c = rng.normal(size=(50, 8)), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(i, int(c[i]), s[i].tolist()) for i in range(50)] + [(50, 1, None)], "id long, c int, s array<double>").repartition(3)
    got = distances.pair_values(df.where("id % 10 = 0"), df, "id", "s", {"dtw": distances.paired("dtw"), "poly": distances.kernel_matrix("poly"), "rbf": distances.kernel_matrix("rbf")}, size=7)
    pairs = [(i, j) for i in range(0, 50, 10) for j in range(50) if i != j]
    rows = {(r.query, r.neighbour): r for r in got.collect()}
    assert sorted(rows) == pairs and got.count() == len(pairs)
    far = distances.dtw(s[[i for i, _ in pairs]], s[[j for _, j in pairs]])
    assert [rows[p].dtw for p in pairs] == far.tolist()
    assert np.allclose([(rows[i, j].poly, rows[i, j].rbf) for i, j in pairs], [(s[i] @ s[j], np.exp(-0.01 * ((s[i] - s[j]) ** 2).sum())) for i, j in pairs])
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()  # a series is not sent once a pair
    once = distances.pair_values(df, df, "id", "s", {"cid": distances.paired("cid")}, ("x", "y"), "c", 20).collect()
    assert sorted((r.x, r.y) for r in once) == [(i, j) for i in range(50) for j in range(i + 1, 50) if c[i] == c[j]]


def test_channels_and_spheres_return_what_can_matter(spark, monkeypatch):
    from tidemill.operators import distances

    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(40, 2, 5)), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist(), x[i, 0].tolist()) for i in range(40)], "id long, c int, x array<array<double>>, s array<double>")
    told = []
    inner = distances.block_pairs
    monkeypatch.setattr(distances, "block_pairs", lambda q, t, run, schema, *a, **k: told.append(inner(q, t, run, schema, *a, **k)) or told[-1])
    threshold, said = distances.adaptive_channels(df.where("id % 4 = 0"), df, "id", "x", "c")
    assert told[0].count() <= 2 * 10  # by either distance one row a query and block, not one a pair
    near = {}
    for i in range(0, 40, 4):
        d, e = (distances.multivariate_dtw(np.repeat(x[i : i + 1], 40, 0), x, 1.0, dependent) for dependent in (True, False))
        d[i] = e[i] = np.inf
        near[i] = (d.argmin(), e.argmin(), d[d.argmin()] / e[d.argmin()])
    assert {r.query: r.predicted for r in said.collect()} == {i: int(c[a] if ratio <= threshold else c[b]) for i, (a, b, ratio) in near.items()}
    plain = ((x[:, None, 0] - x[:, 0]) ** 2).sum(2) ** 0.5
    r = np.where(c[:, None] != c, plain, np.inf).min(1)
    spheres = distances.sphere_cover(df, "id", "s", "c", 1).collect()
    inside = {i: int(((plain[i] < r[i]) & (c == c[i])).sum()) for i in range(40)}
    assert spheres and all(inside[s.centre] == s.covered and np.isclose(r[s.centre], s.radius) for s in spheres)


def test_rows_of_one_word_are_not_searched(spark, monkeypatch):
    from tidemill.operators import distances, symbols

    rng = np.random.default_rng(9)
    w, c = rng.integers(0, 2, (60, 5)).astype(float), rng.integers(0, 3, 60)
    w[0] = 7.0
    df = spark.createDataFrame([(i, int(c[i]), w[i].tolist()) for i in range(60)], "id long, c int, w array<double>")
    asked, inner = [], distances.nearest
    monkeypatch.setattr(distances, "nearest", lambda q, t, *a: asked.append((q.count(), t.count())) or inner(q, t, *a))
    got = {r.id: (r.actual, r.predicted) for r in symbols.nearest_word(df, "id", "w", "c").collect()}
    far = np.abs(w[:, None] - w).sum(2) + np.where(np.eye(60) > 0, np.inf, 0)
    assert got == {i: (int(c[i]), int(c[far[i].argmin()])) for i in range(60)}
    sizes = np.unique(w, axis=0, return_counts=True)[1]
    assert asked == [(int((sizes == 1).sum()), len(sizes))]


def test_an_ensemble_is_selected_without_regrouping_items(spark):
    from tidemill.operators import ensembles

    rng = np.random.default_rng(10)
    y, probs = rng.integers(0, 3, 40), rng.dirichlet([1, 1, 1], (4, 40)).round(3)
    missing = {(1, 3), (2, 3), (2, 7)}
    rows = [(m, i, int(y[i]), probs[m, i].tolist()) for m in range(4) for i in range(40) if (m, i) not in missing]
    p = spark.createDataFrame(rows, "module int, item long, actual int, probs array<double>")
    chosen = []
    for _ in range(4):
        def accuracy(m):
            held = [[probs[k, i] for k in [*chosen, m] if (k, i) not in missing] for i in range(40)]
            return np.mean([np.round(sum(h), 9).argmax() == y[i] for i, h in enumerate(held) if h])

        chosen.append(min(range(4), key=lambda m: (-accuracy(m), m)))
    assert ensembles.select_ensemble(p, 4) == chosen


def test_bounded_candidates_are_judged_in_blocks(spark, monkeypatch):
    from tidemill.operators import shapelet_search, symbols

    rng = np.random.default_rng(11)
    x, c = rng.normal(size=(30, 16)), rng.integers(0, 2, 30)
    x[3, 2:9] = 1.0
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(30)], "id long, c int, s array<double>")
    asked = spark.createDataFrame([(i, int(c[i]), j, n) for i in range(0, 30, 3) for n in (5, 7) for j in range(0, 9, 2)], "series_id long, class int, start int, length int")
    kernels, inner = [], symbols._least
    monkeypatch.setattr(shapelet_search, "_least", lambda w, z: kernels.append(len(z)) or inner(w, z), raising=False)
    monkeypatch.setattr(shapelet_search, "block_pairs", lambda a, b, run, schema, size: spark.createDataFrame(run(a.toPandas(), b.toPandas()), schema))
    got = {(r.series_id, r.start, r.length, r.of): (r.n, r.s, r.q) for r in shapelet_search.judged(asked, df, df, "id", "s", "c").collect()}
    assert sorted(kernels) == [50, 50]  # a product for each length of a block, not one for each series
    for i, j, n in {k[:3] for k in got}:
        w = x[i, j : j + n]
        d = symbols._sliding([(w - w.mean()) / w.std() if w.std() > 0 else w * 0], x)[:, 0]
        for k in (0, 1):
            assert np.allclose(got[i, j, n, k], ((c == k).sum(), d[c == k].sum(), (d[c == k] ** 2).sum()), atol=1e-9)
    assert len(got) == 200


def test_nearest_bags_by_products(spark, monkeypatch):
    from tidemill.operators import symbols

    rng = np.random.default_rng(12)
    n = rng.integers(0, 3, (70, 9)) * (rng.random((70, 1)) < 0.9)
    bags = spark.createDataFrame([(i, f"w{j}", int(n[i, j])) for i in range(70) for j in range(9) if n[i, j]] + [(99, "alone", 2)], "id long, word string, n long")
    plain = symbols.boss_distance(bags, bags, "id").groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "m.b", "m.distance")
    want = {tuple(r) for r in plain.collect()}
    monkeypatch.setattr(symbols, "PRODUCT", (16, 25), raising=False)
    near = [[{tuple(r) for r in f(bags, "id").collect()} for f in (symbols.nearest_boss, symbols.nearest_histogram)]]
    monkeypatch.setattr(symbols, "DENSE_WORDS", 0, raising=False)
    near.append([{tuple(r) for r in f(bags, "id").collect()} for f in (symbols.nearest_boss, symbols.nearest_histogram)])
    assert near[0] == near[1] and near[0][0] == want and 99 not in {r[0] for r in want} and 99 in {r[0] for r in near[0][1]}
    strips, inner = [], symbols._nearest_bags
    a, b = (np.repeat(np.arange(40), 2), np.tile([0, 1], 40), np.arange(80.0)), (np.arange(60), np.arange(60) % 2, np.ones(60))
    at, v = inner(a, b, 2, np.arange(40), np.arange(60), np.zeros(40), np.zeros(60), lambda qa, qb, sums: strips.append((qa.shape, qb.shape)) or sums(np.array, np.array))
    assert {s for s in strips} == {((x, 1), (y,)) for x in (16, 8) for y in (25, 10)} and v.tolist() == [2.0 * i for i in range(40)] and at[:3].tolist() == [2, 0, 0]


def test_descriptors_are_sent_a_slice_at_a_time():
    import pyarrow as pa

    from tidemill.operators import descriptors

    x = np.random.default_rng(13).normal(size=(600, 32))
    for n in (0, 20):
        batch = pa.RecordBatch.from_arrays([pa.array(range(603)), pa.array([*x.tolist(), x[0, :n].tolist(), [], x[1].tolist()])], ["id", "s"])
        got = list(descriptors.descriptor_batches(iter([batch]), blocks=4, width=4))
        assert len(got) > 2 and max(len(set(b.column("id").to_pylist())) for b in got) <= 256
        rows = {}
        for b in got:
            for i, d in zip(b.column("id").to_pylist(), b.column("d").to_pylist(), strict=True):
                rows.setdefault(i, []).append(d)
        want = {i: d.tolist() for i, d in enumerate([*descriptors.descriptors(x, 4, 4), *(descriptors.descriptors(x[:1, :n], 4, 4) if n else [np.zeros((0, 8))]), np.zeros((0, 8)), *descriptors.descriptors(x[1:2], 4, 4)]) if len(d)}
        assert rows == want


def test_a_query_is_sent_once_to_a_bundle_of_rings(spark, monkeypatch):
    from tidemill.operators import distances, pivots

    x = np.random.default_rng(14).normal(size=(240, 12)).round(2)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>")
    written, inner = {}, pivots._written
    monkeypatch.setattr(pivots, "_written", lambda f, name: written.setdefault(name, []).append(inner(f, name)) or written[name][-1])
    got, _ = pivots.pivot_knn(df, df, 3, "id", "v", "label", ring=8)
    plain = distances.knn_join(df, df, 3, "id", "v", "label")
    assert {tuple(r) for r in got.select("query", "neighbour", "rank").collect()} == {tuple(r) for r in plain.select("query", "neighbour", "rank").collect()}
    more, sent = written["more"][0], written["sent"][1]
    bundles = written["bundles"][0].agg(F.max("bundle"), F.max("slot")).first()
    assert 4 <= bundles[0] < 16 and bundles[1] < 64
    assert sent.count() <= 240 * (bundles[0] + 1) < more.count() / 2  # random rows visit nearly every ring
    assert sent.agg(F.sum(F.bit_count("slots"))).first()[0] == more.count()


def test_rows_reach_the_leaves_of_a_wide_tree(spark):
    from tidemill.streaming import operators as streaming

    rows = [(a, b, (a + (b == 1)) % 2) for a in range(12) for b in range(3) for _ in range(100)]
    df = spark.createDataFrame([(a, b, y if i % 10 else 1 - y) for i, (a, b, y) in enumerate(rows)], "a int, b int, y int").repartition(3)
    state = streaming.TableState(spark, "leaf string, attribute string, value string, class string, n long")
    step = streaming.hoeffding_sink(["a", "b"], "y", 2, state, delta=0.5)
    for number in range(3):
        step(df, number)
    inner = {r.leaf: r.attribute for r in state.before().where("class is null").collect()}
    assert inner == {"": "a", **{f"a={i}": "b" for i in range(12)}}
    leaves = state.before().where("class is not null and attribute = 'b'").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    assert {r.leaf: r.n for r in leaves} == {f"a={a}/b={b}": 100 for a in range(12) for b in range(3)}


def test_series_are_streamed_to_blocks_of_candidates(spark, monkeypatch):
    from tidemill.operators import distances, symbols

    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(150, 10)), rng.integers(0, 3, 150)
    df = spark.createDataFrame([(i + 2**60, int(c[i]), x[i].tolist()) for i in range(150)], "id long, c int, s array<double>").repartition(4)
    told, inner = [], distances.block_pairs
    monkeypatch.setattr(distances, "block_pairs", lambda q, t, run, schema, *a, **k: told.append(inner(q, t, run, schema, *a, **k)) or told[-1])
    monkeypatch.setattr(symbols, "CANDIDATE_BLOCKS", (20, 35))
    for own in (False, True):
        got = {(r.series_id - 2**60, r.start): r.f_statistic for r in symbols.scored_candidates(df, "id", "s", "c", [7], 1, own).collect()}
        assert told[-1].count() == 150 * 4 == len(got)  # blocks return a row a candidate, not one a class and block of series
        for i, j in ((0, 0), (77, 3), (149, 2)):
            w = x[i, j : j + 7]
            d = symbols._sliding([(w - w.mean()) / w.std()], x)[:, 0]
            g = [d[c == k] for k in range(3)] if not own else [d[c == c[i]], d[c != c[i]]]
            between = sum(len(v) * (v.mean() - d.mean()) ** 2 for v in g) / (len(g) - 1)
            assert np.isclose(got[i, j], between / (sum(((v - v.mean()) ** 2).sum() for v in g) / (150 - len(g))))


def test_edits_of_a_group_in_slices(spark, monkeypatch):
    from tidemill.operators import distances

    rng = np.random.default_rng(13)
    words = ["", "a", "été", "kitten", "sitting", "old plate", "cold plate", "𝛼bc", None]
    rows = [(i, int(rng.integers(0, 3)) if i else None, words[i % 9]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g int, t string").repartition(3)
    monkeypatch.setattr(distances, "SLICE", 16, raising=False)
    monkeypatch.setattr(distances, "TEXT_PAIRS", 5, raising=False)
    a, b = df.toDF("x", "g", "a"), df.toDF("y", "g", "b")
    want = a.join(b, "g").where("x < y").select("x", "y", F.levenshtein("a", "b").alias("edits"))
    got = distances.edits_within(df, ["g"], "id", "t")
    assert got.schema == want.schema and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pairs_are_streamed_to_blocks(spark, monkeypatch):
    from tidemill.operators import distances, symbols

    rng = np.random.default_rng(14)
    x, c = rng.normal(size=(130, 6)), rng.integers(0, 3, 130)
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(130)], "id long, c int, s array<double>").repartition(3)
    bags = spark.createDataFrame([(i, f"w{j}", 1 + (i * j) % 3) for i in range(130) for j in range(12) if (i + j) % 5], "id long, word string, n long")
    told, inner = {}, distances.block_pairs

    def spied(q, t, run, schema, size, grow=False, within=None):
        told.setdefault(schema.split(",")[-1], []).append((hasattr(run, "steps"), grow, within))
        return inner(q, t, run, schema, size, grow, within)

    monkeypatch.setattr(distances, "block_pairs", spied)
    near = {r["query"]: r.neighbour for r in distances.pruned_nearest(df, df, "id", "s", "c", 0.4).collect()}
    d = distances.dtw(np.repeat(x, 130, 0), np.tile(x, (130, 1)), 0.4).reshape(130, 130) + np.where(np.eye(130) > 0, np.inf, 0)
    assert near == dict(enumerate(d.argmin(1).tolist())) and told[" met long"] == [(True, False, None)]
    distances.sphere_cover(df, "id", "s", "c")
    assert told[" r double"] == [(True, False, None)] and told[" id bigint"] == [(False, True, None)]
    distances.radius_join(df, df, "id", "s", 1.0)
    assert told[" distance double"][-1] == (False, True, None)
    once = {(r.x, r.y) for r in distances.pair_values(df, df, "id", "s", {"cid": distances.paired("cid")}, ("x", "y"), "c", 20).collect()}
    assert once == {(i, j) for i in range(130) for j in range(i + 1, 130) if c[i] == c[j]} and told[" cid double"] == [(True, False, "w")]
    monkeypatch.setattr(symbols, "PAIRS_TOLD", 100, raising=False)
    cosine = {(r.a, r.b): r.similarity for r in symbols.bag_cosine(bags.where("id < 90"), bags, "id").collect()}
    n = np.array([[(1 + (i * j) % 3) * bool((i + j) % 5) for j in range(12)] for i in range(130)], float)
    n /= np.sqrt((n * n).sum(1, keepdims=True))
    assert len(cosine) == 90 * 129 and all(np.isclose(v, n[a] @ n[b]) for (a, b), v in cosine.items()) and told[" v double"] == [(True, True, None)]


def test_queries_of_pairs_meet_all_rows(spark):
    from tidemill.plans import collected, symbolic  # noqa: F401

    d = "/root/testdata/sf0.001"
    n = catalog.read(spark, d, "embeddings").count()
    for name in ("d_dependent_dtw", "d_independent_dtw", "d_time_aligned", "d_window_search", "b_pyramid"):
        assert "% 100" not in catalog.ORACLE_SQL[name]
    assert catalog.QUERIES["d_dependent_dtw"](spark, d).select("x").distinct().count() == n
    assert catalog.QUERIES["d_adaptive_channels"](spark, d).agg(F.sum("n")).first()[0] == n
