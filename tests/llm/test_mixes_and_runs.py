"""Plain versions of the filter audit, periodic runs and source mixing, and their edge cases."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import audit, lm, mixing, queries, runs, shared, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, bucket int, mask string, place int, h long, part int, runs int, range int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(80)]
    texts += texts[:15] + [texts[0]] * 20 + ["", None, "  \n\t ", "ABC DEF", "é $ \U0001f600", " ".join(f"Long{i % 7}" for i in range(20_000))]
    out = [(i, t, [None, "", "a", "b", "é", "c"][i % 6]) for i, t in enumerate(texts)]
    return [*out, (None, texts[3], "a"), (None, texts[0], None), out[4], out[4], (7, texts[9], "z"), (500, "", "only empty")]


def fails(rows):
    """The filters that each row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i}
        out.append({k for k, v in f.items() if v})
    return out


def brute_audit(rows, good, toxic):
    failed, want = fails(rows), {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        share, lines = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                before = len([x for x in mine if name in x[1]]) - len(gone)
                left = [x for x in left if name not in x[1]]
                share[name] += len(gone)
                lines.append((order, step, len(left), len(gone), before, sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        want |= {(part, o, s): (*x, share[o[s - 1]]) for o, s, *x in lines}
    return want


@pytest.mark.parametrize("room", [audit.ROOM, 0])
def test_filter_audit(spark, rows, room, monkeypatch):
    monkeypatch.setattr(audit, "ROOM", room)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 2)] + [(4, 1, None), (4, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    known = labels.collect()
    want = brute_audit(rows, {r.doc_id for r in known if r.quality == 1} - {None}, {r.doc_id for r in known if r.toxic == 1} - {None})
    got = audit.interactions(audit.mask_counts(audit.masks(docs), labels)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_sketch_clears_only_unique_texts(spark):
    """Few counters for many texts: some unique texts stay, no repeat is cleared."""
    docs = spark.range(40_000).select(F.xxhash64((F.col("id") - F.when(F.col("id") % 10 == 0, 1).otherwise(0))).alias("h"))
    for buckets in (3, 10):
        seen = audit.marked(docs, shared.cut(audit.sketch(docs, buckets)), buckets)
        n = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("maybe").alias("maybe"))
        assert n.where("n > 1 and not maybe").count() == 0 and n.where("n > 1").count() == 3999
        assert n.where("n = 1 and not maybe").count() > (28_000 if buckets == 10 else 1_000)


def plain_runs(w, least=6, times=4):
    n, found = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                period = next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(i, i + length - p)))
                if period == q:
                    found.add((i, length, q))
            i = j
    return sorted(found)


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_texts():
    rng = np.random.default_rng(7)
    out = [None, "", " ", "a", "a a a a a", "a a a a a a", "x a a a a a a y", "a b a b a b a b", "a b a b a b a", "a " * 3000, "a b c " * 700 + "d"]
    out += [" ".join(rng.choice(["a", "b"], n)) for n in (20, 60, 200, 800)]
    out += ["a b a b a b a b a a b a b a b a b a " * 3, " ".join("ab"[bin(i).count("1") % 2] for i in range(256))]
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 50, 120)]
        at, p, times = rng.integers(0, 80), rng.integers(1, 14), rng.integers(3, 9)
        out.append(" ".join(base[:at] + (base[at : at + p] * times)[: rng.integers(p * 3, p * times + 1)] + base[at + k % 3 :]))
        nested = (["u"] * int(rng.integers(1, 9)) + ["v"] * int(rng.integers(0, 7))) * int(rng.integers(2, 8))
        out.append(" ".join(base[:5] + nested + base[5:9] + nested))
    return out


def test_periodic_runs(spark):
    texts = run_texts()
    got = {r.doc_id: r for r in runs.periodic_runs(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = plain_runs(w)
        assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(w) and got[i].collapsed == collapsed(w, want), (i, t)


@pytest.mark.parametrize(("least", "times"), [(1, 2), (9, 3), (5, 5)])
def test_runs_of_other_bounds(least, times):
    texts = [WORD.findall(t or "") for t in run_texts()]
    ids = {w: k for k, w in enumerate(sorted({x for t in texts for x in t}))}
    h = np.array([hash(x) & 0xFFFFFFFF for t in texts for x in (ids[w] * 2_654_435_761 for w in t)], np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = runs.find_runs(h, doc, len(texts), least, times)
    assert got == [plain_runs(t, least, times) for t in texts]


def test_periodic_run_query(spark, rows, tmp_path):
    docs = [*rows, *((1000 + i, t, None) for i, t in enumerate(run_texts())), *((2000 + i, " ".join(f"v{k % (i + 3)}x" for k in range(i)), None) for i in range(300))]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for i, t, _ in docs:
        w = WORD.findall(t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(collapsed(w, found)))] += 1
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert collections.Counter(map(tuple, got.collect())) == want
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def brute_mix(rows, weights, share=1.5, most=2.0):
    sizes = [(i, s, len(WORD.findall(t or "")), hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()) for i, t, s in rows]
    sources = sorted({s for _, s, _, _ in sizes}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in sizes if x[1] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), share * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: most * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return sizes, size, target


@pytest.mark.parametrize("hot", [1000, 3])
def test_source_mixing(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    rng = np.random.default_rng(1)
    more = [(1000 + i, " ".join(["x"] * int(rng.integers(0, 40))), "hot" if i % 2 else f"s{i % 14}") for i in range(900)]
    docs = [*rows, *more]
    sizes, size, target = brute_mix(docs, [3, 1, 2])
    got = mixing.mix_plan(frame(spark, docs), [3, 1, 2]).collect()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in got) == collections.Counter(x[:3] for x in sizes)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.copies <= 2
        assert r.copies >= (r.target // size[r.source] if size[r.source] else 0)
    for s in size:
        smallest = sorted(x[2] for x in sizes if x[1] == s)
        assert abs(taken[s] - target[s]) <= (0.5 * smallest[-1] if len(smallest) < 30 else 2)
    again = mixing.mix_plan(frame(spark, docs).repartition(5), [3, 1, 2]).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    other = mixing.mix_plan(frame(spark, docs), [3, 1, 2], seed="other").collect()
    assert collections.Counter(map(tuple, got)) != collections.Counter(map(tuple, other))


def test_mixed_rows(spark, rows):
    docs = frame(spark, rows)
    planned = {r.doc_id: r.copies for r in mixing.mix_plan(docs, [1.0]).where("doc_id < 90 and doc_id <> 7 and doc_id <> 4").collect()}
    out = mixing.mixed(docs, [1.0])
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(n.get(i, 0) == k for i, k in planned.items()) and set(out.columns) == {*docs.columns, "copy"}


def test_mixing_with_room_for_all(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a", "y"), (3, "a b", "y")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.copies) for r in mixing.mix_plan(docs, [1.0], share=9.0, most=2.0).collect()} == {(1, 2), (2, 2), (3, 2)}
    assert {(r.doc_id, r.copies) for r in mixing.mix_plan(docs, [1.0], share=1.0, most=1.0).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.mask_counts(audit.masks(none), labels)).count() == 0
    assert runs.digests(runs.periodic_runs(none)).count() == 0
    assert mixing.mix_plan(none, [3, 1, 2]).count() == 0 and mixing.mixed(none, [1]).count() == 0


@pytest.fixture
def lm_docs(spark):
    rng = np.random.default_rng(17)
    names = [f"{a}{b}{i}" for i in range(40) for a in "xyz" for b in ("er", "or", "A")]
    p = 1 / np.arange(1, len(names) + 1)
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 60)), p=p / p.sum())), "s") for i in range(120)]
    return frame(spark, [*rows, (500, None, "s"), (None, rows[3][1], "s"), rows[4], rows[4]])


@pytest.mark.parametrize("table", [lm.TABLE, 90])
def test_lm_scores_against_a_plain_scorer(spark, lm_docs, table, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "PART_TOKENS", 700)
    known = [(r.doc_id, r.text or "") for r in lm_docs.collect()]
    train = [(i, t) for i, t in known if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    tokens = lambda t: WORD.findall(lower(t))
    of = {x: int(shared.words(pa.array([x])).hash[0]) for _, t in known for x in tokens(t)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    count = collections.Counter(x for _, t in train for x in tokens(t))
    top = sorted(count, key=lambda x: (-count[x], signed(of[x])))[:table]
    cls = {x: int(lm._class_of(shared.words(pa.array([x])), np.array([0]))[0]) for x in of}
    symbol = {x: k for k, x in enumerate(top[: lm.SYMBOLS])}
    # the fit is a function of the rows alone: fitted here again, on other partitions
    rows = spark.createDataFrame(train, "doc_id long, text string").repartition(5)
    v, rare = lm._vocabulary(shared.cut(lm.word_counts(rows)), len(train))
    assert set(v.hashes.tolist()) == {of[x] for x in top} and {r.hash for r in rare.collect()} == {signed(of[x]) for x in count if x not in top}
    values, weight = lm.fit(rows, v)
    x = values.astype(float)
    bias = np.where(v.share > 0, x[2, :, lm.DIM], -1e4)

    def plain(t):
        before = [v.start, v.start]
        out = 0.0
        for w in [*tokens(t), None]:
            at = v.end if w is None else symbol.get(w, lm.SYMBOLS + 2 + cls[w])
            z = (x[0, before[-1], : lm.DIM] + x[1, before[-2], : lm.DIM]) @ x[2, :, : lm.DIM].T + bias
            p = np.exp(z - z.max())
            out += math.log10(weight * p[at] / p.sum() + (1 - weight) * v.share[at])
            if w is not None and w not in symbol:
                members = [y for y in count if y not in symbol and cls[y] == cls[w]]
                out += math.log10((count[w] + 1) / (sum(count[y] for y in members) + len(members) + 1))
            before.append(at)
        return out

    got = collections.defaultdict(list)
    for r in lm.score(lm_docs.repartition(3)).collect():
        got[r.doc_id].append(r.score)
    assert sum(map(len, got.values())) == len(known)
    assert all(abs(s - plain(t)) < 2e-3 * (1 + len(tokens(t)) ** 0.5) for i, t in known for s in got[i])
    again = collections.Counter((r.doc_id, round(r.score, 9)) for r in lm.score(lm_docs.repartition(7)).collect())
    assert again == collections.Counter((i, round(s, 9)) for i, many in got.items() for s in many)


def test_graph_search_meets_few_and_finds_nearly_all():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(240, 64)), 5, 0) + 0.1 * rng.normal(size=(1200, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges = vectors._graph(x)
    found, want = vectors.range_search(x, x, edges, 0.98), x @ x.T >= 0.98
    met = vectors._beam(x, x, vectors._padded(edges))[0] > -8
    assert want.sum() > 4 * len(x) and not (found & ~want).any() and (found & want).sum() >= 0.98 * want.sum() and met.mean() < 0.4


def test_shards_are_dealt_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_SHARD", 60)
    monkeypatch.setattr(vectors, "SHARD", 20)
    rng = np.random.default_rng(2)
    rows = [("0", 8, 0, i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    shards = vectors._deal_again(shared.cut(spark.createDataFrame(rows, vectors._DEALT)))
    n = {r.shard: r["count"] for r in shards.groupBy("shard").count().collect()}
    homes = {r.rep: r["count"] for r in shards.select("rep", "shard").distinct().groupBy("rep").count().collect()}
    assert max(n.values()) < 200 and set(homes) == set(range(1500)) and min(homes.values()) >= 2
