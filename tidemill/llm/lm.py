"""LM scoring: a log-bilinear model fitted in numpy with noise-contrastive estimation.

The model's symbols are the most frequent words of the training texts, the end of text, the begin of text and a fixed
number of classes of rarer words (by hash of the word's first byte and last two bytes). It predicts a symbol from the
two before it: score = context1 . target + context2 . target + bias. A rarer word's probability is its class's
probability times its own smoothed share of the class, so the probabilities of all words and one unseen word for each
class sum to one. For scoring, products of the context and target matrices give every pair's score, and one more
product of their exponentials gives every context's exact normaliser.

Counts cover all training texts. Every training token takes part in the fit: documents are dealt by hash to parts of about
PART_TOKENS tokens, each part fits a local model in the order of hashes, starting from the mean of the round before, and the
parameters are averaged by groupBy, weighted by tokens, as whole numbers. So the fit depends on the rows alone, not on how they lie in
partitions. In the first round some batches are scored before they are learned from; what weight of the model against the plain shares of the
symbols scores them best is the weight of the final mixture.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut, mix, slices, small_batches, words

#: Frequent words that are symbols; further frequent words whose counts every task holds; classes of rarer words; numbers of a vector.
SYMBOLS, TABLE, CLASSES, DIM = 1022, 65_536, 1024, 16
NOISE, BATCH, RATE, ROUNDS = 24, 2048, 0.15, 2
#: Training tokens of a part; one of so many batches of the first round is scored first; weights of the model that are tried.
PART_TOKENS, TRIED, WEIGHTS = 1 << 21, 16, [i / 10 for i in range(11)]
#: What Adagrad's sums of squares start at: numbers of which little is seen stay near the unigram start.
FIRST_SQUARE = 1.0
END_HASH = np.uint64(0x1F2E3D4C5B6A7988)


def _class_of(w, at: np.ndarray) -> np.ndarray:
    """The class of each word of ``w`` at ``at``: a hash of its first byte and its last two."""
    a, b = w.start[at], w.end[at]
    x = w.data[a].astype(np.uint64) << np.uint64(16) | w.data[b - 1].astype(np.uint64) << np.uint64(8) | w.data[np.maximum(a, b - 2)].astype(np.uint64)
    return (mix(x + np.uint64(77)) % np.uint64(CLASSES)).astype(np.int64)


class Vocabulary:
    """What each task holds: sorted hashes of the frequent words with their counts and symbols, and the totals of the classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int, class_tokens: np.ndarray, class_types: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        symbol = np.full(len(hashes), -1, np.int64)
        symbol[order[:SYMBOLS]] = np.arange(min(SYMBOLS, len(hashes)))
        by_hash = np.argsort(hashes)
        self.hashes, self.counts, self.symbol = hashes[by_hash], counts[by_hash], symbol[by_hash]
        self.total, self.distinct, self.ends = total, distinct, ends
        self.class_tokens, self.class_types = class_tokens, class_types
        self.start, self.end = SYMBOLS, SYMBOLS + 1
        self.size = SYMBOLS + 2 + CLASSES
        share = np.zeros(self.size)
        share[: min(SYMBOLS, len(order))] = counts[order[:SYMBOLS]]
        share[self.end] = ends
        share[SYMBOLS + 2 :] = class_tokens
        share += 1.0
        share[self.start] = 0
        share[min(SYMBOLS, len(order)) : SYMBOLS] = 0
        self.share = share / share.sum()

    def look(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of every word, and its count (-1 where only the joined counts have it)."""
        if not len(w.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
            hit = self.hashes[at] == w.hash
            symbol, count = np.where(hit, self.symbol[at], -1), np.where(hit, self.counts[at], -1)
        else:
            symbol = count = np.full(len(w.hash), -1, np.int64)
        rare = np.flatnonzero(symbol < 0)
        symbol[rare] = SYMBOLS + 2 + _class_of(w, rare)
        return symbol, count

    def sequences(self, w, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Target, the symbol before it, the one before that, and the document, for all tokens of ``w`` with every document's end."""
        n = np.diff(w.first) + 1
        out = np.full(int(n.sum()), self.end, np.int64)
        doc = np.repeat(np.arange(w.n_docs), n)
        last = np.cumsum(n) - 1
        inside = np.ones(len(out), bool)
        inside[last] = False
        out[inside] = symbol
        one = np.r_[self.start, out[:-1]]
        begin = last - n + 1
        one[begin] = self.start
        two = np.r_[self.start, one[:-1]]
        two[begin] = self.start
        return out, one, two, doc


def _add(into: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    order = np.argsort(at.astype(np.uint16), kind="stable")
    sorted_at = at[order]
    begins = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    into[sorted_at[begins]] += np.add.reduceat(what[order], begins, axis=0)


class LogBilinear:
    """Parameters: two context matrices, the target matrix with the bias as its last column."""

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray | None = None):
        self.v, s = vocabulary, vocabulary.size
        if values is None:
            rng = np.random.default_rng(7)
            values = rng.normal(0, 0.1, (3, s, DIM + 1)).astype(np.float32)
            values[:2, :, DIM] = 0
            values[2, :, DIM] = np.log(np.maximum(vocabulary.share, 1e-12))
        self.values = values.astype(np.float32)
        self.square = np.full_like(self.values, FIRST_SQUARE)
        self.rng = np.random.default_rng(11)
        self.tried = np.zeros(len(WEIGHTS))
        self.batches = 0
        self.noise_cdf = np.cumsum(vocabulary.share)
        self.log_noise = np.log(np.maximum(NOISE * vocabulary.share, 1e-12)).astype(np.float32)

    def probabilities(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised probabilities of the targets after their contexts, by one product with all symbols."""
        x = self.values[0, one, :DIM] + self.values[1, two, :DIM]
        z = x @ self.values[2, :, :DIM].T + np.where(self.v.share > 0, self.values[2, :, DIM], -1e4)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z[np.arange(len(z)), target] / z.sum(1)

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, trying: bool = False) -> None:
        """One pass in batches; each batch shares its noise words, and Adagrad sets every number's rate."""
        for a in range(0, len(target), BATCH):
            t, c1, c2 = target[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            if trying and self.batches % TRIED == TRIED // 2:
                p, q = self.probabilities(t, c1, c2), self.v.share[t]
                self.tried += [np.log(w * p + (1 - w) * q).sum() for w in WEIGHTS]
            self.batches += 1
            z = np.minimum(np.searchsorted(self.noise_cdf, self.rng.random(NOISE)), self.v.size - 1)
            g = np.zeros_like(self.values)
            x = self.values[0, c1] + self.values[1, c2]
            x[:, DIM] = 1
            q, qz = self.values[2, t], self.values[2, z]
            up = 1 / (1 + np.exp(np.clip((x * q).sum(1) - self.log_noise[t], -30, 30)))  # 1 - p(data)
            down = -1 / (1 + np.exp(np.clip(self.log_noise[z] - x @ qz.T, -30, 30)))
            dx = up[:, None] * q + down @ qz
            dx[:, DIM] = 0
            _add(g[0], c1, dx)
            _add(g[1], c2, dx)
            _add(g[2], t, up[:, None] * x)
            np.add.at(g[2], z, down.T @ x)
            g /= len(t)
            g *= 64
            self.square += g * g
            self.values += RATE * g / np.sqrt(self.square)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of (symbol before, target) with the bias, of (symbol two before, target), and the log of every context's sum."""
        q, bias = self.values[2, :, :DIM], self.values[2, :, DIM].copy()
        bias[self.v.share == 0] = -1e4
        one = self.values[0, :, :DIM] @ q.T + bias
        two = self.values[1, :, :DIM] @ q.T
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        total = np.exp((one - top1).astype(np.float32)) @ np.exp((two - top2).astype(np.float32)).T
        return one, two, np.log(np.maximum(total, 1e-30)) + top1 + top2.T


def _dump(values: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), values)
    return out.getvalue()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(hash, cls, n)``: how often each word occurs in all ``texts``, by the word's 64-bit hash, with its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            u, i, back = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c[i].astype(np.int32)), pa.array(np.bincount(back, n).astype(np.int64))], ["hash", "cls", "n"])

        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                u, i, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, _class_of(w, i), n))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    yield out()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "hash long, cls int, n long").groupBy("hash").agg(F.max("cls").alias("cls"), F.sum("n").alias("n"))


def _last_of_the_table(counts: DataFrame) -> tuple[int, int] | None:
    """(n, hash) of the last of the TABLE most frequent words, ties by hash; None where there are fewer words.

    Histograms of the counts, then of the hashes of the words of one count, come to the driver: some hundred and at most 65,536 rows.
    """
    step = F.floor(F.log2("n") * 16)
    above = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():
        if above + r.v > TABLE:
            break
        above += r.v
    else:
        return None
    inside = counts.where(step == r.step)
    for r in inside.groupBy("n").agg(F.count("*").alias("v")).orderBy(F.desc("n")).collect():
        if above + r.v > TABLE:
            break
        above += r.v
    same = inside.where(F.col("n") == r.n)
    bucket = F.shiftright("hash", 48)
    for b in same.groupBy(bucket.alias("b")).agg(F.count("*").alias("v")).orderBy("b").collect():
        if above + b.v >= TABLE:
            break
        above += b.v
    last = same.where(bucket == b.b).orderBy("hash").limit(TABLE - above).agg(F.max("hash").alias("hash")).first()
    return r.n, last.hash


def _vocabulary(counts: DataFrame, ends: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the TABLE most frequent words (ties by hash), and the counts of all others.

    Sums over all words stay on the executors; the frequent words and the classes' sums come to the driver.
    """
    last = _last_of_the_table(counts)
    frequent = F.lit(True) if last is None else (F.col("n") > last[0]) | ((F.col("n") == last[0]) & (F.col("hash") <= last[1]))
    top = counts.where(frequent).toPandas().sort_values(["n", "hash"], ascending=[False, True])
    hashes, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    whole, distinct = 0, 0
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r.cls], types[r.cls] = r.n, r.v
        whole, distinct = whole + r.n, distinct + r.v
    for cls, x in zip(top["cls"][:SYMBOLS], n[:SYMBOLS], strict=False):
        tokens[cls] -= x
        types[cls] -= 1
    return Vocabulary(hashes, n, whole + ends, distinct + (ends > 0), ends, tokens, types), counts.where(~frequent).select("hash", "n")


def _dealt(training: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """``(part, turn, s)``: the symbols of each document (16-bit numbers), its part and its place there."""
    sent = training.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            for rows in slices(batch):
                w = words(rows.column("text"), lower=True)
                target, _, _, doc = v.sequences(w, v.look(w)[0])
                raw, edge = target.astype(np.uint16), np.searchsorted(doc, np.arange(w.n_docs + 1))
                packed = pa.array([raw[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("turn"), packed], ["part", "turn", "s"])

    keyed = training.select(F.pmod(F.xxhash64("doc_id", "text", F.lit("part")), F.lit(parts)).cast("int").alias("part"), F.xxhash64("text", "doc_id").alias("turn"), "text")
    return keyed.mapInArrow(run, "part int, turn long, s binary")


def _rows_of(v: Vocabulary, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target and the two symbols before it of whole documents."""
    target = np.frombuffer(b"".join(packed), np.uint16).astype(np.int64)
    begin = np.cumsum([0, *(len(x) // 2 for x in packed)])[:-1]
    one = np.r_[v.start, target[:-1]]
    one[begin] = v.start
    two = np.r_[v.start, one[:-1]]
    two[begin] = v.start
    return target, one, two


def fit(training: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """Parameters after ROUNDS passes over all training tokens (doc_id, text), averaged over the parts' local models after each, and the model's weight."""
    spark, values, weight = training.sparkSession, LogBilinear(vocabulary).values, 1.0
    parts = max(1, vocabulary.total // PART_TOKENS)
    dealt = cut(_dealt(training, vocabulary, parts))
    scale = 1 << 24
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((vocabulary, _dump(values)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=number == 0) -> Iterator[pa.RecordBatch]:
            v, raw = sent.value
            start = np.load(io.BytesIO(raw))
            model, now, seen, pending, total, all_seen, tried = None, None, 0, [], 0, 0, np.zeros(len(WEIGHTS))

            def learn(packed: list[bytes]) -> None:
                nonlocal seen
                rows = _rows_of(v, packed)
                model.learn(*rows, trying=first)
                seen += len(rows[0])

            def close() -> None:
                nonlocal total, all_seen, tried
                if pending:
                    learn(pending)
                share = max(1, seen >> 10)
                total, all_seen, tried = total + np.round(model.values.astype(np.float64) * scale).astype(np.int64) * share, all_seen + share, tried + model.tried

            for batch in batches:
                for part, s in zip(batch.column("part").to_pylist(), batch.column("s").to_pylist(), strict=True):
                    if part != now:
                        if model is not None:
                            close()
                        model, now, seen, pending, size = LogBilinear(v, start), part, 0, [], 0
                        model.rng = np.random.default_rng([11, number, part])
                    pending.append(s)
                    size += len(s) // 2
                    if size >= 32 * BATCH:
                        learn(pending)
                        pending, size = [], 0
            if model is not None:
                close()
                flat = total.reshape(-1, DIM + 1)
                rows = np.concatenate([flat, np.zeros((1, DIM + 1), np.int64)])
                rows[-1, : len(WEIGHTS)] = np.round(tried * 1024)
                columns = [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), all_seen)), *(pa.array(x) for x in rows.T)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "seen", *(f"x{i}" for i in range(DIM + 1))])

        schema = "row int, seen long, " + ", ".join(f"x{i} long" for i in range(DIM + 1))
        each = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "turn").mapInArrow(run, schema)
        got = each.groupBy("row").agg(F.sum("seen").alias("seen"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(DIM + 1))).orderBy("row").toPandas()
        if len(got):
            numbers = got.drop(columns=["row", "seen"]).to_numpy(np.float64)
            values = (numbers[:-1] / got["seen"].to_numpy(np.float64)[:-1, None] / scale).astype(np.float32).reshape(values.shape)
            if number == 0 and numbers[-1].any():
                weight = WEIGHTS[int(numbers[-1, : len(WEIGHTS)].argmax())]
    drop_cut(dealt)
    return values, weight


def score(docs: DataFrame, held_out_mod: int = 7, held_out_is: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row, log10 scores of whole texts.

    Learns from rows whose crc32(id as text) modulo ``held_out_mod`` is not ``held_out_is``. A-Z are lower-cased;
    tokens are runs without ASCII white space and one end. Null texts count as empty. Rows with a null id are scored,
    learned from, and never held out. Rows that repeat an id and a text get equal rows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_mod != held_out_is, F.lit(True)))
    counts = cut(word_counts(train))
    ends = train.count()
    v, rare = _vocabulary(counts, ends)
    values, weight = fit(train.select("doc_id", "text"), v)
    sent = spark.sparkContext.broadcast((v, _dump(values)))
    share = v.total + v.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, raw = sent.value
        one_t, two_t, norm = LogBilinear(v, np.load(io.BytesIO(raw))).tables()
        class_log = np.log10(v.class_tokens + v.class_types + 1)
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=True)
                symbol, count = v.look(w)
                target, one, two, doc = v.sequences(w, symbol)
                log = (one_t[one, target] + two_t[two, target] - norm[one, two]).astype(np.float64)
                log = np.log10(weight * np.exp(log) + (1 - weight) * v.share[target])
                total = np.bincount(doc, log, w.n_docs)
                cls = symbol - SYMBOLS - 2
                known = count >= 0
                rare_known = known & (cls >= 0)
                total += np.bincount(w.doc[rare_known], np.log10(count[rare_known] + 1.0) - class_log[cls[rare_known]], w.n_docs)
                base = np.bincount(w.doc[known], np.log10(count[known] + 1.0), w.n_docs) + math.log10(v.ends + 1.0)
                n = np.diff(w.first) + 1
                base -= n * math.log10(share)
                # the words that only the joined counts have, each with how often its document has it
                rest = np.flatnonzero(~known)
                total -= np.bincount(w.doc[rest], class_log[cls[rest]], w.n_docs)
                key = np.stack([w.doc[rest].astype(np.uint64), w.hash[rest]])
                order = np.lexsort(key[::-1])
                key = key[:, order]
                new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]) if len(rest) else rest
                times = np.diff(np.r_[new, len(rest)])
                ids = np.arange(w.n_docs)
                row = np.r_[ids, key[0, new].astype(np.int64)]
                # a document's own row: a key of its own, so that these spread over the partitions
                own = mix(ids.astype(np.uint64) + w.hash[:1].sum() + np.uint64(part.num_rows))
                hashes = np.r_[own, key[1, new]].view(np.int64)
                fill = np.zeros(len(new))
                cols = [part.column("doc_id").take(pa.array(row)), part.column("h").take(pa.array(row)), pa.array(hashes), pa.array(np.r_[np.zeros(len(ids)), times].astype(np.int32))]
                cols += [pa.array(np.r_[np.ones(len(ids)), fill].astype(np.int32)), pa.array(np.r_[n, fill].astype(np.int64)), pa.array(np.r_[np.bincount(w.doc[known], minlength=w.n_docs) + (v.ends > 0), fill].astype(np.int64)), pa.array(np.r_[base, fill]), pa.array(np.r_[total, fill])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "hash", "times", "rows", "n_tokens", "n_known", "base", "total"])

    schema = "doc_id long, h long, hash long, times int, rows int, n_tokens long, n_known long, base double, total double"
    parts = docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, schema)
    joined = parts.join(rare, "hash", "left").withColumn("extra", F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).otherwise(0.0))
    whole = joined.groupBy("doc_id", "h").agg(
        F.sum("rows").cast("int").alias("rows"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + F.col("extra")).alias("base"), F.sum(F.col("total") + F.col("extra")).alias("total"),
    )
    each = whole.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
    return each.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_mod == held_out_is, F.lit(False)).alias("held_out"),
        F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("total") / F.col("rows")).alias("score"),
    )
