"""Helpers shared by the training-data operators: cut lineage, find components, tokenise Arrow batches with numpy."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Bytes of a row group of a written table: what a task holds while it writes.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares (spark.checkpoint.dir); where a session of one machine names none, a temporary one."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores after it until none of the frames has a column of that name in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null, as an array, without Python."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to hand Python few rows at a time: texts are long, and a task holds whole batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later plans start there and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and that no plan reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("cut-"):
            raise ValueError(f"not written by cut: {folder}")
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more rows than this is joined apart from the others; more hot keys than this are not broadcast.
HOT_ROWS, HOT_KEYS = 1000, 1_000_000


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``n`` how many of ``rows`` have it; ``n`` goes.

    Keys of more than HOT_ROWS rows are joined apart by a broadcast of those keys alone, so no task gets a whole hot key.
    There are at most rows / HOT_ROWS of them; where that is over HOT_KEYS, they are shuffled and Spark splits what is skewed.
    ``keyed`` should be a written table: it is read more than once.
    """
    hot = keyed.where(F.col(n) > HOT_ROWS).drop(n)
    many = hot.count()
    if not many:
        return rows.join(keyed.drop(n), on)
    near = F.broadcast(hot) if many <= HOT_KEYS else hot
    cold = rows.join(near.select(*on), on, "left_anti").join(keyed.where(F.col(n) <= HOT_ROWS).drop(n), on)
    return cold.unionByName(rows.join(near, on))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``: component is the smallest node reachable.

    Alternates large-star and small-star joins, so the rounds grow with the logarithm of the longest chain.
    Self-loops and null ends are ignored; an empty input gives an empty result.
    """
    pair = lambda df: df.where("u <> v").distinct()
    now = cut(pair(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct() if mark[0] else now.toDF("node", "component")
        seen = mark
        both = now.union(now.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(pair(join_split(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))))
        drop_cut(low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        before, now = now, cut(pair(join_split(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))))
        for done in (before, large, low):
            drop_cut(done)


def fold(ids: pa.Array, k: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo ``k``; -1 where the id is null."""
    return np.fromiter((-1 if x is None else zlib.crc32(str(x).encode()) % k for x in ids.to_pylist()), np.int64, len(ids))


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all ASCII marks.
MARKS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.cache
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    both = []
    for base in (_MULT, _INV):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = both
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int, step: int = 1) -> np.ndarray:
    """Hash of the k word hashes at i, i+step, ... for every i that has them all."""
    n = max(0, len(h) - (k - 1) * step)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j * step : j * step + n]
    return mix(out + np.uint64(k * 1000003 + step))


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents: byte data, start and end of each word, its document's place, its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int
    hash: np.ndarray
    between: np.ndarray

    @functools.cached_property
    def first(self) -> np.ndarray:
        """For every document the place of its first word; one more entry closes the last document."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def squeezed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of the slice joined by one space, with the start and the end of each."""
        n = self.end - self.start
        start = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else np.zeros(0, np.int64)
        out = np.full(int(n.sum() + len(n)), 32, np.uint8)
        where = np.flatnonzero(~self.between[self.data])
        out[where + np.repeat(start - self.start, n)] = self.data[where]
        return out.tobytes(), start, start + n


def words(text: pa.Array, lower: bool = False, hashed: bool = True, between: np.ndarray = SPACE) -> Words:
    """Tokenise a (small) Arrow string array at the bytes in ``between``; null counts as the empty text."""
    text = pc.fill_null(text, "")
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    raw = LOWER[raw] if lower else raw
    space = between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) if len(raw) else space
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.concatenate([space[1:], [True]]) if len(raw) else space
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    hashes = np.zeros(0, np.uint64)
    if hashed and len(start):
        up, down = _power(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_bytes_table()[raw] * up[: len(raw)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start])
    return Words(raw, start, end, doc, len(text), hashes, between)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text, whole rows always."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
