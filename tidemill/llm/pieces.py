"""SentencePiece encoding and decoding: batched numpy Viterbi over a given piece table.

Words of equal length advance together. Hashes of all substrings that still begin some piece probe the sorted keys of
pieces and their prefixes; for every end position vectorised maxima over the piece lengths keep the best score and its
backpointer. The work for a word grows with its length, in one task however long it is (about 45 microseconds a character). The path of the highest sum of the model's piece scores wins (a shorter last piece on ties); a character
in no piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: While words are encoded a literal U+2581 is this lone surrogate, which no text holds and no piece has; it becomes its own three bytes.
_LITERAL = "\udfff"
#: Below the worst piece, for a character in no piece.
UNKNOWN = 10.0
CACHE, CELLS = 400_000, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def read_model(path: str) -> tuple[list[str], list[float], list[str]]:
    """Names, scores and kinds (normal, byte, other) of a model file's pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.vocab_size())
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in n]
    return [m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], kinds


class Pieces:
    """A model's pieces: sorted hash keys of pieces and prefixes with ids and scores, and the bytes that each id decodes to."""

    def __init__(self, names: list[str], scores: list[float], kinds: list[str]):
        self.bytes_of = [n.replace(SPACE, " ").encode() for n in names]
        self.byte_ids = np.zeros(256, np.int32)
        normal = []
        for i, (n, k) in enumerate(zip(names, kinds, strict=True)):
            if k == "byte":
                self.byte_ids[int(n[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(n[3:5], 16)])
            elif k == "normal":
                normal.append(i)
            else:
                self.bytes_of[i] = b""
        if any(SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece has a space inside: words can't be encoded one by one")
        self.longest = max(len(names[i]) for i in normal)
        self.unknown = min(scores[i] for i in normal) - UNKNOWN
        self.alone = "".join(c for c in "\n\t\r" if not any(c in names[i] and len(names[i]) > 1 for i in normal))
        table: dict[int, int] = {}
        for i in normal:
            h = self._prefixes(names[i])
            for k in h[:-1].tolist():
                table.setdefault(k, -1)
            if table.get(int(h[-1]), -1) >= 0:
                raise ValueError("two pieces share a key")
            table[int(h[-1])] = i
        keys = np.array(list(table), np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(table.values()), np.int32)[order]
        score = np.array(scores, np.float64)
        self.scores = np.where(self.ids >= 0, score[self.ids], -np.inf)
        hard = re.escape(self.alone)
        self.units = re.compile(f"[{hard}]|{SPACE}*[^{SPACE}{hard}]+|{SPACE}+" if hard else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        return Pieces(*read_model(path))

    @staticmethod
    def _rolled(codes: np.ndarray) -> np.ndarray:
        """For rows of code points the running polynomial hash before each column and after the last."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        c = mix(codes.astype(np.uint64) + np.uint64(1))
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * _P + c[:, j]
        return h

    def _prefixes(self, name: str) -> np.ndarray:
        return mix(self._rolled(np.array([[ord(c) for c in name]]))[0, 1:])

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length, one word after the other, and the number of each; a negative id is a character in no piece, as -1 - its code point."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        h = self._rolled(codes)
        longest = min(self.longest, size)
        score = np.full((longest, size, n), -np.inf)
        ident = np.full((longest, size, n), -1, np.int32)
        row, col = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(size), indexing="ij"))
        power = np.uint64(1)
        for k in range(1, longest + 1):
            power = np.uint64(int(power) * int(_P) & ((1 << 64) - 1))
            key = mix(h[row, col + k] - h[row, col] * power)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            row, col, at = row[hit], col[hit], at[hit]
            score[k - 1, col, row] = self.scores[at]
            ident[k - 1, col, row] = self.ids[at]
            more = col + k < size
            row, col = row[more], col[more]
            if not len(row):
                break
        missing = score[0] == -np.inf
        score[0][missing] = self.unknown
        best, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
        best[0] = 0
        for j in range(1, size + 1):
            m = min(j, longest)
            lengths = np.arange(m)
            total = best[j - 1 - lengths] + score[lengths, j - 1 - lengths]
            back[j] = total.argmax(0)
            best[j] = total[back[j], np.arange(n)]
        out = np.zeros((n, size), np.int64)
        count, at, every = np.zeros(n, np.int64), np.full(n, size), np.arange(n)
        while len(every):
            k = back[at[every], every]
            start = at[every] - 1 - k
            piece = ident[k, start, every].astype(np.int64)
            lost = missing[start, every] & (k == 0)
            piece[lost] = -1 - codes[every[lost], start[lost]].astype(np.int64)
            count[every] += 1
            out[every, size - count[every]] = piece
            at[every] = start
            every = every[start > 0]
        return out[np.arange(size) >= (size - count)[:, None]], count

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """int32 ids, as bytes, of each distinct word."""
        out = {}
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in by_size.items():
            step = max(1, CELLS // (size * min(size, self.longest)))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                ids, count = self.viterbi(part)
                if (ids < 0).any():
                    ids, count = self._with_bytes(ids, count)
                packed, ends = ids.astype(np.int32).tobytes(), np.cumsum(4 * count)
                out.update(zip(part, map(packed.__getitem__, map(slice, (ends - 4 * count).tolist(), ends.tolist())), strict=True))
        return out

    def _with_bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every character in no piece becomes the ids of its UTF-8 bytes."""
        lost = np.flatnonzero(ids < 0)
        runs = [_char(-1 - i) for i in ids[lost].tolist()]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(r) for r in runs]
        out = np.repeat(ids, width)
        out[np.repeat(ids < 0, width)] = self.byte_ids[np.frombuffer(b"".join(runs), np.uint8)]
        word = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(word, width, len(count)).astype(np.int64)

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[np.ndarray]:
        """Ids of each text: a space is put before it, and a literal U+2581 goes through its bytes so that decoding is exact."""
        split = [self.units.findall((" " + t).replace(SPACE, _LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(cache) if split else set()
        cache.update(self.encode_words(new))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, u)), np.int32) for u in split]
        if len(cache) > CACHE:
            cache.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _char(code: int) -> bytes:
    return SPACE.encode() if code == ord(_LITERAL) else chr(code).encode("utf-8", "surrogatepass")


def _mapped(df: DataFrame, made: dict[str, T.DataType], columns, sent) -> DataFrame:
    """``df`` with columns made in Arrow batches by ``columns(pieces, batch, state)``, replacing those so named."""
    fields = [f for f in df.schema.fields if f.name not in made]
    kept = small_batches(df).select(*(F.col(f"`{f.name}`") for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, state = Pieces(*sent.value), {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(pieces, part, state)], [*part.schema.names, *made])

    return kept.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, k) for n, k in made.items())]))


def _ids(pieces: Pieces, texts: list[str | None], cache: dict[str, bytes]) -> list[np.ndarray | None]:
    coded = pieces.encode([t or "" for t in texts], cache)
    return [None if t is None else i for t, i in zip(texts, coded, strict=True)]


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    ends = np.r_[0, np.cumsum([0 if i is None else len(i) for i in ids])].astype(np.int32)
    some = [i for i in ids if i is not None]
    flat = np.concatenate(some) if some else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([i is None for i in ids]))


def _texts(pieces: Pieces, ids: list) -> pa.Array:
    return pa.array([None if i is None else pieces.decode(i) for i in ids], pa.string())


def _sent(df: DataFrame, model: str):
    return df.sparkSession.sparkContext.broadcast(read_model(model))


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with ``out_col array<int>``, the piece ids of each whole text; null stays null, the empty text has no id."""

    def columns(pieces: Pieces, part: pa.RecordBatch, cache: dict) -> list[pa.Array]:
        return [_lists(_ids(pieces, part.column(text_col).to_pylist(), cache))]

    return _mapped(df, {out_col: T.ArrayType(T.IntegerType())}, columns, _sent(df, model))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with ``out_col``, the text of each row's ids; null stays null. Ids outside the table raise."""

    def columns(pieces: Pieces, part: pa.RecordBatch, state: dict) -> list[pa.Array]:
        return [_texts(pieces, part.column(ids_col).to_pylist())]

    return _mapped(df, {out_col: T.StringType()}, columns, _sent(df, model))


def encode_and_decode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``decode(encode(df))`` in one pass, so that the ids cross to Python and back once."""

    def columns(pieces: Pieces, part: pa.RecordBatch, cache: dict) -> list[pa.Array]:
        ids = _ids(pieces, part.column(text_col).to_pylist(), cache)
        return [_lists(ids), _texts(pieces, [None if i is None else i.tolist() for i in ids])]

    return _mapped(df, {ids_col: T.ArrayType(T.IntegerType()), out_col: T.StringType()}, columns, _sent(df, model))


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, n_ids, decoded_chars, round_trip)`` for every row: the ids, and whether decoding them gives the text again."""
    both = encode_and_decode(docs.select("doc_id", "text"), model=model)
    return both.select("doc_id", "ids", F.size(F.coalesce("ids", F.array().cast("array<int>"))).alias("n_ids"), F.coalesce(F.char_length("decoded"), F.lit(0)).alias("decoded_chars"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
