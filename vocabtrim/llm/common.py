"""Helpers shared by the operators: table access, shared-folder writes, and the
vectorised byte work (words, polynomial hashes) done inside Arrow tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20
"""Text bytes a task holds in its numpy work arrays at a time (one longer text is a chunk alone)."""

# White space of a word pattern [^\x20\x09-\x0D]+ .
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint directory and read it
    back: the lineage ends there and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bytes of a batch

def chunks(batch: pa.RecordBatch, col: str = "text", size: int = CHUNK_BYTES):
    """Yield ``(first, last, data, offs)`` for runs of rows of at most about ``size``
    bytes: ``data`` their UTF-8 bytes (uint8), ``offs`` the row borders in it.
    A null text is empty."""
    arr = batch.column(col).cast(pa.large_string()).fill_null("")
    n = len(arr)
    if n == 0:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, arr.offset * 8)
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        o = offs[first:last + 1]
        yield first, last, raw[o[0]:o[-1]], o - o[0]
        first = last


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE):
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of a chunk, or of
    the runs of bytes that ``between`` does not mark."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~between[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    begin[offs[full]] = word[offs[full]]
    end[offs[full + 1] - 1] = word[offs[full + 1] - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection with good avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes modulo 2**64 of any substring of a chunk, from one prefix sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(0, 2 ** 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2 ** 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2 ** 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit combination of two hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


# ---------------------------------------------------------------- tokenizer

def _kinds() -> np.ndarray:
    t = np.full(256, 4, np.uint8)
    t[33:127] = 2
    t[48:58] = 1
    for some in (slice(65, 91), slice(97, 123), slice(0x80, 0xC0), slice(0xC3, 0xCA)):
        t[some] = 0
    t[[9, 10, 13, 32]] = 3
    return t


KIND = _kinds()
"""Bytes of letters (0), digits (1), other signs (2), white space (3) and of characters beyond these (4)."""


class CachedBpe:
    """Byte-level BPE ids as little-endian uint32 bytes, one dictionary hit a piece.

    A text is cut into the vocabulary's pre-token pieces; ids of a piece do not
    depend on its neighbours, so they are kept in a bounded cache.  Texts with
    characters beyond Latin letters go to the tokenizer whole."""

    LIMIT = 400_000

    def __init__(self, ranks_path: str):
        import base64
        import re

        import tiktoken
        from public_tokenizers import PATTERN
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        letters = "A-Za-zÀ-ÖØ-öø-ɏ"
        self.odd = re.compile(f"[^\\t\\n\\r -~À-ÖØ-öø-ɏ]").search
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+"
                                 f"| ?[^\\s{letters}0-9]+|\\s+(?!\\S)|\\s+").findall
        outer = self

        class Cache(dict):
            def __missing__(self, piece):
                ids = outer._ids(piece)
                if len(self) >= outer.LIMIT:
                    self.clear()
                self[piece] = ids
                return ids
        self.cache = Cache()

    def _ids(self, text: str | bytes) -> bytes:
        text = text.decode() if isinstance(text, bytes) else text
        return np.array(self.enc.encode_ordinary(text), dtype="<u4").tobytes()

    def many(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts one after another, and the borders of the texts in them.
        Each distinct piece of the chunk is looked up once; a text with other characters is one piece."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        kind = KIND[data]
        first = np.zeros(len(data), bool)
        first[offs[:-1][np.diff(offs) > 0]] = True
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white space before more text stands apart, and a blank goes with what follows
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:])
        start[last] = True
        start[last[data[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll
        q = np.flatnonzero((data == 39) & start)
        end = offs[np.searchsorted(offs, q, "right")]
        a, b = (np.where(q + k < end, data[np.minimum(q + k, len(data) - 1)], 0) for k in (1, 2))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        n = np.where(np.isin(a, list(b"stmd")), 1, 2 * two)
        start[q[n > 0] + 1] = False
        after = (q + 1 + n)[n > 0]
        start[after[after < end[n > 0]]] = True
        beyond = [np.flatnonzero(kind == 4)]
        for lead, of in ((0xC3, lambda x: (x == 0x97) | (x == 0xB7)), (0xC9, lambda x: x > 0x8F)):
            at = np.flatnonzero(data == lead)
            beyond.append(at[of(data[at + 1])])
        for row in np.unique(np.searchsorted(offs, np.concatenate(beyond), "right") - 1).tolist():
            start[offs[row] + 1:offs[row + 1]] = False
            start[offs[row]] = True
        bounds = np.flatnonzero(start)
        borders = pa.py_buffer(np.append(bounds, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(bounds), [None, borders, pa.py_buffer(data)]).dictionary_encode()
        # long pieces are not kept
        ids = [self.cache[p] if len(p) <= 64 else self._ids(p) for p in coded.dictionary.to_pylist()]
        n, at = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, coded.indices.to_numpy()
        stop = np.cumsum(n[at])
        place = np.repeat((np.cumsum(n) - n)[at] - stop + n[at], n[at]) + np.arange(stop[-1])
        return np.frombuffer(b"".join(ids), "<u4")[place], np.concatenate(([0], stop))[np.searchsorted(bounds, offs)]

    def __call__(self, text: str) -> bytes:
        if self.odd(text):
            return self._ids(text)
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))
