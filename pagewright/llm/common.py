"""What the text operators share: vectorised word splitting, session set-up, sizes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, over the UTF-8 form of
a text. Every hash here is a 64-bit polynomial over a table of random byte values,
then mixed; equal hashes are taken for equal content (chance of a false match within
n items: n * n / 2**65).
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are turned into arrays at once; a longer single text goes alone.
PIECE = 1 << 19
#: Bytes of a batch that Spark hands to a Python worker; it and the executor's JVM (outside the heap) hold each whole, and while it grows twice.
BATCH = "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.getCheckpointDir():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        at = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder, and read again."""
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of about BATCH bytes for what runs inside, unless the session sets a size itself."""
    mine = spark.conf.get(_BATCH_BYTES, None) is None
    if mine:
        spark.conf.set(_BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(_BATCH_BYTES)


def release() -> None:
    """Gives memory that a task has freed back to the machine, as Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, 2 * len(_powers["p"]), PIECE)
        for k, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


class Piece:
    """Some whole texts as arrays.

    buf: the bytes; off: byte offset of each text, and the end; rows: (first, last) row
    of the batch. starts, ends, word_of: byte offsets of words, and the first word of each
    text, and the end. word_hash: a hash of each word.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int, lower: bool, hashes: bool):
        self.buf = _LOWER[buf] if lower else buf
        self.off, self.first, self.n = off, first, len(off) - 1
        space = _SPACE[self.buf]
        inner = ~space
        s, e = inner.copy(), inner.copy()
        s[1:] &= space[:-1]
        e[:-1] &= space[1:]
        filled = off[:-1] < off[1:]
        at, last = off[:-1][filled], off[1:][filled] - 1
        s[at], e[last] = inner[at], inner[last]
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.word_of = np.searchsorted(self.starts, off)
        if hashes:
            self.word_hash = self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte range."""
        if not hasattr(self, "_sums"):
            p, self._inverse = _table(len(self.buf) + 1)
            self._sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(_BYTES[self.buf] * p[:-1], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(h + (ends - starts).astype(U) * _STEP[63])

    def text_of_word(self) -> np.ndarray:
        """The text, within the piece, of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_of))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k items from each position on; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = h[:n] * _STEP[0]
    for j in range(1, k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def pieces(text: pa.Array, lower: bool = False, hashes: bool = True) -> Iterator[Piece]:
    """The texts of one Arrow column in runs of about PIECE bytes; a null text counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if pa.types.is_large_string(text.type) or not pa.types.is_string(text.type):
        text = text.cast(pa.string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + PIECE, "right")) - 1)
        last = min(last, n)
        yield Piece(buf[off[first] : off[last]], off[first : last + 1] - off[first], first, lower, hashes)
        first = last


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def per_text(values: np.ndarray, word_of: np.ndarray) -> np.ndarray:
    """Sums of a per-word array by text."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[word_of[1:]] - c[word_of[:-1]]


def blocks_for(df: DataFrame, column: str = "text", mb: float = 24.0) -> int:
    """Blocks of about mb MB into which the texts of df go; one narrow aggregate."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(total / (mb * 1e6)) + 1)
