"""What the training-data operators share: shared-folder tables, and whole batches of text as NumPy arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphzone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glyphzone/{name}-{uuid.uuid4().hex}"


def few_files(spark: SparkSession) -> int:
    """Files for a table of a few numbers a row: an eighth of the shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def materialize(df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of executors. files: how many, if not one a task."""
    path = new_path(df.sparkSession, name)
    (df.repartition(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._glyphzone_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._glyphzone_path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have at most `limit` bytes, or one row."""
    _, offsets = buffers(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)
    trim()


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


_LIBC = _libc()


def trim() -> None:
    """Gives memory that is free back to the system: a Python worker lives on and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: ASCII letters to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words that consist of digits, letters and non-ASCII characters (after LOWER).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from running polynomials."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_R, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_R_INV, len(data) + 1)[start] + (end - start).astype(np.uint64))


class Words:
    """All words of a chunk of texts: byte positions, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NON_SPACE, fold: bool = True):
        self.data = data = LOWER[data] if fold else data
        n = len(data)
        inside = kind[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[edges] = inside[edges]
            ends[edges[1:] - 1] = inside[edges[1:] - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = hash_spans(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)  # of text i: first[i] .. first[i+1]

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives these words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    kind = np.ones(256, bool)
    kind[32] = False
    return Words(data, np.array([0, len(data)]), kind, fold=False).hash


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def summed(pieces: DataFrame) -> DataFrame:
    """Rows (piece, sums: vectors of doubles as bytes) added up by piece, in two steps, so that no task holds a row of every task."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                part = np.frombuffer(x.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "sums"])

    spread = pieces.groupBy("piece", F.pmod(F.xxhash64("sums"), F.lit(64)).alias("part"))
    return spread.applyInArrow(add, "piece int, sums binary").groupBy("piece").applyInArrow(add, "piece int, sums binary")
