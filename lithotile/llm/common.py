"""Shared pieces of the training-data operators: the shared folder, bounded joins and batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table that may be broadcast, as summed over its rows; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_roots: dict[str, str] = {}
#: Paths that stash has written and release has not deleted, in order.
written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables, below spark.checkpoint.dir where that is set."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lithotile-")
            spark.sparkContext.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/lithotile-{app}"
        _roots[app] = root
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        return


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str], unless: DataFrame) -> None:
    """Delete written tables that the plan of `unless` does not read."""
    read = unless.inputFiles() if paths else []
    jvm = spark.sparkContext._jvm
    for path in paths:
        if not any(path.removeprefix("file://") in f for f in read):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            written.remove(path)


def _width(field: StructField) -> Column | int:
    """Bytes of a column in a broadcast row, at least about."""
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, ArrayType):
        each = 40 if isinstance(field.dataType.elementType, (StringType, StructType)) else 8
        return F.coalesce(F.array_size(field.name), F.lit(0)) * each + 24
    return 8


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast small only if the bytes of its rows, summed, are within the bound; otherwise Spark joins by shuffle with skew handling.

    small is read for the sum and for the join, so it is a written table or one that costs little.
    """
    row = sum((_width(f) for f in small.schema.fields), F.lit(32).cast("long"))
    if (small.agg(F.sum(row)).first()[0] or 0) <= bound:
        small = F.broadcast(small)
    return big.join(small, on, how)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        v = x.as_py()
        yield v if v is not None else b""


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about size bytes of text (one row at least), which bounds working memory."""
    if batch.num_rows == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return memory that this process has freed to the system: an idle Python worker would else keep its largest task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives its memory back when a task's last batch is out."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.array([1] + [_BASE] * (2 * _PIECE), np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * (2 * _PIECE), np.uint64), dtype=np.uint64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) < 91), np.roll(_BYTE, -32), _BYTE)


def _long_word(values: np.ndarray) -> np.uint64:
    """The hash of one word of more than _PIECE bytes: its pieces' sums, mixed in turn."""
    h = np.full(1, len(values), np.uint64)
    for a in range(0, len(values), _PIECE):
        part = values[a : a + _PIECE]
        h = mix64(h ^ (part * _POWER[: len(part)]).sum(dtype=np.uint64))
    return h[0]


def hash_words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a buffer of UTF-8 bytes, and the place where each word starts.

    A word's hash is the difference of two running sums of byte * base^place, brought to place 0; sums run over pieces of
    the buffer that end between words.
    """
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out, starts
    table = _BYTE_LOWER if lower else _BYTE
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + _PIECE, _PIECE)))
    sums = np.zeros(2 * _PIECE + 1, np.uint64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = int(starts[i]), int(ends[j - 1])
        if ends[j - 1] - starts[j - 1] > _PIECE:  # only the last word of a piece can reach beyond it
            j -= 1
            out[j] = _long_word(table[data[starts[j] : b]])
            if i == j:
                continue
            b = int(ends[j - 1])
        n = b - a
        np.cumsum(table[data[a:b]] * _POWER[:n], out=sums[1 : n + 1])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _INVERSE[s]
    return mix64(out), starts


def joined(column: pa.Array, sep: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column in one byte buffer, a separator after each; starts[i]..starts[i+1] is text i with it."""
    parts = list(text_bytes(column))
    data = np.frombuffer(bytes([sep]).join(parts) + bytes([sep]), np.uint8) if parts else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return data, starts
