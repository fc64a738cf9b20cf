"""Helpers shared by the operators: table access, Arrow text buffers, packed rows; tables written once and graph components come from the library."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from shelfspark.operators.graph import components, forest
from shelfspark.session import drop_stored, shared_dir, ship, stored

__all__ = ["components", "drop_stored", "forest", "shared_dir", "stored"]

#: Texts are handed to numpy in pieces of about this many bytes, so that a worker's arrays stay small.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch, as texts may be long; Spark's own default is 10,000.
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and let Arrow batches be small, unless the session has its own setting for them."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column, without a copy; a null text has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.malloc_trim  # noqa: B018
        return lib
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if (lib := _libc()) is not None:
        lib.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a generator over batches, returning what it freed when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def column_udf(f: Callable, kind: str) -> Callable:
    """A function of Arrow columns as a column expression; memory is returned when a task ends."""

    @tidy
    def run(batches: Iterator) -> Iterator[pa.Array]:
        for b in batches:
            yield f(*b) if isinstance(b, tuple) else f(b)

    return F.arrow_udf(run, kind, functionType=ArrowUDFType.SCALAR_ITER)


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which workers find a file of the driver with ``local_file``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def local_file(name: str) -> str:
    return SparkFiles.get(name)


def doc_chunks(offs: np.ndarray, most: int = CHUNK_BYTES, docs: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``docs`` documents and about ``most`` bytes; a longer document stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = min(n, i + docs, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield i, j
        i = j
        give_back()


def groups(batches: Iterator[pa.RecordBatch], cols: list[str], key: list[str]) -> Iterator[tuple[bool, tuple]]:
    """Rows of a partition that is sorted by ``key``: (whether a new key begins, the values of ``cols``); a row at a time."""
    last = None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
        arrays = [b.column(c) for c in cols]
        for r, k in enumerate(keys):
            yield k != last, tuple(a[r].as_py() for a in arrays)
            last = k


def pack_blocks(cols: list[np.ndarray], block: np.ndarray) -> pa.RecordBatch | None:
    """Rows of several number columns as one binary value for each block, byte planes side by side so that they compress.

    The value starts with the number of rows; ``unpack_packed`` restores the columns.
    """
    if not len(block):
        return None
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    cols = [np.ascontiguousarray(c[order]) for c in cols]
    raw = []
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(block)], strict=True):
        raw.append(b"".join([np.int64(y - x).tobytes(), *(c[x:y].view(np.uint8).reshape(y - x, -1).T.tobytes() for c in cols)]))
    return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int64)), pa.array(raw, pa.binary())], ["block", "data"])


def unpack_packed(raw: list[np.ndarray], kinds: list[type]) -> list[np.ndarray]:
    """The columns packed by ``pack_blocks`` in some rows, one after the other."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for view in raw:
        n, at = int(view[:8].view(np.int64)[0]), 8
        for p, k in zip(parts, kinds, strict=True):
            w = np.dtype(k).itemsize
            p.append(np.ascontiguousarray(view[at : at + n * w].reshape(w, n).T).view(k)[:, 0])
            at += n * w
    return [np.concatenate(p) for p in parts]


def blocks_of(spark: SparkSession) -> int:
    """Number of blocks that packed rows are parted into: a few for each shuffle partition, so that these fill evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
