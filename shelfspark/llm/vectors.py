"""Vectors as packed tiles, and the grid that brings tiles together: the shared part of exact top-k search and embedding near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Vectors in a tile, and tiles that a task holds while others stream past.
TILE, HELD = 2048, 32
#: Tiles that stream past those a task holds; more of them are parted among tasks.
STREAMED = 512


def clean(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that count: id and vector not null, all parts finite; vectors may differ in length.

    Of rows with one id and one vector one stays.
    """
    v = F.col("embedding").cast("array<double>")
    d = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return d.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).dropDuplicates(["vec_id", "v"])


def matrices(batch: pa.RecordBatch, ids: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(places, ids, matrix) of the vectors of each length in a batch."""
    col = batch.column("v")
    size = np.asarray(pc.list_value_length(col), np.int64)
    flat, key = col.flatten().to_numpy(zero_copy_only=False), batch.column(ids).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, key[at], flat[begin[at][:, None] + np.arange(n)]


def pack(x: np.ndarray) -> bytes:
    """A matrix of vectors dimension by dimension, so that a column of it is a stretch of memory."""
    return np.ascontiguousarray(x.T, np.float64).tobytes()


def opened(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a tile and its matrix, one row for each dimension."""
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.float64).reshape(-1, len(i)) if len(i) else np.zeros((0, 0))


def tiles(d: DataFrame, size: int | None = None) -> DataFrame:
    """(dims, n, ids, data, tile): the vectors of one length in tiles of at most ``size`` rows; nothing is shuffled."""
    size = size or TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dims), strict=True))
            cut = range(0, len(ids), size)
            cols = [pa.array([dims] * len(cut)), pa.array([min(size, len(ids) - a) for a in cut])]
            cols += [pa.array([ids[a : a + size].tobytes() for a in cut], pa.binary()), pa.array([pack(x[a : a + size]) for a in cut], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["dims", "n", "ids", "data"])

        for b in batches:
            for _, ids, x in matrices(b, "vec_id"):
                held.setdefault(x.shape[1], []).append((ids, x))
                if sum(len(i) for i, _ in held[x.shape[1]]) >= 4 * size:
                    yield out(x.shape[1])
        for dims in list(held):
            yield out(dims)

    return d.mapInArrow(tidy(run), "dims long, n long, ids binary, data binary").withColumn("tile", F.monotonically_increasing_id())
