"""Exact k nearest neighbours by columnar branch-and-bound: a stated set of queries against all vectors, in blocks.

Vectors lie in tiles, dimension by dimension. Queries and tiles meet in a grid: a task holds a bounded number of query tiles
and lets its share of the other tiles stream past, so that a query's limit, the distance of its k-th neighbour so far,
tightens from tile to tile. For a tile, squared distances accumulate block of dimensions by block of dimensions; after a
block, what is still to come is at least the squared difference of the two vectors' remaining norms, so candidates whose
sum with that bound is beyond their query's limit go. While many survive, the sums are kept as a matrix of which dead
columns are cut out; once few do, they are compacted to lists of pairs. Distances of survivors are taken anew in double
precision, so that the result is that of the full comparison. A tile whose ball (centre and radius) is beyond the limits
of all queries is left out unopened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, stored, tidy
from .vectors import HELD, STREAMED, clean, opened, tiles

K, BLOCK, QUERY_EVERY = 10, 16, 100
#: Slack for the rounding of sums in single precision, relative to the norms; and of distances to six decimals.
SLACK, ROUNDED = 1e-4, 2e-6
#: Share of surviving cells under which the matrix gives way to lists of pairs.
SPARSE = 0.04


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for a in range(0, len(i), 200_000):
        d = q[:, i[a : a + 200_000]] - x[:, j[a : a + 200_000]]
        out[a : a + 200_000] = np.round(np.sqrt((d * d).sum(0)), 6)
    return out


def within(q: np.ndarray, x: np.ndarray, limit: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose squared distance may be at most the query's ``limit``; none that is gets lost.

    ``q`` and ``x`` hold a row for each dimension.
    """
    dims, nx = len(q), x.shape[1]
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    rest_q = np.sqrt(np.r_[np.cumsum((q * q)[::-1], 0)[::-1], np.zeros((1, q.shape[1]))]).astype(np.float32)
    rest_x = np.sqrt(np.r_[np.cumsum((x * x)[::-1], 0)[::-1], np.zeros((1, nx))]).astype(np.float32)
    scale = float(max(rest_q[0].max(initial=0), rest_x[0].max(initial=0)) ** 2)
    most = (limit + SLACK * max(scale, 1e-12)).astype(np.float32)
    live, acc, i, j, part = np.arange(nx), np.zeros((q.shape[1], nx), np.float32), None, None, None
    for a in range(0, dims, block):
        b = min(dims, a + block)
        if i is None:
            qa, xa = q32[a:b], x32[a:b][:, live]
            acc += (qa * qa).sum(0)[:, None]
            acc += (xa * xa).sum(0)[None, :]
            acc -= 2 * (qa.T @ xa)
            gap = rest_q[b][:, None] - rest_x[b][live][None, :]
            gap *= gap
            gap += acc
            ok = gap <= most[:, None]
            share = ok.mean() if ok.size else 0
            if share < SPARSE or b == dims:
                i, c = np.nonzero(ok)
                part, j = acc[i, c], live[c]
            else:
                column = ok.any(0)
                if not column.all():
                    live, acc = live[column], acc[:, column]
        else:
            d = q32[a:b][:, i] - x32[a:b][:, j]
            part = part + (d * d).sum(0)
            ok = part + (rest_q[b][i] - rest_x[b][j]) ** 2 <= most[i]
            i, j, part = i[ok], j[ok], part[ok]
    return (i, j) if i is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(query: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids of each query, with the nearest row of each: by distance, then id."""
    near = np.lexsort((dist, ids, query))
    near = near[np.r_[True, (query[near][1:] != query[near][:-1]) | (ids[near][1:] != ids[near][:-1])]] if len(near) else near
    order = near[np.lexsort((ids[near], dist[near], query[near]))]
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


class Held:
    """A tile of queries with the best neighbours so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.limit = np.full(len(ids), np.inf)
        self.i, self.d, self.n = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def _first(self, xi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Squared distance of each query's k-th neighbour (by id) within a tile; infinite if there are fewer."""
        by_id = np.argsort(xi, kind="stable")
        each = np.flatnonzero(np.r_[True, xi[by_id][1:] != xi[by_id][:-1]])
        if len(each) <= self.k:
            return np.full(len(self.ids), np.inf)
        d = (self.q * self.q).sum(0)[:, None] + (x * x).sum(0)[None, :] - 2 * (self.q.T @ x)
        d[self.ids[:, None] == xi[None, :]] = np.inf
        d = np.minimum.reduceat(d[:, by_id], each, axis=1)
        return np.partition(d, self.k - 1, axis=1)[:, self.k - 1]

    def meet(self, xi: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float) -> None:
        if not len(xi) or not len(self.ids):
            return
        some = np.arange(len(self.ids))
        limit = self.limit
        if np.isinf(limit).any():
            limit = np.minimum(limit, self._first(xi, x))
        else:
            away = self.q - centre[:, None]
            some = np.flatnonzero(np.sqrt((away * away).sum(0)) - radius <= np.sqrt(limit) + 1e-6)
            if not len(some):
                return
        i, j = within(self.q[:, some], x, limit[some])
        i = some[i]
        other = self.ids[i] != xi[j]
        i, j = i[other], j[other]
        i, d, n = np.r_[self.i, i], np.r_[self.d, _exact(self.q, x, i, j)], np.r_[self.n, xi[j]]
        keep = _best(i, d, n, self.k)
        self.i, self.d, self.n = i[keep], d[keep], n[keep]
        count = np.bincount(self.i, minlength=len(self.ids))
        last = np.cumsum(count) - 1
        full = count >= self.k
        self.limit[full] = (self.d[last[full]] + ROUNDED) ** 2


def _search(k: int, rows: int):
    """For each cell of the grid the k best of its tiles for each of its queries; tiles of queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Held] = []

        def out() -> Iterator[pa.RecordBatch]:
            for h in held:
                if len(h.i):
                    yield pa.RecordBatch.from_arrays([pa.array(h.ids[h.i]), pa.array(h.n), pa.array(h.d)], ["query_id", "neighbor_id", "distance"])
            held.clear()

        for new, (side, ids, data) in groups(batches, ["side", "ids", "data"], ["dims", "row", "column"]):
            if new:
                yield from out()
            i, x = opened(ids, data)
            if not side:
                held += [Held(i[a : a + rows], np.ascontiguousarray(x[:, a : a + rows]), k) for a in range(0, len(i), rows)]
            elif held:
                centre = x.mean(1)
                radius = float(np.sqrt(((x - centre[:, None]) ** 2).sum(0)).max(initial=0))
                for h in held:
                    h.meet(i, x, centre, radius)
        yield from out()

    return run


def nearest(table: DataFrame, k: int = K, queries: Column | None = None, size: int | None = None, rows: int = 512) -> DataFrame:
    """The k nearest other vectors of every query: query_id, rank (from 1), neighbor_id, distance.

    ``table`` has vec_id and embedding; the queries are its rows that the condition ``queries`` (over vec_id) holds for, all of
    them if it is None. Distances are Euclidean, rounded to six decimals; ties go to the lower id. A vector is no neighbour
    of its own id. Vectors of another length than the query's are no neighbours of it. Rows with a null id or vector, or with null, NaN or
    infinite parts, are neither queries nor neighbours; repeated rows count once; of different vectors with one id each
    is a query and a neighbour, and the nearer counts. With fewer than k others there are fewer ranks. An empty table
    gives none; other columns are ignored. ``size`` and ``rows`` (vectors in a tile, queries compared at once) change no result.
    """
    d = stored(clean(table))
    t = stored(tiles(d, size))
    q = stored(tiles(d.where(queries), size)) if queries is not None else t
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a few counts: the grid has a row for each HELD tiles of queries, and so many columns that there is work for all
    nt, nq = (x.groupBy("dims").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] for x in (t, q))
    high = max(1, -(-nq // HELD))
    wide = max(1, min(nt, max(-(-2 * parts // high), -(-nt // STREAMED))))
    cell = ["dims", "row", "column"]
    numbered = lambda x, n, name: x.withColumn(name, F.pmod(F.xxhash64("tile"), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = numbered(q, high, "row").withColumn("column", every(wide)).select(*cell, F.lit(0).alias("side"), "tile", "ids", "data")
    right = numbered(t, wide, "column").withColumn("row", every(high)).select(*cell, F.lit(1).alias("side"), "tile", "ids", "data")
    met = left.unionByName(right).repartition(min(high * wide, 20_000), *cell).sortWithinPartitions(*cell, "side", "tile")
    found = met.mapInArrow(tidy(_search(k, rows)), "query_id long, neighbor_id long, distance double")
    near = found.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k)
    ranked = near.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.neighbor_id").alias("neighbor_id"), F.col("col.distance").alias("distance"))


ORACLE = f"""
with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
p as (select a.vec_id as query_id, b.vec_id as neighbor_id,
      round(sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a.v, b.v)])), 6) as distance
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {QUERY_EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p)
select query_id, cast(rank as integer) as rank, neighbor_id, distance from r where rank <= {K}
"""
