"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are compared once. Unit vectors are turned to the axes of their second moments (gathered over all of them), largest
first, and sorted by the leading one, so that tiles of far angles never meet. Pairs of tiles accumulate inner products block
by block of leading dimensions; what the remaining ones can add is at most the product of the two vectors' suffix norms,
which stands beside the block as one more dimension, so that one matrix product gives the bound. A pair whose bound stays
under the threshold is dropped, and a tile pair stops when none is left. Survivors are verified by their cosine in double
precision. Of a tile pair only each vector's number of links and a spanning forest of them leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, stored, tidy
from .vectors import HELD, TILE, clean, matrices, opened, pack

THRESHOLD, BLOCK, SLACK = 0.9, 16, 1e-5
#: Share of pairs left by the leading block beyond which going on block by block takes longer than one product of all dimensions.
DENSE = 0.02


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and which rows they are of (zero vectors have none)."""
    top = np.abs(x).max(1, initial=0)
    some = top > 0
    x = x[some] / top[some][:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], some


def axes(d: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the axes of their second moments, largest first (a column each); from sums over all of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, _, x in matrices(b, "node"):
                u, _ = _unit(x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + u.T @ u
        for n, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, n)), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["dims", "k", "s"])

    got = d.mapInArrow(tidy(sums), "dims long, k long, s double").groupBy("dims", "k").agg(F.sum("s").alias("s")).toArrow()
    dims, k, s = (got.column(c).to_numpy() for c in ("dims", "k", "s"))
    out = {}
    for n in np.unique(dims).tolist():
        own = dims == n
        value, vector = np.linalg.eigh(s[own][np.argsort(k[own])].reshape(n, n))
        out[n] = vector[:, np.argsort(-value)]
    return out


def _turned(d: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """(dims, node, copies, lead, v): unit vectors on their axes, dimensions as bytes; ``lead`` is the angle from the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = b.column("copies").to_numpy()
            for at, node, x in matrices(b, "node"):
                u, some = _unit(x)
                y = u @ turn[x.shape[1]]
                cols = [np.full(len(y), x.shape[1]), node[some], copies[at][some], np.arccos(np.clip(y[:, 0], -1, 1)) if len(y) else np.zeros(0)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([r.tobytes() for r in y], pa.binary())], ["dims", "node", "copies", "lead", "v"])

    return d.mapInArrow(tidy(run), "dims long, node long, copies long, lead double, v binary")


def _tiles(d: DataFrame, size: int) -> DataFrame:
    """(dims, n, ids, copies, data, lo, hi, tile): tiles of rows that lie side by side in the order of their angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            dims, node, copies, lead, v = zip(*held, strict=True)
            x = np.frombuffer(b"".join(v), np.float64).reshape(len(v), dims[0])
            cols = [[dims[0]], [len(v)], [np.array(node).tobytes()], [np.array(copies).tobytes()], [pack(x)], [min(lead)], [max(lead)]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if isinstance(c[0], bytes) else pa.array(c) for c in cols], ["dims", "n", "ids", "copies", "data", "lo", "hi"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("dims", "node", "copies", "lead", "v")), strict=True):
                if held and (len(held) == size or held[0][0] != row[0]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    made = d.repartitionByRange("dims", "lead", "node").sortWithinPartitions("dims", "lead", "node").mapInArrow(tidy(run), "dims long, n long, ids binary, copies binary, data binary, lo double, hi double")
    return made.withColumn("tile", F.monotonically_increasing_id())


class Prepared:
    """A tile as the comparison needs it: blocks of dimensions in single precision, each but the last with the suffix norms beyond it."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        self.single = data.astype(np.float32)
        tail = np.sqrt(np.cumsum((data * data)[::-1], 0)[::-1])
        self.rest = np.r_[tail, np.zeros((1, data.shape[1]))].astype(np.float32)
        first = min(block, len(data))
        self.head = np.ascontiguousarray(np.r_[self.single[:first], self.rest[first : first + 1]])


def dense(head: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether the bounds of the leading block leave so many pairs, as told by some of them, that all dimensions are better multiplied at once."""
    few = np.ascontiguousarray(head[:, :: max(1, head.shape[1] // 32)]).T @ other[:, :: max(1, other.shape[1] // 64)]
    return bool(few.size) and np.count_nonzero(few >= least - SLACK) > DENSE * few.size


def similar(q: Prepared, x: Prepared, least: float, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of vectors a to b of ``q`` and all of ``x``) whose inner product may be at least ``least``; none that is gets lost."""
    dims, block = len(q.data), q.block
    head = q.head[:, a:b]
    if block < dims and dense(head, x.head, least):
        at = np.flatnonzero(q.single[:, a:b].T @ x.single >= least - SLACK)
        return at // x.head.shape[1] + a, at % x.head.shape[1]
    at = np.flatnonzero(head.T @ x.head >= least - SLACK)  # the sum so far and the bound of what is to come, in one product
    if not len(at) or block >= dims:
        return at // x.head.shape[1] + a, at % x.head.shape[1]
    i, j = at // x.head.shape[1] + a, at % x.head.shape[1]
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(i), 200_000):
        u, v = i[s : s + 200_000], j[s : s + 200_000]
        part = np.einsum("ij,ij->j", q.single[:block, u], x.single[:block, v])
        for lo in range(block, dims, block):
            hi = min(dims, lo + block)
            part = part + np.einsum("ij,ij->j", q.single[lo:hi, u], x.single[lo:hi, v])
            ok = part + q.rest[hi, u] * x.rest[hi, v] >= least - SLACK
            u, v, part = u[ok], v[ok], part[ok]
            if not len(u):
                break
        kept.append((u, v))
    return tuple(np.concatenate(p) for p in zip(*kept, strict=True))


def _links(threshold: float):
    """For each pair of tiles: (node, links, root) of the vectors that have links in it; root is a node they are connected with."""

    def pair(a: tuple, b: tuple, same: bool) -> pa.RecordBatch | None:
        (ia, ca, pa_), (ib, cb, pb) = a, b
        found = []
        for s in range(0, len(ia), 512):
            i, j = similar(pa_, pb, threshold, s, min(len(ia), s + 512))
            if same:
                i, j = i[i < j], j[i < j]
            cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->j", pa_.data[:, i[t : t + 100_000]], pb.data[:, j[t : t + 100_000]]) for t in range(0, len(i), 100_000))])
            ok = np.round(cos, 6) >= threshold
            if ok.any():
                found.append((i[ok], j[ok]))
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, shift = (ia, 0) if same else (np.r_[ia, ib], len(ia))
        links = np.bincount(i, weights=cb[j], minlength=len(ids)) + np.bincount(j + shift, weights=ca[i], minlength=len(ids))
        root = forest(len(ids), i, j + shift)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for new, (side, tile, lo, hi, ids, copies, data, diagonal) in groups(batches, ["side", "tile", "lo", "hi", "ids", "copies", "data", "diagonal"], ["row", "column"]):
            if new:
                held = []
            i, x = opened(ids, data)
            one = (i, np.frombuffer(copies, np.int64), Prepared(x))
            if not side:
                held.append((tile, lo, hi, one))
                if not diagonal:
                    continue
            for t, l, h, other in held:
                # angles from one axis that are further apart than the threshold's bring no pair
                if len(other[2].data) == len(x) and max(l - hi, lo - h) <= np.arccos(min(1.0, threshold)) + 1e-6 and (out := pair(other, one, t == tile)) is not None:
                    yield out

    return run


def links(table: DataFrame, threshold: float = THRESHOLD, size: int = TILE, held: int = HELD) -> DataFrame:
    """A row for each vec_id: vec_id, class_id, links.

    ``links`` are the other vectors whose cosine with it, rounded to six decimals, is at least ``threshold`` (over 0); ``class_id`` is
    the least vec_id that a chain of links leads to, its own if there is none. Equal vectors are compared once and count as
    often as they stand. ``table`` has vec_id and embedding. Rows with a null id or vector, or null, NaN or infinite parts,
    have no row; zero vectors, and those of another length than all others, have no links; repeated rows count once. An id of
    several vectors has the links of all (also those between them) and is in the least of their classes. An empty table
    gives none; other columns are ignored. ``size`` and ``held`` (vectors in a tile, tiles that a task holds) change no result.
    """
    d = stored(clean(table).withColumn("h", F.xxhash64("v")))
    # a vector's name is the least id that has it; copies are counted before they are sent
    nodes = stored(d.groupBy("h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    # nodes of equal names (an id with several vectors) are kept apart by numbers
    nodes = stored(nodes.withColumn("name", F.monotonically_increasing_id()))
    of = nodes.select("v", "h", F.col("name").alias("node"), "copies")
    turn = axes(of)
    t = stored(_tiles(_turned(of, turn), size))
    spark = table.sparkSession
    parts, n = int(spark.conf.get("spark.sql.shuffle.partitions")), t.count()
    # rows and columns of the grid are stretches of the order of tiles; so many that there is work for all, and none is too large to hold
    high = max(1, min(n, max(-(-n // held), int(np.ceil(np.sqrt(4 * parts))))))
    place = t.select("tile", "lo", "hi").repartition(1).sortWithinPartitions("tile").withColumn("at", F.monotonically_increasing_id())  # a few numbers for each tile
    t = t.join(place.select("tile", F.floor(F.col("at") * high / max(1, n)).alias("row")), "tile")
    own, other = F.col("row"), F.explode(F.sequence(F.lit(0), F.lit(high - 1)).cast("array<bigint>"))
    cols = ["tile", "lo", "hi", "ids", "copies", "data"]
    left = t.withColumn("other", other).where("other >= row").select(own.alias("row"), F.col("other").alias("column"), F.lit(0).alias("side"), (F.col("row") == F.col("other")).alias("diagonal"), *cols)
    right = t.withColumn("other", other).where("other < row").select(F.col("other").alias("row"), own.alias("column"), F.lit(1).alias("side"), F.lit(False).alias("diagonal"), *cols)
    met = left.unionByName(right).repartition(min(max(1, high * (high + 1) // 2), 20_000), "row", "column").sortWithinPartitions("row", "column", "side", "tile")
    got = stored(met.mapInArrow(tidy(_links(threshold)), "node long, links long, root long"))
    comp = components(got.select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = got.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select(F.col("name").alias("node"), F.col("node").alias("least"), "copies", "h", "v").join(count, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = stored(facts)
    least = facts.groupBy("root").agg(F.min("least").alias("class_id"))
    named = facts.join(least, "root").select("h", "v", "class_id", (F.coalesce("links", F.lit(0)) + F.when(F.exists("v", lambda x: x != 0), F.col("copies") - 1).otherwise(0)).alias("links"))
    return d.join(named, ["h", "v"]).groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")).select("vec_id", "class_id", "links")


def oracle(threshold: float) -> str:
    return f"""
with recursive e as (select vec_id, [x / n for x in v] as v from
     (select vec_id, v, sqrt(list_sum([x * x for x in v])) as n from (select vec_id, cast(embedding as double[]) as v from embeddings)) where n > 0),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id where round(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]), 6) >= {threshold}),
r(node, l) as (select vec_id, vec_id from e union select p.b, r.l from r join p on p.a = r.node)
select e.vec_id, (select min(l) from r where r.node = e.vec_id) as class_id, (select count(*) from p where p.a = e.vec_id) as links from e
"""


ORACLE = oracle(THRESHOLD)
