"""Pairs of near fingerprints by tiles: every row meets every other in some task, whatever the bits are like.

Rows are sorted by time, then by the number of their set bits, and packed into tiles, so that tiles of other times, or of numbers of
bits that lie too far apart, never meet. Stretches of tiles are the rows and columns of a grid, of which only the fields are sent whose sides
may meet; a task compares two stretches, a block of rows with a tile at a time, so what it holds is bounded by ``TILE`` and ``HELD``. Of a comparison leave the task either the pairs, or
each row's number of links and a forest, or, where only clusters are asked for, the forest: then rows that are known to be
connected are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import stored

from .graph import merge

#: Rows in a tile, tiles in a stretch, and rows that are compared with a tile at once.
TILE, HELD, BLOCK = 2048, 32, 128
ASPECT_TOLERANCE = 0.05
_COLS = ["tile", "n", "ids", "hashes", "ratios", "times", "known"]
_KINDS = "tile long, n long, ids binary, hashes binary, ratios binary, times binary, known binary"
#: How far a tile reaches: numbers of set bits, known times (null: none), whether all are known.
_REACH = ["least_bits", "most_bits", "first_time", "last_time", "timed"]
_REACH_KINDS = "least_bits long, most_bits long, first_time long, last_time long, timed boolean"


class Tile:
    """Ids, words (one row each), shapes (NaN: unknown), times and whether these are known; ``at`` is the tile's place in a task."""

    def __init__(self, n: int, ids: bytes, hashes: bytes, ratios: bytes, times: bytes, known: bytes):
        self.n, self.at = n, slice(0, n)
        self.ids, self.times = np.frombuffer(ids, np.int64), np.frombuffer(times, np.int64)
        self.words = np.frombuffer(hashes, np.uint64).reshape(-1, n)
        self.ratios, self.known = np.frombuffer(ratios, np.float64), np.frombuffer(known, bool)
        bits = np.bitwise_count(self.words).sum(0, dtype=np.int64)
        self.bits = int(bits.min()), int(bits.max())
        self.all_known, some = bool(self.known.all()), self.times[self.known]
        self.span = (int(some.min()), int(some.max())) if len(some) else (0, 0)
        shaped = self.ratios[~np.isnan(self.ratios)]
        self.shapes = (float(shaped.min()), float(shaped.max())) if len(shaped) else None

    def meets(self, other: Tile, most: int) -> bool:
        """Whether any pair of both may be near."""
        if self.bits[0] - other.bits[1] > most or other.bits[0] - self.bits[1] > most:
            return False
        return not (self.all_known and other.all_known and (self.span[1] < other.span[0] or other.span[1] < self.span[0]))


def near(a: Tile, b: Tile, i: np.ndarray | slice, j: np.ndarray | slice, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs are near, distances) of rows ``i`` of one tile and ``j`` of the other."""
    dist: np.ndarray | None = None
    for x, y in zip(a.words, b.words, strict=True):
        d = np.bitwise_count(x[i][:, None] ^ y[j][None, :])
        dist = d.astype(np.uint16) if dist is None and len(a.words) > 3 else d if dist is None else np.add(dist, d, out=dist)
    assert dist is not None
    ok = dist <= most
    if not (a.all_known and b.all_known and a.span == b.span and a.span[0] == a.span[1]):
        ok &= (a.times[i][:, None] == b.times[j][None, :]) | ~a.known[i][:, None] | ~b.known[j][None, :]
    if a.shapes and b.shapes:
        lo, hi = min(a.shapes[0], b.shapes[0]), max(a.shapes[1], b.shapes[1])
        if hi - lo > ASPECT_TOLERANCE * lo * (1 - 1e-9):
            x, y = a.ratios[i][:, None], b.ratios[j][None, :]
            ok &= ~(np.abs(x - y) > ASPECT_TOLERANCE * np.maximum(x, y))
    return ok, dist


def tiles(items: DataFrame, words: int, size: int | None = None) -> DataFrame:
    """Packed tiles of items (file_id, hash, width, height, taken_at). Without an id or ``words`` whole words a row has no near ones; equal rows count once."""
    size = size or TILE
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width").cast("double") / F.col("height"))
    d = items.where("file_id is not null and hash is not null").where(F.size("hash") == words).where(~F.exists("hash", lambda x: x.isNull()))
    d = d.select(F.col("file_id").cast("long").alias("id"), F.col("hash").cast("array<bigint>").alias("hash"), ratio.alias("ratio"), F.col("taken_at").cast("long").alias("time")).distinct()
    d = d.withColumn("bits", F.aggregate("hash", F.lit(0), lambda s, x: s + F.bit_count(x).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            hashes = t.column("hash").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
            time = t.column("time")
            raw = [t.column("id").to_numpy(), np.ascontiguousarray(hashes.T), t.column("ratio").fill_null(float("nan")).to_numpy(), time.fill_null(0).to_numpy(), ~time.is_null().to_numpy()]
            bits, span = t.column("bits").to_numpy(), pc.min_max(time).as_py()
            reach = [int(bits.min()), int(bits.max()), span["min"], span["max"], time.null_count == 0]
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([len(t)]), *(pa.array([r.tobytes()], pa.binary()) for r in raw), *(pa.array([x], k) for x, k in zip(reach, kinds, strict=True))], [*_COLS[1:], *_REACH])

        held: list[pa.RecordBatch] = []
        have = 0
        for b in batches:
            held.append(b)
            have += b.num_rows
            while have >= size:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, size))
                held = t.slice(size).to_batches()
                have -= size
        if have:
            yield out(pa.Table.from_batches(held))

    order = ["time", "bits", "id"]
    made = d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{_KINDS.split(', ', 1)[1]}, {_REACH_KINDS}")
    return stored(made.withColumn("tile", F.monotonically_increasing_id()).select(*_COLS, *_REACH))


def _sides(t: DataFrame, most: int, diagonal: bool) -> DataFrame:
    """(own, other) of all stretches that may meet, each with itself only if ``diagonal``."""
    least, last = [F.min(c).alias(c) for c in ("least_bits", "first_time")], [F.max(c).alias(c) for c in ("most_bits", "last_time")]
    s = t.groupBy("own").agg(*least, *last, F.bool_and("timed").alias("timed"))
    x, y = s.alias("x"), s.withColumnRenamed("own", "other").alias("y")
    bits = (F.col("x.least_bits") - F.col("y.most_bits") <= most) & (F.col("y.least_bits") - F.col("x.most_bits") <= most)
    apart = F.col("x.timed") & F.col("y.timed") & ((F.col("x.last_time") < F.col("y.first_time")) | (F.col("y.last_time") < F.col("x.first_time")))
    # a row for each stretch: some tens of thousands of pictures
    got = x.crossJoin(F.broadcast(y)).where(bits & ~apart).select("own", "other")
    return stored(got if diagonal else got.where("own <> other"))


def _fields(t: DataFrame, most: int, diagonal: bool) -> DataFrame:
    """Tiles (with their stretch, ``own``) for each field of the grid (row, column) they are in whose sides may meet."""
    sides = _sides(t, most, diagonal)
    fields = sides.where("own <= other").count()
    d = t.join(F.broadcast(sides), "own")
    d = d.select(F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), (F.col("own") > F.col("other")).alias("side"), *t.columns)
    return d.repartition(min(max(1, 4 * fields), 4096), "row", "column")


def _stretches(t: DataFrame, held: int) -> DataFrame:
    """Tiles with their number and stretch (nr, own)."""
    parts, n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), t.count()
    # so many stretches that there is work for all, and none is too large to hold
    high = max(1, min(n, max(-(-n // held), int(np.ceil(np.sqrt(2 * parts))))))
    place = t.select("tile").repartition(1).sortWithinPartitions("tile").withColumn("nr", F.monotonically_increasing_id())  # a number for each tile
    return t.join(F.broadcast(place), "tile").withColumn("own", F.floor(F.col("nr") * high / max(1, n)))


def _read(table: pa.Table) -> tuple[list[tuple[int, int]], list[Tile], pa.Table]:
    """(pairs of tiles that are to be compared, tiles, the sorted table) of a field."""
    table = table.sort_by([("side", "ascending"), ("nr", "ascending")])
    got, at = [], 0
    for r in table.select(_COLS[1:]).to_pylist():
        x = Tile(*r.values())
        x.at = slice(at, at + x.n)
        at += x.n
        got.append(x)
    side = table.column("side").to_pylist()
    first = [k for k, s in enumerate(side) if not s]
    second = [k for k, s in enumerate(side) if s]
    todo = [(p, q) for p in first for q in second] if second else [(p, q) for p in first for q in first if p <= q]
    # side by side first: what is connected early need not be compared later
    return sorted(todo, key=lambda x: (abs(x[0] - x[1]), x)), got, table


def pairs(items: DataFrame, most: int, words: int, size: int | None = None, held: int = HELD) -> DataFrame:
    """(a, b, distance), a < b, of all near pairs."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        todo, got, _ = _read(table)
        for p, q in todo:
            a, b = got[p], got[q]
            if not a.meets(b, most):
                continue
            for s in range(0, a.n, BLOCK):
                ok, dist = near(a, b, slice(s, s + BLOCK), slice(None), most)
                i, j = np.nonzero(ok)
                x, y, d = a.ids[i + s], b.ids[j], dist[i, j]
                keep = (x != y) & (j > i + s if p == q else True)
                x, y, d = x[keep], y[keep], d[keep]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    def one(table: pa.Table) -> pa.Table:
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
        return pa.Table.from_batches(list(run(table)), kind)

    # smaller fields than for links: the pairs of one are held until its task ends
    d = _fields(_stretches(tiles(items, words, size), min(held, 4)), most, True)
    return d.groupBy("row", "column").applyInArrow(one, "a long, b long, distance int").distinct()


def links(items: DataFrame, most: int, words: int, size: int | None = None, held: int = HELD) -> DataFrame:
    """(node, links, root) for the rows of each field that have links in it; root is a node they are connected with. Every pair is compared once."""

    def run(table: pa.Table) -> pa.Table:
        todo, got, _ = _read(table)
        ids = np.concatenate([x.ids for x in got])
        label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for p, q in todo:
            a, b = got[p], got[q]
            if not a.meets(b, most):
                continue
            shared = np.isin(a.ids, b.ids).any()
            for s in range(0, a.n, BLOCK):
                rows = slice(s, min(a.n, s + BLOCK))
                ok, _ = near(a, b, rows, slice(None), most)
                if shared:
                    ok &= a.ids[rows][:, None] != b.ids[None, :]
                count[a.at.start + rows.start : a.at.start + rows.stop] += np.count_nonzero(ok, axis=1)
                if p != q:
                    count[b.at] += np.count_nonzero(ok, axis=0)
                merge(label, np.arange(a.at.start + rows.start, a.at.start + rows.stop), np.arange(b.at.start, b.at.stop), ok)
        some = np.flatnonzero(count)
        return pa.table({"node": ids[some], "links": count[some], "root": ids[label[some]]})

    return _fields(_stretches(tiles(items, words, size), held), most, True).groupBy("row", "column").applyInArrow(run, "node long, links long, root long")


def _connect(label: np.ndarray, a: Tile, b: Tile, most: int) -> None:
    """Merge the labels of near rows; rows of one label are not compared."""
    if (label[a.at] == label[a.at.start]).all() and (label[b.at] == label[a.at.start]).all():
        return
    for s in range(0, a.n, BLOCK):
        i = np.arange(s, min(a.n, s + BLOCK))
        la, lb = label[a.at][i], label[b.at]
        value, n = np.unique(lb, return_counts=True)
        # rows of the commonest label of the tile meet only what has another one
        often = la == value[n.argmax()]
        rest = np.flatnonzero(lb != value[n.argmax()])
        for rows, cols in ((i[~often], np.arange(b.n)), (i[often], rest)):
            if len(rows) and len(cols):
                ok, _ = near(a, b, rows, cols, most)
                merge(label, rows + a.at.start, cols + b.at.start, ok)


def clusters(items: DataFrame, most: int, words: int, size: int | None = None, held: int = HELD) -> DataFrame:
    """Pairs (a, b) that connect what chains of near rows connect; a few for each row.

    Each stretch is settled by itself first; its labels then tell the other fields what need not be compared.
    """

    def connected(table: pa.Table, before: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        todo, got, table = _read(table)
        ids = np.concatenate([x.ids for x in got])
        start = np.arange(len(ids))
        if before:
            # a stretch's labels are places in it
            own = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("label").to_pylist()])
            side = np.repeat(table.column("side").to_numpy(zero_copy_only=False), [x.n for x in got])
            start = np.where(side, own + int((~side).sum()), own)
        label = start.copy()
        for p, q in todo:
            if got[p].meets(got[q], most):
                _connect(label, got[p], got[q], most)
        return ids, start, label, table

    def first(table: pa.Table) -> pa.Table:
        _, _, label, table = connected(table, False)
        end = np.cumsum(table.column("n").to_numpy())
        parts = [label[b - n : b].tobytes() for b, n in zip(end, table.column("n").to_pylist(), strict=True)]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        roots = [ids[label[b - n : b]].tobytes() for b, n in zip(end, table.column("n").to_pylist(), strict=True)]
        return table.select(["own", "nr", *_COLS, *_REACH]).append_column("label", pa.array(parts, pa.binary())).append_column("roots", pa.array(roots, pa.binary()))

    def then(table: pa.Table) -> pa.Table:
        ids, start, label, _ = connected(table, True)
        root = np.flatnonzero(start == np.arange(len(start)))
        moved = root[label[root] != root]
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("ids").to_pylist(), b.column("roots").to_pylist(), strict=True):
                i, r = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(i[i != r]), pa.array(r[i != r])], ["a", "b"])

    t = _stretches(tiles(items, words, size), held).withColumns({"row": F.col("own"), "column": F.col("own"), "side": F.lit(False)})
    fields = t.agg(F.max("own")).first()[0] or 0
    alone = t.repartition(min(4 * (fields + 1), 4096), "row", "column").groupBy("row", "column")
    kept = stored(alone.applyInArrow(first, f"own long, nr long, {_KINDS}, {_REACH_KINDS}, label binary, roots binary"))
    across = _fields(kept.drop("roots"), most, False).groupBy("row", "column").applyInArrow(then, "a long, b long")
    return kept.select("ids", "roots").mapInArrow(opened, "a long, b long").unionByName(across)
