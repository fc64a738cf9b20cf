"""Connected components over any number of executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import drop_stored, stored

#: Graphs of at most so many distinct edges (a few dozen MB) are settled by one task.
SMALL = 1_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least connected place of each of ``n`` places, given links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def merge(label: np.ndarray, rows: np.ndarray, cols: np.ndarray, ok: np.ndarray) -> None:
    """Give places that ``ok`` links (places ``rows`` by ``cols``) one label, the least; ``label`` holds a root for each place and is changed.

    Each round takes one link of every row and column that leads to another label, so the links need not be listed.
    """
    r, c = ok.any(1), ok.any(0)
    while True:
        a, b = label[rows], label[cols]
        seen = np.concatenate([a[r], b[c]])
        if not len(seen) or (seen == seen[0]).all():
            return
        new = ok & (a[:, None] != b[None, :])
        i, j = np.flatnonzero(new.any(1)), np.flatnonzero(new.any(0))
        if not len(i):
            return
        u, v = np.concatenate([a[i], a[new[:, j].argmax(0)]]), np.concatenate([b[new[i].argmax(1)], b[j]])
        roots, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        to = np.arange(len(label))
        to[roots] = roots[forest(len(roots), at[: len(u)], at[len(u) :])]
        label[:] = to[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a small graph."""
    rows = list(batches)
    if not rows:
        return
    u, v = (pa.chunked_array([b.column(c) for b in rows]) for c in ("u", "v"))
    nodes = pc.unique(pa.chunked_array([*u.chunks, *v.chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    i, j = (pc.index_in(x, nodes).to_numpy() for x in (u, v))
    root = forest(len(nodes), i, j)
    for a in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([nodes[a : a + 100_000], nodes.take(pa.array(root[a : a + 100_000]))], ["node", "root"])


def components(edges: DataFrame, rounds: int = 100, small: int = SMALL) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has columns ``a`` and ``b`` of one type that can be ordered (nulls and loops are left out, repeats do no harm). Returns
    (``node``, ``root``) for each node that has an edge, where root is the least node of its component. A graph of at most ``small``
    distinct edges is settled by one task. A larger one alternates large-star and small-star steps, so that the number of rounds grows with
    the logarithm of the component's size; each round is written to the shared folder, and nothing is gathered on the driver but a few counts.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= small:
        kind = now.schema["u"].dataType.simpleString()
        return stored(now.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, root {kind}"))
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = stored(small.distinct())
        n, s, t = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = new
        if (n, s, t) == before:
            break
        before = (n, s, t)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
