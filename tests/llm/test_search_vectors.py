import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import embed_dedup, topk
from shelfspark.llm.common import forest

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[50:80] = x[:30] + rng.normal(scale=0.02, size=(30, 24)).astype(np.float32)
    x[80] = x[81]  # a tie
    x[200:240] = x[199]  # a group of copies
    return x


@pytest.fixture(scope="module")
def table(spark, data):
    bad = [(None, [1.0] * 24), (900, None), (901, [float("nan")] * 24), (902, [1.0] * 3), (903, [0.0] * 24), (5, data[5].tolist()), (904, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + bad
    return spark.createDataFrame(rows, SCHEMA).withColumn("tile", F.lit("clash")).withColumn("v", F.lit(0)).withColumn("row", F.lit("x"))


def brute(data, k):
    ids = np.r_[np.arange(len(data)), 903]
    x = np.r_[data, np.zeros((1, data.shape[1]))].astype(np.float64)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    out = set()
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out |= {(int(ids[i]), r + 1, int(j), float(v)) for r, (v, j) in enumerate(order)}
    return out


def found(d):
    return {(r.query_id, r["rank"], r.neighbor_id, round(r.distance, 6)) for r in d.collect()}


def test_topk_is_exact(table, data):
    assert found(topk.nearest(table, 5)) == brute(data, 5)


@pytest.mark.parametrize(("size", "rows"), [(37, 512), (64, 10), (5000, 33)])
def test_tiles_change_nothing(table, data, size, rows):
    assert found(topk.nearest(table, 3, size=size, rows=rows)) == brute(data, 3)


def test_stated_queries(table, data):
    want = {x for x in brute(data, 4) if x[0] % 7 == 0}
    assert found(topk.nearest(table, 4, F.col("vec_id") % 7 == 0, size=50)) == want


@pytest.mark.parametrize("size", [None, 17])
def test_ids_with_several_vectors(spark, size):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    ids = np.r_[np.arange(60), np.repeat([7, 8], 14)]
    x = np.r_[x, x[7] + rng.normal(scale=0.05, size=(14, 8)).astype(np.float32), x[7] + rng.normal(scale=0.05, size=(14, 8)).astype(np.float32)]
    d = np.round(np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)), 6)
    want = set()
    for i in range(60):
        near = sorted((d[np.ix_(ids == i, ids == j)].min(), j) for j in range(60) if j != i)[:10]
        want |= {(i, r + 1, j, float(v)) for r, (v, j) in enumerate(near)}
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    assert found(topk.nearest(t, 10, size=size)) == want


def test_search_sends_no_product(table):
    plan = topk.nearest(table, 3)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def classes(ids, x, threshold):
    """Brute force: class and links of each id; rows are vectors."""
    norm = np.sqrt((x * x).sum(1))
    u = x / np.where(norm > 0, norm, 1)[:, None]
    near = np.round(u @ u.T, 6) >= threshold
    near &= (norm > 0)[:, None] & (norm > 0)[None, :]
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        for i in range(len(ids)):
            new[i] = min([root[i], *root[near[i]]])
        if (new == root).all():
            break
        root = new
    least = {r: min(int(i) for i, q in zip(ids, root, strict=True) if q == r) for r in set(root)}
    return {(int(i), min(least[r] for j, r in zip(ids, root, strict=True) if j == i), int(near[ids == i].sum())) for i in set(ids)}


@pytest.mark.parametrize(("size", "held"), [(2048, 32), (41, 2), (16, 1)])
def test_links_are_exact(table, data, size, held):
    ids = np.r_[np.arange(len(data)), 902, 903]
    x = np.r_[data.astype(np.float64), np.zeros((2, data.shape[1]))]
    want = classes(ids, x, 0.9)
    assert sum(n > 0 for _, _, n in want) > 100
    got = embed_dedup.links(table, size=size, held=held)
    assert {(r.vec_id, r.class_id, r.links) for r in got.collect()} == want


def test_links_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    x[20:] = x[:20] + rng.normal(scale=0.01, size=(20, 6))
    ids = np.r_[np.arange(20), np.arange(20) // 2]  # near vectors under the same and under other ids
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.class_id, r.links) for r in embed_dedup.links(t).collect()} == classes(ids, x, 0.9)


def test_forest_labels_are_least_connected():
    i, j = np.array([5, 3, 8, 1]), np.array([3, 2, 9, 0])
    assert forest(10, i, j).tolist() == [0, 0, 2, 2, 4, 2, 6, 7, 8, 8]


def test_empty_and_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.nearest(none).count() == 0
    assert topk.nearest(none, queries=F.col("vec_id") == 1).count() == 0
    assert embed_dedup.links(none).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], SCHEMA)
    assert sorted((r.query_id, r.neighbor_id) for r in topk.nearest(two).collect()) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, embed_dedup.links(two).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_loose_thresholds_multiply_all_dimensions_at_once():
    """Where bounds prune little, pairs were gathered one by one; candidates lose none either way."""
    import numpy as np

    from shelfspark.llm import embed_dedup as e

    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 300))
    p = e.Prepared(x / np.sqrt((x * x).sum(0)))
    assert e.dense(p.head, p.head, 0.35) and not e.dense(p.head, p.head, 0.9999)
    for least in (0.35, 0.6, 0.9):
        i, j = e.similar(p, p, least, 10, 200)
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        cos = p.data.T @ p.data
        assert {(a, b) for a in range(10, 200) for b in np.flatnonzero(np.round(cos[a], 6) >= least)} <= found
    i, j = e.similar(p, p, 0.35)
    assert (np.einsum("ij,ij->j", p.data[:, i], p.data[:, j]) >= 0.35 - 1e-4).all()
