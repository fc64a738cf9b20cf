import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import dedup, graph, grid, similar
from shelfspark.operators.rank import ranked
from shelfspark.plans import registry

CTX = "group_id long, file_id long, size long, mtime long, status int, full_hash string, hashed_size long, hashed_mtime long"


def plan(spark, rows, marked, disk=None, **kw):
    d = spark.createDataFrame([(f, s, m) for _, f, s, m, *_ in rows] if disk is None else disk, "file_id long, size long, mtime long")
    m = spark.createDataFrame([(x,) for x in marked], "file_id long")
    return {(r.file_id, r.reason) for r in dedup.delete_plan(spark.createDataFrame(rows, CTX), m, d, **kw).collect()}


def test_delete_plan(spark):
    rows = [(1, 10, 100, 1, 0, "h", 100, 1), (1, 11, 100, 1, 0, "h", 100, 1)]
    assert plan(spark, rows, [11]) == {(11, "OK")}
    assert plan(spark, rows, [10, 11]) == {(10, "KEEP_NONE"), (11, "KEEP_NONE")}
    assert plan(spark, rows, [11], [(10, 100, 1), (11, 7, 1)]) == {(11, "CHANGED_ON_DISK")}
    assert plan(spark, rows, [11], [(10, 9, 1), (11, 100, 1)]) == {(11, "NO_VERIFIED_SURVIVOR")}
    other = [rows[0], (1, 11, 100, 1, 0, "g", 100, 1)]
    assert plan(spark, other, [11]) == {(11, "HASH_MISMATCH")}
    assert plan(spark, other, [11], check_hash=False) == {(11, "OK")}
    assert plan(spark, [rows[0], (1, 11, 100, 1, 1, None, None, None)], [11]) == {(11, "NOT_PRESENT")}
    twice = [(1, 10, 1, 1, 0, "h", 1, 1), (1, 11, 1, 1, 0, "h", 1, 1), (2, 11, 1, 1, 0, "h", 1, 1), (2, 12, 1, 1, 0, "h", 1, 1)]
    assert plan(spark, twice, [11]) == {(11, "OK")}


def test_rules(spark):
    cols = "group_id long, file_id long, size long, mtime long, status int, width long, height long, taken_at long"
    d = spark.createDataFrame([(1, 1, 9, 5, 0, 100, 100, None), (1, 2, 5, 9, 0, 400, 300, None), (1, 3, 5, 1, 1, 900, 900, 1), (2, 4, 1, 1, 1, None, None, None), (3, 5, 1, 1, 1, None, None, None), (3, 6, 1, 1, 1, None, None, None)], cols)
    marked = lambda rule: {r.file_id for r in dedup.rule_marks(d, rule).where("marked").collect()}
    assert marked("res") == {1, 3, 6}
    assert marked("oldest") == {2, 3, 6}
    assert marked("newest") == {1, 3, 6}


def test_hash_upsert_keeps_full_only_for_same_snapshot(spark):
    files = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 30, 1)], "id long, size long, mtime long")
    old = spark.createDataFrame([(1, "q", "f", 10, 1), (2, "q", "f", 19, 1)], "file_id long, quick string, full_hash string, hashed_size long, hashed_mtime long")
    new = spark.createDataFrame([(1, "n", None, 10, 1), (2, "n", None, 20, 1), (3, "n", None, 31, 1)], "file_id long, quick string, full_hash string, src_size long, src_mtime long")
    got = {r.file_id: (r.quick, r.full_hash, r.hashed_size) for r in dedup.upsert_hashes(files, old, new).collect()}
    assert got == {1: ("n", "f", 10), 2: ("n", None, 20)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def items(spark, rows):
    full = [(i, [h, 0, 0, 0], w, hh, t) for i, h, w, hh, t in rows]
    return spark.createDataFrame(full, "file_id long, hash array<long>, width long, height long, taken_at long")


def groups(spark, rows):
    d = items(spark, rows)
    out = {}
    for r in similar.similar_members(d, similar.similar_pairs(d)).collect():
        out.setdefault(r.group_id, []).append(r.file_id)
    return sorted(sorted(x) for x in out.values())


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, 0, None, None, None), (2, 1, None, None, None)], [[1, 2]]),
        ([(1, 0, 100, 100, None), (2, 1, 100, 200, None)], []),
        ([(1, 0, None, None, None), (2, (1 << 15) - 1, None, None, None), (3, (1 << 30) - 1, None, None, None)], [[1, 2, 3]]),
        ([(i, 0, None, None, i) for i in range(13)], []),
        ([(1, 0, None, None, 5), (2, 0, None, None, 5), (3, 0, None, None, None), (4, 0, None, None, 6), (5, 0, None, None, 6)], [[1, 2], [4, 5]]),
        ([(1, -1, None, None, None), (2, -2, None, None, None)], [[1, 2]]),
    ],
)
def test_similar_groups(spark, rows, want):
    assert groups(spark, rows) == want


def test_banded_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(60):
        h = list(base[i % 6])
        for _ in range(rng.randrange(14)):
            b = rng.randrange(256)
            h[b // 64] ^= 1 << (b % 64)
        rows.append((i, [x - (1 << 64) if x >> 63 else x for x in h], None, None, None))
    d = spark.createDataFrame(rows, "file_id long, hash array<long>, width long, height long, taken_at long")
    dist = lambda x, y: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x, y, strict=True))
    want = {(a[0], b[0], dist(a[1], b[1])) for a in rows for b in rows if a[0] < b[0] and dist(a[1], b[1]) <= 16}
    assert want and {tuple(r) for r in similar.similar_pairs(d).collect()} == want


def test_inherit_ids(spark):
    now = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (7, 7), (7, 8)], "group_id long, file_id long")
    before = spark.createDataFrame([(50, 1), (50, 4), (50, 5), (51, 2), (51, 3)], "group_id long, file_id long")
    got = {r.file_id: r.group_id for r in similar.inherit_ids(now, before).collect()}
    assert (got[1], got[4], got[7]) == (51, 50, 52)


def test_waste(spark):
    m = spark.createDataFrame([(1, 1), (1, 2)], "group_id long, file_id long")
    f = spark.createDataFrame([(1, 2_000_000), (2, 800_000)], "id long, size long")
    assert similar.similar_waste(m, f).first().waste == 800_000


def test_pairs_to_trash(spark):
    pairs = spark.createDataFrame([(1, 10, 11), (2, 20, 21)], "file_id long, pair_id long, kept_pair_id long")
    refs = spark.createDataFrame([(10, 1), (10, 3), (20, 2)], "pair_id long, image_id long")
    gone = spark.createDataFrame([(1,), (2,)], "file_id long")
    assert [r.pair_id for r in dedup.pairs_to_trash(pairs, refs, gone).collect()] == [20]


def test_remove_deleted_clears_links(spark):
    f = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, live_pair_id long")
    got = {r.id: r.live_pair_id for r in dedup.remove_deleted(f, spark.createDataFrame([(2,)], "file_id long")).collect()}
    assert got == {1: None, 3: None}


def test_ranked_numbers_across_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), "id").unionByName(spark.createDataFrame([(None, -1)], "x long, id long"))
    got = ranked(d.repartition(7), "x", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1002))
    assert [(r.x, r.id) for r in got] == sorted(((r.x, r.id) for r in got), key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert ranked(d.limit(0), "x").count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "decimal(30,0)"])
def test_components_of_small_and_large_graphs_agree(spark, kind):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    d = spark.createDataFrame(edges, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    one, many = ({(r.node, r.root) for r in graph.components(d, small=n).collect()} for n in (1_000_000, 0))
    assert one == many and len(one) > 200
    assert graph.components(d.limit(0)).count() == 0


def _random_items(spark, n, words, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h = [rng.getrandbits(64) & rng.getrandbits(64) if spread else rng.getrandbits(8) for _ in range(words)]
        rows.append((i * 3, [x - (1 << 64) if x >> 63 else x for x in h], rng.choice([None, 0, 100, 104, 150]), 100, rng.choice([None, 1, 2, 3])))
    rows += rows[:5] + [(None, [0] * words, None, None, None), (9_999, None, None, None, None)]
    return rows, spark.createDataFrame(rows, "file_id long, hash array<long>, width long, height long, taken_at long")


def _naive_pairs(rows, most):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] is None or b[0] is None or a[1] is None or b[1] is None or a[0] >= b[0]:
                continue
            d = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[1], b[1], strict=True))
            r, s = (x[2] / x[3] if x[2] else None for x in (a, b))
            if d <= most and (r is None or s is None or abs(r - s) <= 0.05 * max(r, s)) and (a[4] is None or b[4] is None or a[4] == b[4]):
                out[a[0], b[0]] = d
    return out


@pytest.mark.parametrize(("words", "most", "spread"), [(1, 20, True), (4, 9, False), (1, 2, False), (4, 100, True)])
def test_grid_against_all_pairs(spark, words, most, spread):
    rows, d = _random_items(spark, 230, words, words + most, spread)
    want = _naive_pairs(rows, most)
    assert want
    # tiles of 16 rows, two to a stretch, so that the grid has many fields
    got = {(r.a, r.b): r.distance for r in grid.pairs(d, most, words, size=16, held=2).collect()}
    assert got == want
    edges = spark.createDataFrame([(a, b) for a, b in want], "a long, b long")
    comp = {(r.node, r.root) for r in graph.components(edges).collect()}
    assert {(r.node, r.root) for r in graph.components(grid.clusters(d, most, words, size=16, held=2)).collect()} == comp
    found = grid.links(d, most, words, size=16, held=2).collect()
    count = {}
    for r in found:
        count[r.node] = count.get(r.node, 0) + r.links
    assert count == {x: sum(x in p for p in want) for x in {y for p in want for y in p}}
    forest = spark.createDataFrame([(r.node, r.root) for r in found], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(forest).collect()} == comp


def test_clusters_of_many_alike_leave_few_pairs(spark):
    """Equal bands made every row meet every other, and every pair was listed."""
    d = spark.range(3000).selectExpr("id as file_id", "array(id % 4, 0L, 0L, 0L) as hash", "cast(null as long) as width", "cast(null as long) as height", "cast(null as long) as taken_at")
    got = similar.similar_clusters(d)
    assert got.count() <= 2 * 3000
    assert {r.root for r in graph.components(got).collect()} == {0}
    assert grid.pairs(d.limit(0), 16, 4).count() == grid.clusters(d.limit(0), 16, 4).count() == grid.links(d.limit(0), 16, 4).count() == 0


@pytest.mark.parametrize(("words", "most", "spread"), [(4, 9, False), (4, 60, True), (1, 20, True)])
def test_links_against_all_pairs(spark, words, most, spread):
    """A row for each picture, not one for each pair."""
    rows, d = _random_items(spark, 120, words, 7, spread)
    want = _naive_pairs(rows, most)
    got = {r.file_id: r for r in similar.similar_links(d, most, words).collect()}
    ids = {r[0] for r in rows if r[0] is not None and r[1] is not None}
    assert set(got) == ids
    assert {i: r.links for i, r in got.items()} == {i: sum(i in p for p in want) for i in ids}
    comp = {r.node: r.root for r in graph.components(spark.createDataFrame(list(want), "a long, b long")).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: comp.get(i, i) for i in ids}


def test_group_lists_are_whole(spark):
    """Lists ended after 10,000 groups and 200,000 members."""
    m = spark.range(210_000).selectExpr("id % 10001 as group_id", "id as file_id", "id % 7 as size", "id as mtime", "'x' as full_hash")
    assert dedup.dup_groups(m).count() == 10_001
    assert dedup.members_brief(m).count() == 210_000
    assert dedup.dup_groups(m, 5).count() == dedup.members_brief(m, 5).count() == 5


def _alike(spark, tmp_path, monkeypatch, name):
    """The query's rows over 3,000 equal vectors of three labels (id modulo 3), whose pairs must not be listed."""
    listed, members = [], similar.similar_members

    def watched(d, pairs):
        listed.append(pairs.count())
        return members(d, pairs)

    monkeypatch.setattr(similar, "similar_members", watched)
    v = spark.range(3000).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> cast(if(x % 3 = 0, 1, -1) as float)) as embedding", "cast(id % 3 as int) as label")
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(listed) == 1 and listed[0] <= 2 * 3000
    return rows


def test_fields_that_cannot_meet_are_not_sent(spark):
    """Each tile went to every stretch of the grid, also to those of other times."""
    d = spark.range(640).selectExpr("id as file_id", "array(id % 7) as hash", "cast(null as long) as width", "cast(null as long) as height", "id % 10 as taken_at")
    t = grid._stretches(grid.tiles(d, 1, 16), 2)
    own = {r.own for r in t.collect()}
    sent = grid._fields(t, 2, True).collect()
    assert {(r.row, r.column) for r in sent} >= {(x, x) for x in own}
    # a time has 64 rows, so a stretch of up to 32 meets itself and the few beside it
    assert len(sent) <= 6 * t.count() < len(own) * t.count()
    got = {(r.node, r.root) for r in graph.components(grid.clusters(d, 2, 1, size=16, held=2)).collect()}
    assert got == {(i, i % 10) for i in range(640)}


def test_similar_groups_lists_no_pairs(spark, tmp_path, monkeypatch):
    got = {tuple(r) for r in _alike(spark, tmp_path, monkeypatch, "similar_groups")}
    assert got == {(i % 3, i) for i in range(3000)}


def test_similar_delete_plan_lists_no_pairs(spark, tmp_path, monkeypatch):
    got = {tuple(r) for r in _alike(spark, tmp_path, monkeypatch, "similar_delete_plan")}
    state = lambda i: "NOT_PRESENT" if i % 7 == 0 else "CHANGED_ON_DISK" if i % 5 == 0 else "OK"
    want = {(0, i, None, "KEEP_NONE") for i in range(0, 3000, 3)}
    want |= {(g, i, s, state(i)) for g, s in ((1, 1), (2, 11)) for i in range(g, 3000, 3) if i % 2 == 0}
    assert got == want


def test_similar_inherit_lists_no_pairs(spark, tmp_path, monkeypatch):
    got = {tuple(r) for r in _alike(spark, tmp_path, monkeypatch, "similar_inherit")}
    assert got == {(i % 3, i) for i in range(3000)}


def test_similar_stats_lists_no_pairs(spark, tmp_path, monkeypatch):
    got = {tuple(r) for r in _alike(spark, tmp_path, monkeypatch, "similar_stats")}
    assert got == {(g, 1000, sum(i * 10 + 1 for i in range(g, 3000 - 3, 3))) for g in range(3)}
