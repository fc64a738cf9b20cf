import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import index, search
from shelfspark.operators.search import FileFilter

FILES = "id long, dir_path string, name string, ext string, kind int, size long, mtime long, status int, live_pair_id long, seen_gen int"
META = "file_id long, width long, height long, duration_ms long, taken_at long"


@pytest.fixture(scope="module")
def files(spark):
    d = "D:\\TestPhotos"
    rows = [
        (1, d, "IMG_1234.jpg", "jpg", 0, 1000, 500, 0, None, 1), (2, d + "\\2019", "ảnh tết.png", "png", 0, 3000, 100, 0, None, 1),
        (3, d, "beach_sunset.mp4", "mp4", 1, 9000, 700, 0, None, 2), (4, d + "Old", "x.jpg", "jpg", 0, None, None, 0, None, 1), (5, d, None, None, 0, 5, 5, 1, None, 1),
    ]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([(1, 100, 200, None, 900)], META)


def ids(d):
    return [r.id for r in d.collect()]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (FileFilter(), [1, 3, 2, 4]),
        (FileFilter(text="anh tet"), [2]),
        (FileFilter(text="ẢNH"), [2]),
        (FileFilter(text="ea"), [3]),
        (FileFilter(text="100%"), []),
        (FileFilter(exts=(" .JPG",)), [1, 4]),
        (FileFilter(size_min=1000, size_max=3000), [1, 2]),
        (FileFilter(min_px=20000), [1]),
        (FileFilter(root="d:\\testphotos"), [1, 3, 2]),
        (FileFilter(sort="size_desc", kind=0), [2, 1, 4]),
        (FileFilter(date_field="mtime", sort="mtime_asc", kind=0), [4, 2, 1]),
        (FileFilter(include_missing=True, size_max=5), [5]),
    ],
)
def test_listing(files, meta, f, want):
    assert ids(search.listing(files, meta, f)) == want


def test_page_and_hydrate(spark, files, meta):
    assert ids(search.page(search.listing(files, meta, FileFilter()), 1, 2)) == [3, 2]
    assert search.page(search.listing(files, meta, FileFilter()), 99, 2).count() == 0
    want = spark.createDataFrame([(0, 2), (1, 999)], "pos int, id long")
    assert [(r.pos, r.name) for r in search.fetch_rows(files, meta, want).collect()] == [(0, "ảnh tết.png"), (1, None)]


def test_empty_table(files, meta):
    none = files.limit(0)
    assert search.listing(none, meta, FileFilter(text="a", min_px=1)).count() == 0
    assert index.pair_live_photos(none).count() == 0


def test_reconcile_spares_unreadable(files):
    got = {r.id: r.status for r in index.reconcile(files, "D:\\TestPhotos", 2, ["D:\\TestPhotos\\2019"]).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


def test_merge_keeps_ids_and_flags_changes(spark, files):
    scan = spark.createDataFrame([("d:\\testphotos", "img_1234.JPG", 1001, 500, 0), ("D:\\TestPhotos", "new.jpg", 1, 1, 0)], "dir_path string, name string, size long, mtime long, status int")
    got = {(r.id, r.name): r.stale for r in index.merge_scan(files, scan, 9).collect()}
    assert got[(1, "img_1234.JPG")] is True
    top = files.agg(F.max("id")).first()[0]
    assert got[(top + 1, "new.jpg")] is False
    kept = {r.id: r for r in index.merge_scan(files, scan, 9).collect()}
    assert kept[1].dir_path == "D:\\TestPhotos" and kept[1].seen_gen == 9 and kept[top + 1].ext == "jpg" and kept[top + 1].kind == 0


def test_live_pairs(spark):
    rows = [(1, "d", "A.heic", "heic", 0, 0), (2, "d", "a.JPG", "jpg", 0, 0), (3, "D", "a.mov", "mov", 1, 0), (4, "e", "a.mov", "mov", 1, 0), (5, "d", "b.mov", "mov", 1, 0)]
    d = spark.createDataFrame(rows, "id long, dir_path string, name string, ext string, kind int, status int")
    assert {(r.file_id, r.pair_id) for r in index.pair_live_photos(d).collect()} == {(1, 3), (2, 3), (3, 1)}


def test_roots(spark):
    r = spark.createDataFrame([(1, "D:\\A"), (2, "d:\\a\\b"), (3, "D:\\AB"), (4, "D:\\")], "id long, path string")
    assert {(x.inner_id, x.outer_id) for x in index.root_relations(r).collect()} == {(2, 1), (1, 4), (2, 4), (3, 4)}
    assert [x.id for x in index.covering_roots(r).collect()] == [4]
    assert sorted(x.key for x in index.minimal_scopes(r.where("id < 4")).collect()) == ["D:\\A", "D:\\AB"]


def test_classify(spark):
    rows = [("D:\\x", ".jpg", 32), ("D:\\x", "a.MOV", 0x1000), ("D:\\x", "a", 0), ("D:\\Windows\\y", "b.jpg", 0), ("D:\\x", None, 0)]
    d = spark.createDataFrame([(p, n, 1, 1, a) for p, n, a in rows], "dir_path string, name string, size long, mtime long, attrs int")
    assert {(r.name, r.kind, r.status) for r in index.classify(d).collect()} == {(".jpg", 0, 0), ("a.MOV", 1, 2)}


def test_evict_by_lots(spark):
    d = spark.createDataFrame([(i, 10, i) for i in range(10)], "file_id long, bytes long, last_used long")
    assert sorted(r.file_id for r in index.evict(d, 50, lot=2).collect()) == [6, 7, 8, 9]
    assert index.evict(d, 100, lot=2).count() == 10


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.normalize_path(F.lit("d:/a/b//"))) == "D:\\a\\b"
    assert one(text.normalize_path(F.lit("d:/"))) == "D:\\"
    assert one(text.nocase(F.lit("ÀB"))) == "Àb"
    assert one(text.stem(F.lit(".foo"))) == ".foo"
    assert one(text.clean_component(F.lit("__a__b.. "))) == "a_b"
    assert one(text.clean_component(F.lit("CON"))) == "_CON"
    assert one(text.relative_to(F.lit("D:\\PhotosOld"), F.lit("D:\\Photos"))) is None
    assert one(text.relative_to(F.lit("d:\\photos\\Trip"), F.lit("D:\\Photos"))) == "Trip"
    assert one(text.size_text(F.lit(1023))) == "1023 B"
    assert one(text.duration_text(F.lit(3_661_000))) == "1:01:01"
    assert one(text.utf16_length(F.lit("a😀"))) == 3
    r = one(text.byte_range(F.lit("bytes=-100"), F.lit(1000).cast("long")))
    assert (r.start, r.end, r.ok) == (900, 999, True)
    assert one(text.byte_range(F.lit("bytes=0-1,2-3"), F.lit(10).cast("long"))).ok is False


def test_texts_without_characters_have_a_rate(spark, tmp_path):
    """A rate of 0 came out as none, unlike in the SQL."""
    from shelfspark.plans import registry
    from tests.oracle import connect, differences

    con = connect("/root/testdata/sf0.001")
    con.execute("drop view documents")
    con.execute("create table documents as select 3::bigint as doc_id, '' as text, 'en' as lang, 'src1' as source, 0 as n_chars union all select 4, 'abc', 'fr', 'src1', 3 union all select 5, null, 'fr', 'src1', null")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    assert differences(con, registry.queries()["probe_json"](spark, str(tmp_path)), registry.oracle_sql()["probe_json"]) == (True, {}, {})


def test_orders_store_no_contents(spark, monkeypatch):
    """Whole texts were sorted and stored with every order."""
    from shelfspark.operators import rank, search
    from shelfspark.plans import registry
    from shelfspark.sources import catalog

    seen = []
    real = rank.stored
    monkeypatch.setattr(rank, "stored", lambda d: (seen.append(set(d.columns)), real(d))[1])
    load = lambda n: catalog.load(spark, "/root/testdata/sf0.001", n)
    for sort in ("size_desc", "name", None, "mtime_asc", "date_asc"):
        search.QueryCache().query(load("files"), load("meta"), search.FileFilter(sort=sort))
    assert seen and all(len(s) == 3 and "content" not in s for s in seen)
    assert "sort_orders" in registry.queries()
