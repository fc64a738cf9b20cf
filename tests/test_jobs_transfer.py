import threading
import time

from pyspark.sql import functions as F

from shelfspark.operators import organize, places, search
from shelfspark.operators.search import FileFilter
from shelfspark.sources import listing, transfer
from shelfspark.streaming import jobs


def test_one_scan_a_root_and_pausing(spark):
    j = jobs.Jobs(spark)
    a = j.register("scan", "D:")
    assert j.register("scan", "D:") is None and j.register("scan", "E:") is not None
    assert not j.pause(a)  # scans can't be paused
    j.finish(a)
    b, h = j.register("scan", "D:"), j.register("hash")
    assert b is not None and j.go_on(b) and j.pause(h)
    seen = []
    waiting = threading.Thread(target=lambda: seen.append(j.go_on(h)))
    waiting.start()
    time.sleep(0.2)
    assert not seen
    j.pause(h, False)
    waiting.join(10)
    assert seen == [True]
    assert j.cancel(h) and not j.go_on(h) and not j.cancel(999)
    assert j.run(b, lambda: spark.range(3).count()) == 3 and not j.go_on(b)


def test_throttle():
    now = [0.0]
    t = jobs.Throttle(200, lambda: now[0])
    got = []
    for at in (0.0, 0.1, 0.21, 0.3, 0.42):
        now[0] = at
        got.append(t.ready())
    assert got == [True, False, True, False, True]


def test_regroup_while_hashes_come(spark, tmp_path):
    spark.createDataFrame([(1,)], "file_id long").write.parquet(str(tmp_path / "in"))
    done = []
    q = jobs.regroup(jobs.source(spark, str(tmp_path / "in"), "file_id long"), lambda: done.append(1), str(tmp_path / "cp"), "200 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert done == [1]


def test_import_takes_the_place_of_the_live_index(spark, tmp_path):
    put = lambda name, n: spark.range(n).coalesce(1).write.parquet(str(tmp_path / name))
    count = lambda name: spark.read.parquet(str(tmp_path / name)).count()
    assert not transfer.apply_import(spark, f"file://{tmp_path}")
    put("index", 1), put("thumbs", 1), put("index.incoming", 2)
    assert transfer.apply_import(spark, f"file://{tmp_path}")
    assert count("index") == 2 and count("index.bak") == 1 and not (tmp_path / "thumbs").exists() and not (tmp_path / "index.incoming").exists()
    put("index.incoming", 3), put("thumbs.incoming", 4)
    assert transfer.apply_import(spark, f"file://{tmp_path}")
    assert count("index") == 3 and count("index.bak") == 2 and count("thumbs") == 4


def test_manifest_of_copies(spark):
    d = listing.synthetic(spark, 40)
    got = listing.manifest(d).collect()
    assert len(got) == 4 and all(len(r.paths) == 2 for r in got) and [r.set for r in got] == [1, 2, 3, 4]


def test_cloud_streams_go(spark):
    sync = bytes([0x47]) + bytes(187) + bytes([0x47])
    d = spark.createDataFrame([("a.ts", 32, bytearray(sync)), ("b.ts", 0x1000, bytearray(sync)), ("c.ts", 32, None), ("d.jpg", 0x1000, None)], "name string, attrs int, content binary")
    assert {r.name for r in listing.drop_source_code(d).collect()} == {"a.ts", "d.jpg"}


def test_frozen_plan_is_the_newest_only(spark, tmp_path):
    d = spark.createDataFrame([(1, "RENAME")], "id long, action string")
    folder = f"file://{tmp_path}"
    organize.freeze(d, folder, 1)
    organize.freeze(d.withColumn("id", F.lit(2).cast("long")), folder, 2)
    assert organize.frozen(spark, folder, 2).first().id == 2
    try:
        organize.frozen(spark, folder, 1)
    except ValueError as e:
        assert str(e) == "ERR_PREVIEW_STALE|1"
    else:
        raise AssertionError("an old preview was taken")


def test_windows_of_old_queries_are_refused(spark):
    files = spark.createDataFrame([(i, "D:", f"n{i}.jpg", "jpg", 0, i, i, 0, None) for i in range(20)], "id long, dir_path string, name string, ext string, kind int, size long, mtime long, status int, live_pair_id long")
    meta = spark.createDataFrame([], "file_id long, width long, height long, duration_ms long, taken_at long")
    cache = search.QueryCache()
    first, _ = cache.query(files, meta, FileFilter())
    assert [r.id for r in cache.window(first, 2, 3).collect()] == [17, 16, 15]
    assert cache.window(first, 50, 3).count() == 0
    cache.query(files, meta, FileFilter(sort="name"))
    cache.query(files, meta, FileFilter(sort="size_asc"))
    try:
        cache.window(first, 0, 1)
    except LookupError as e:
        assert "ERR_QUERY_EXPIRED" in str(e)
    else:
        raise AssertionError("an old query was served")


def test_filter_form():
    assert search.bytes_of_mb("1.5") == 1_572_864 and search.bytes_of_mb("0") == 0 and search.bytes_of_mb("x") is None and search.bytes_of_mb(" 2 MB") == 2_097_152
    assert search.MEGAPIXELS[8] == 8_000_000 and search.DURATIONS["medium"] == (60_000, 600_000)


def test_suffix_is_not_the_whole_name(spark):
    got = spark.createDataFrame([("Kansas City",), (" City",), ("X Province",)], "n string").select(places._bare_name(F.col("n")).alias("n"))
    assert [r.n for r in got.collect()] == ["Kansas", " City", "X"]
