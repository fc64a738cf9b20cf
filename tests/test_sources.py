import pytest
from pyspark.errors import AnalysisException

from shelfspark.operators import index
from shelfspark.sources import listing, transfer


def test_scan_reads_a_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.jpg").write_bytes(b"one")
    (tmp_path / "a" / "b" / "y.TS").write_bytes(bytes([0x47]) + bytes(187) + bytes([0x47, 1]))
    (tmp_path / "a" / "z.ts").write_bytes(b"let x = 1")
    d = listing.scan(spark, str(tmp_path), with_content=True)
    assert {(r.name, r.size) for r in d.collect()} == {("x.jpg", 3), ("y.TS", 190), ("z.ts", 9)}
    assert {r.name for r in listing.drop_source_code(d).collect()} == {"x.jpg", "y.TS"}
    assert index.classify(listing.readable_names(listing.drop_source_code(d)).drop("content")).count() == 2
    assert listing.hashed(d).where("quick is null or length(full_hash) <> 64").count() == 0


def test_synthetic_listing(spark):
    d = listing.synthetic(spark, 200)
    assert d.count() == 200 and d.select("content_of").distinct().count() == 180
    assert index.classify(d).count() == 200


def test_export_inspect_load(spark, tmp_path):
    folder = str(tmp_path / "out")
    files = spark.createDataFrame([(1, "x")], "id long, name string")
    roots = spark.createDataFrame([(1, "D:\\b"), (2, "D:\\a")], "id long, path string")
    transfer.export({"files": files, "roots": roots}, folder)
    r = transfer.inspect(spark, folder).first()
    assert (r.version, r.files, r.roots, r.compatible) == (7, 1, ["D:\\a", "D:\\b"], True)
    assert transfer.load(spark, folder, ["files"])["files"].count() == 1
    with pytest.raises(AnalysisException):
        transfer.export({"files": files}, folder)


def test_plan_file(spark, tmp_path):
    d = spark.createDataFrame([(1, "RENAME", "a", None), (2, "SKIP_CLOUD", None, None)], "id long, action string, new_path string, pair_new_path string")
    transfer.write_plan(d, str(tmp_path / "plan"))
    assert [tuple(r) for r in transfer.read_plan(spark, str(tmp_path / "plan")).collect()] == [(1, "RENAME", "a", None)]


def test_settings(spark):
    kv = spark.createDataFrame([("scan_gen", "4")], "key string, value string")
    kv = transfer.with_setting(kv, "excluded_paths", ["D:\\a", 'D:\\"q"'])
    assert transfer.setting(kv, "excluded_paths", "array<string>").first().value == ["D:\\a", 'D:\\"q"']
    assert transfer.next_generation(kv).first().gen == 5
    assert transfer.next_generation(kv.limit(0)).first().gen == 1
