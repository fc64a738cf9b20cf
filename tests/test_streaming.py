from shelfspark.streaming import jobs


def test_latest_state_of_a_stream(spark, tmp_path):
    cols = "event_id long, job_id long, state string, done int"
    spark.createDataFrame([(1, 1, "running", 1), (2, 2, "running", 1), (3, 1, "done", 9)], cols).write.parquet(str(tmp_path / "in"))
    q = jobs.job_states(jobs.source(spark, str(tmp_path / "in"), cols)).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.job_id, r.state) for r in spark.table("states").collect()} == {(1, "done"), (2, "running")}


def test_progress_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{i}", "running", 1.0) for i in range(3)]
    d = spark.createDataFrame(rows, "ts string, state string, value double").selectExpr("cast(ts as timestamp) ts", "state", "value")
    d.write.parquet(str(tmp_path / "in"))
    q = jobs.progress(jobs.source(spark, str(tmp_path / "in"), "ts timestamp, state string, value double")).writeStream.outputMode("update").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.value) for r in spark.table("progress").collect()] == [(3, 3.0)]


def test_scans_merge_by_generation(spark, tmp_path):
    files = "id long, dir_path string, name string, size long, mtime long, status int, seen_gen int, live_pair_id long"
    listing = "dir_path string, name string, size long, mtime long, status int"
    index = spark.createDataFrame([(1, "D:\\A", "x.jpg", 1, 1, 0, 0, None), (2, "D:\\A", "gone.jpg", 1, 1, 0, 0, None)], files)
    spark.createDataFrame([("D:\\A", "X.jpg", 2, 2, 0)], listing).write.parquet(str(tmp_path / "in"))
    kept = {}
    q = jobs.merge_scans(jobs.source(spark, str(tmp_path / "in"), listing), lambda: index, lambda d, g: kept.setdefault(g, d.collect()), "D:\\A", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.status) for r in kept[1]} == {(1, 0), (2, 1)}
    assert {r.dir_path for r in kept[1]} == {"D:\\A"}  # folders keep their case
