"""The journal of moves, its recovery and undo, and the log of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import nocase

from .rank import ranked

BATCH_LIMIT, JOB_LIMIT = 50, 30


def pending_ops(ops: DataFrame) -> DataFrame:
    """Moves begun, neither done nor given up, by id."""
    return ops.where("done_at is null and attempted_at is null").orderBy("id")


def append_ops(ops: DataFrame, new: DataFrame) -> DataFrame:
    """The journal with moves that are about to begin (batch_id, file_id, old_path, new_path), numbered on in their order of file and path."""
    top = ops.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = ranked(new.select("batch_id", "file_id", "old_path", "new_path"), "batch_id", "file_id", "old_path", "new_path").crossJoin(F.broadcast(top))
    rows = rows.select((F.col("top") + F.col("rank")).alias("id"), "batch_id", "file_id", "old_path", "new_path")
    return ops.unionByName(rows, allowMissingColumns=True)


def record(ops: DataFrame, events: DataFrame) -> DataFrame:
    """The journal after ``events`` (id, event, at, reason): DONE and UNDONE set their times, DROPPED removes the move, FAILED keeps why recovery gave up.

    FAILED does nothing to a move that is done; of several events of one kind the last counts.
    """
    e = events.groupBy("id").agg(*(F.max(F.when(F.col("event") == k, F.struct("at", "reason"))).alias(k) for k in ("DONE", "UNDONE", "DROPPED", "FAILED")))
    d = ops.join(e, "id", "left").where("DROPPED is null")
    give_up = F.col("FAILED").isNotNull() & F.col("done_at").isNull() & F.col("DONE").isNull()
    if "recovery_error" not in ops.columns:
        d = d.withColumn("recovery_error", F.lit(None).cast("string"))
    d = d.withColumn("recovery_error", F.when(give_up, F.col("FAILED.reason")).otherwise(F.col("recovery_error"))).withColumn("attempted_at", F.when(give_up, F.col("FAILED.at")).otherwise(F.col("attempted_at")))
    d = d.withColumn("done_at", F.coalesce("DONE.at", "done_at")).withColumn("undone_at", F.coalesce("UNDONE.at", "undone_at"))
    return d.drop("DONE", "UNDONE", "DROPPED", "FAILED")


def verify_context(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """What recovery checks a destination by: (file_id, size, mtime, full_hash), the hash only where it is of the file as indexed."""
    h = hashes.select(F.col("file_id").alias("id"), "full_hash", "hashed_size", "hashed_mtime")
    ok = (F.col("hashed_size") == F.col("size")) & (F.col("hashed_mtime") == F.col("mtime"))
    return files.join(h, "id", "left").select(F.col("id").alias("file_id"), "size", "mtime", F.when(ok, F.col("full_hash")).alias("full_hash"))


def undo_ops(ops: DataFrame, batch_id: int) -> DataFrame:
    """Moves of a batch that can be undone, last first."""
    return ops.where((F.col("batch_id") == batch_id) & F.col("done_at").isNotNull() & F.col("undone_at").isNull()).orderBy(F.desc("id"))


def batches(ops: DataFrame, limit: int = BATCH_LIMIT) -> DataFrame:
    """Moved and undone counts of the latest batches."""
    g = ops.groupBy("batch_id").agg(F.count_if(F.col("done_at").isNotNull() & F.col("undone_at").isNull()).alias("moved"), F.count_if(F.col("undone_at").isNotNull()).alias("undone"))
    return g.orderBy(F.desc("batch_id")).limit(limit)


def batch_jobs(ops: DataFrame, jobs: DataFrame, limit: int = BATCH_LIMIT) -> DataFrame:
    """``batches`` with the state and time of the job (job_id, state, at) that made each, null where there is none."""
    return batches(ops, limit).join(jobs.select(F.col("job_id").alias("batch_id"), "state", "at"), "batch_id", "left")


def recovery(ops: DataFrame, disk: DataFrame, expected: DataFrame) -> DataFrame:
    """What becomes of each pending move: (id, outcome), from what the disk has (path, size, mtime) and what is expected (file_id, size, mtime).

    Where ``expected`` has a full_hash (not null), the disk's full_hash must be equal too.
    """
    src = disk.select(F.col("path").alias("old_path"), F.lit(True).alias("src"))
    hash_of = lambda d: F.col("full_hash") if "full_hash" in d.columns else F.lit(None).cast("string")
    dst = disk.select(F.col("path").alias("new_path"), F.lit(True).alias("dst"), F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"), hash_of(disk).alias("d_hash"))
    e = expected.select("file_id", F.col("size").alias("e_size"), F.col("mtime").alias("e_mtime"), hash_of(expected).alias("e_hash"))
    d = ops.where("done_at is null and attempted_at is null").join(src, "old_path", "left").join(dst, "new_path", "left").join(e, "file_id", "left")
    ok = F.coalesce((F.col("d_size") == F.col("e_size")) & (F.col("d_mtime") == F.col("e_mtime")) & (F.col("e_hash").isNull() | F.coalesce(F.col("e_hash") == F.col("d_hash"), F.lit(False))), F.lit(False))
    s, t = F.col("src").isNotNull(), F.col("dst").isNotNull()
    outcome = F.when(s & t, "BOTH_SOURCE_AND_DESTINATION_EXIST").when(s, "DROPPED").when(~t, "BOTH_SOURCE_AND_DESTINATION_MISSING").when(ok, "DONE").otherwise("DESTINATION_VERIFY_FAILED")
    return d.select("id", outcome.alias("outcome"))


def undo_outcome(ops: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, outcome) of undoing each done move: NOT_PRESENT, TARGET_TAKEN or MOVED."""
    here = disk.select(F.col("path").alias("new_path"), F.lit(True).alias("here"))
    back = disk.select(F.col("path").alias("old_path"), F.lit(True).alias("back"))
    d = ops.where("done_at is not null and undone_at is null").join(here, "new_path", "left").join(back, "old_path", "left")
    return d.select("id", F.when(F.col("here").isNull(), "NOT_PRESENT").when(F.col("back").isNotNull(), "TARGET_TAKEN").otherwise("MOVED").alias("outcome"))


def move_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """The index after finished moves (file_id, new_dir, new_name): a row already at the target goes, the first name is kept."""
    m = done.select(F.col("file_id").alias("id"), "new_dir", "new_name")
    ghost = m.select(F.upper("new_dir").alias("k1"), nocase(F.col("new_name")).alias("k2"), F.col("id").alias("mover"))
    d = files.join(m, "id", "left")
    k1, k2 = F.upper("dir_path"), nocase(F.col("name"))
    d = d.join(ghost, (k1 == F.col("k1")) & (k2 == F.col("k2")) & (F.col("id") != F.col("mover")) & F.col("new_dir").isNull(), "left_anti")
    moved = F.col("new_dir").isNotNull()
    first = F.col("original_name") if "original_name" in files.columns else F.lit(None).cast("string")
    return d.select("id", F.when(moved, F.col("new_dir")).otherwise(F.col("dir_path")).alias("dir_path"), F.when(moved, F.col("new_name")).otherwise(F.col("name")).alias("name"), F.when(moved, F.coalesce(first, F.col("name"))).otherwise(first).alias("original_name"))


def latest_jobs(events: DataFrame) -> DataFrame:
    """Last state of each job: (job_id, event_id, state)."""
    last = events.groupBy("job_id").agg(F.max(F.struct("event_id", "state", "done")).alias("x"))
    return last.select("job_id", "x.event_id", "x.state", "x.done")


def with_event(events: DataFrame, job_id: int, state: str, done: int) -> DataFrame:
    """The log with one more event of a job: its start, progress or end."""
    top = events.agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("event_id"))
    return events.select("event_id", "job_id", "state", "done").unionByName(top.select("event_id", F.lit(job_id).cast("long").alias("job_id"), F.lit(state).alias("state"), F.lit(done).cast("int").alias("done")))


def running(events: DataFrame, over: tuple[str, ...] = ("done", "failed", "cancelled")) -> DataFrame:
    """Jobs whose last state is not one of those that end them."""
    return latest_jobs(events).where(~F.col("state").isin(*over))


def list_jobs(events: DataFrame, limit: int = JOB_LIMIT) -> DataFrame:
    return latest_jobs(events).orderBy(F.desc("job_id")).limit(limit)


def message(moved: int, reasons: DataFrame) -> str:
    """The closing message of a job: how many moved, then reasons by falling count (a handful of rows)."""
    parts = [f"{r['n']} {r['reason']}" for r in reasons.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").collect()]
    return ", ".join([f"moved {moved}", *parts])


def set_library(libraries: DataFrame, volume_id: int, path: str) -> DataFrame:
    """Library folders with that of one volume set; the first ever is primary."""
    spark = libraries.sparkSession
    new = spark.createDataFrame([(volume_id, path)], "volume_id long, path string")
    count = libraries.agg(F.count("*").alias("n"))
    old = libraries.where(F.col("volume_id") == volume_id).select("volume_id", F.col("is_primary").alias("was"))
    new = new.join(old, "volume_id", "left").crossJoin(count).select("volume_id", "path", F.coalesce("was", F.col("n") == 0).alias("is_primary"))
    return libraries.where(F.col("volume_id") != volume_id).select("volume_id", "path", "is_primary").unionByName(new)


def remove_library(libraries: DataFrame, volume_id: int) -> DataFrame:
    """Library folders without that of one volume; if no primary one is left, the least becomes it."""
    left = libraries.where(F.col("volume_id") != volume_id)
    facts = left.agg(F.min("volume_id").alias("least"), F.coalesce(F.bool_or("is_primary"), F.lit(False)).alias("some"))
    d = left.crossJoin(F.broadcast(facts))
    return d.select("volume_id", "path", (F.col("is_primary") | (~F.col("some") & (F.col("volume_id") == F.col("least")))).alias("is_primary"))


def list_libraries(libraries: DataFrame, volumes: DataFrame) -> DataFrame:
    """Library folders with their volume's letter, by path."""
    return libraries.join(volumes.select("volume_id", "letter"), "volume_id").select("volume_id", "letter", "path", "is_primary").orderBy("path")
