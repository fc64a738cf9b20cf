"""Event-driven views: the latest state of jobs, progress by window, and listings merged generation by generation."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.index import merge_scan, reconcile


def job_states(events: DataFrame) -> DataFrame:
    """Last state of each job of a stream of (event_id, job_id, state, done); run it in update mode. One row of state a job."""
    return events.groupBy("job_id").agg(F.max(F.struct("event_id", "state", "done")).alias("x")).select("job_id", "x.event_id", "x.state", "x.done")


def progress(events: DataFrame, every: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """Events and value by window and state; windows close, and their state goes, when the watermark passes them."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w, "state").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "state", "n", "value")


def source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def regroup(results: DataFrame, group: Callable[[], None], checkpoint: str, every: str = "8 seconds") -> StreamingQuery:
    """Group anew while hashes arrive: at once when the first come, then at most once in ``every``, and not while none come."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            group()

    return results.writeStream.foreachBatch(step).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


class Throttle:
    """True at the first call and then at most once an interval."""

    def __init__(self, interval_ms: int, clock: Callable[[], float] = time.monotonic):
        self.interval, self.clock, self.last = interval_ms / 1000, clock, None

    def ready(self) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            return False
        self.last = now
        return True


PAUSABLE = ("hash", "meta", "org_hash", "thumb_warm", "phash")


class Jobs:
    """Jobs of this driver: one scan a root, cancelling what Spark runs for a job, and pausing between batches.

    Work is done under ``run``, which tags the Spark jobs of its thread; a job's long work comes in batches, and asks ``go_on`` before each.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.last, self.open = spark, threading.Condition(), 0, {}

    def register(self, kind: str, root: str | None = None) -> int | None:
        """The number of a new job; None if a scan of this root is under way."""
        with self.lock:
            if kind == "scan" and any(j["kind"] == "scan" and j["root"] == root for j in self.open.values()):
                return None
            self.last += 1
            self.open[self.last] = {"kind": kind, "root": root, "cancelled": False, "paused": False}
            return self.last

    def finish(self, job: int) -> None:
        with self.lock:
            self.open.pop(job, None)

    def cancel(self, job: int) -> bool:
        with self.lock:
            if job not in self.open:
                return False
            self.open[job]["cancelled"] = True
            self.lock.notify_all()
        self.spark.sparkContext.cancelJobsWithTag(f"job-{job}")
        return True

    def pause(self, job: int, on: bool = True) -> bool:
        """Pause or go on; only some kinds can be paused."""
        with self.lock:
            if job not in self.open or self.open[job]["kind"] not in PAUSABLE:
                return False
            self.open[job]["paused"] = on
            self.lock.notify_all()
            return True

    def go_on(self, job: int) -> bool:
        """Wait while the job is paused; False once it is cancelled or over."""
        with self.lock:
            while job in self.open and self.open[job]["paused"] and not self.open[job]["cancelled"]:
                self.lock.wait()
            return job in self.open and not self.open[job]["cancelled"]

    def run(self, job: int, work: Callable[[], object]) -> object:
        tag = f"job-{job}"
        self.spark.sparkContext.addJobTag(tag)
        try:
            return work()
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            self.finish(job)


def merge_scans(listings: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], root: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of a listing stream into the index as one generation; what the generation lacks becomes missing.

    ``load`` gives the index, ``save`` keeps a generation (idempotently: a batch may come twice after a failure).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        gen = batch_id + 1
        save(reconcile(merge_scan(load(), batch, gen), root, gen), gen)

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
