"""Index maintenance: roots, scan merge, reconciliation, pairing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.media import is_cloud, kind_of
from shelfspark.functions.text import extension, in_scope, nocase, normalize_path, stem
from shelfspark.session import stored

from .rank import ranked

EXCLUDED = ("$recycle.bin", "system volume information", "$extend", "windows", "program files", "program files (x86)", "programdata", ".staging", ".quarantine", "node_modules", ".git", ".svn", ".hg", "__pycache__")


def not_excluded(folder: Column, user: list[str] | None = None) -> Column:
    """False below a folder that is never scanned or that the user left out."""
    ok = ~F.exists(F.split(folder, r"\\"), lambda s: nocase(s).isin(*EXCLUDED))
    for u in user or []:
        ok = ok & ~F.concat(F.upper(folder), F.lit("\\")).startswith(u.upper().rstrip("\\") + "\\")
    return ok


def classify(listing: DataFrame, user: list[str] | None = None) -> DataFrame:
    """Media rows of a raw listing (dir_path, name, size, mtime, attrs) with ext, kind and status."""
    d = listing.where(not_excluded(F.col("dir_path"), user)).withColumn("ext", extension(F.col("name")))
    return d.withColumn("kind", kind_of(F.col("ext"))).where("kind is not null").withColumn("status", F.when(is_cloud(F.col("attrs")), 2).otherwise(0))


def scan_summary(scanned: DataFrame, errors: int = 0) -> DataFrame:
    return scanned.agg(F.count("*").alias("indexed"), F.count_if(F.col("status") == 2).alias("cloud"), F.count_if(F.col("kind") == 1).alias("videos")).withColumn("errors", F.lit(errors))


def scan_report(raw: DataFrame, scanned: DataFrame, after: DataFrame) -> DataFrame:
    """One row on a whole scan: indexed, cloud, videos, missing and lossy (names that are no text), from the listing, its media rows and the index after ``reconcile``."""
    lossy = raw.agg(F.count_if(F.col("name").contains("\ufffd")).alias("lossy"))
    missing = after.agg(F.count_if("newly_missing").alias("missing"))
    return scan_summary(scanned).drop("errors").crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(lossy))


def _ancestors(key: Column) -> Column:
    """All folders above an upper-case path without a trailing separator, itself included."""
    parts = F.split(key, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "\\"))


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.upper(path), r"\\+$", "")


def root_relations(roots: DataFrame) -> DataFrame:
    """Of every two roots where one lies under the other: (inner_id, outer_id); a root meets its own ancestors by an equi-join."""
    a = roots.select(F.col("id").alias("inner_id"), _bare(F.col("path")).alias("own"))
    a = a.select("inner_id", "own", F.explode(_ancestors(F.col("own"))).alias("k")).where("k <> own")
    b = roots.select(F.col("id").alias("outer_id"), _bare(F.col("path")).alias("k"))
    return a.join(b, "k").where("inner_id <> outer_id").select("inner_id", "outer_id")


def covering_roots(roots: DataFrame) -> DataFrame:
    """Roots that no other one covers."""
    return roots.join(root_relations(roots).select(F.col("inner_id").alias("id")).distinct(), "id", "left_anti")


def root_counts(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Present files under each root (0 for none).

    Files are counted by folder first; a folder then meets the roots among its own ancestors by an equi-join, so that
    neither side is sent to all.
    """
    folders = files.where(F.col("status").isin(0, 2)).groupBy(F.upper("dir_path").alias("key")).agg(F.count("*").alias("n"))
    keys = roots.select("id", _bare(F.col("path")).alias("root_key"))
    n = folders.select(F.explode(_ancestors(_bare(F.col("key")))).alias("root_key"), "n").groupBy("root_key").agg(F.sum("n").alias("n"))
    return roots.join(keys, "id").join(n, "root_key", "left").select("id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("file_count"))


def add_root(roots: DataFrame, path: str) -> tuple[DataFrame, str]:
    """(the roots after adding one, its path or an error).

    An equal one (case ignored) stays; under another it is refused (ERR_ROOT_COVERED|that one); those it covers go, their
    files stay. A path without a drive, or relative to one, is refused.
    """
    spark = roots.sparkSession
    new = spark.range(1).select(normalize_path(F.lit(path)).alias("path"))
    p = new.first()["path"]
    if not re.match("^[A-Za-z]:", p):
        return roots, f"ERR_ROOT_NO_DRIVE|{p}"
    if len(p) < 3 or p[2] != "\\":
        return roots, f"ERR_ROOT_DRIVE_RELATIVE|{p}"
    slashed = lambda c: F.concat(F.regexp_replace(F.upper(c), r"\\+$", ""), F.lit("\\"))
    mine = slashed(F.lit(p))
    d = roots.withColumn("k", slashed(F.col("path")))
    over = d.where(mine.startswith(F.col("k"))).orderBy(F.length("k").desc(), "id").select("path", (F.col("k") == mine).alias("same")).head(1)
    if over:
        return roots, over[0]["path"] if over[0]["same"] else f"ERR_ROOT_COVERED|{over[0]['path']}"
    left = d.where(~F.startswith("k", mine)).drop("k")
    top = roots.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = top.select(F.col("id").cast(roots.schema["id"].dataType), F.lit(p).alias("path"))
    return left.unionByName(row, allowMissingColumns=True), p


def list_roots(roots: DataFrame) -> DataFrame:
    return roots.orderBy("path")


def get_root(roots: DataFrame, root_id: int) -> DataFrame:
    return roots.where(F.col("id") == root_id)


def remove_root(roots: DataFrame, files: DataFrame, root_id: int) -> tuple[DataFrame, DataFrame]:
    """(roots, files) without a root and the files under it."""
    gone = roots.where(F.col("id") == root_id).select("path")
    under = files.select("dir_path").distinct().join(F.broadcast(gone), in_scope(F.upper("dir_path"), F.col("path"))).select("dir_path")
    return roots.where(F.col("id") != root_id), files.join(under, "dir_path", "left_anti")


_KEPT = ("ext", "kind", "attrs")


def merge_scan(index: DataFrame, scan: DataFrame, gen: int) -> DataFrame:
    """The index after a scan: rows of one folder and name (ASCII case ignored) take the scan's facts and keep id, folder, first name and pair.

    New names get the next ids, in the order of folder and name. ``stale`` marks rows whose size or time changed: what was derived from them is void.
    """
    key = lambda d: d.withColumn("k1", F.upper("dir_path")).withColumn("k2", nocase(F.col("name")))
    has = lambda d, c, kind: F.col(c) if c in d.columns else F.lit(None).cast(kind)
    facts = ["name", "ext", "kind", "size", "mtime", "attrs", "status"]
    kinds = {"name": "string", "ext": "string"}
    typed = lambda d, c: has(d, c, index.schema[c].dataType if c in index.columns else kinds.get(c, "long"))
    old = key(index).select("k1", "k2", "id", F.col("dir_path").alias("o_dir"), "live_pair_id", has(index, "original_name", "string").alias("original_name"), F.col("seen_gen").alias("o_gen"), *(typed(index, c).alias(f"o_{c}") for c in facts))
    s = key(scan)
    if "ext" not in scan.columns:
        s = s.withColumn("ext", extension(F.col("name")))
    if "kind" not in scan.columns:
        s = s.withColumn("kind", kind_of(F.col("ext")))
    new = s.select("k1", "k2", F.col("dir_path").alias("n_dir"), *(typed(s, c).alias(f"n_{c}") for c in facts), F.lit(True).alias("seen")).dropDuplicates(["k1", "k2"])
    d = old.join(new, ["k1", "k2"], "full_outer")
    seen, fresh = F.coalesce("seen", F.lit(False)), F.col("id").isNull()
    pick = lambda c: F.when(seen, F.coalesce(f"n_{c}", f"o_{c}") if c in _KEPT else F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    d = d.select(
        "id", F.coalesce("o_dir", "n_dir").alias("dir_path"), *map(pick, facts), F.when(seen, F.lit(gen)).otherwise(F.col("o_gen")).alias("seen_gen"), "live_pair_id", "original_name",
        (seen & ~fresh & (~F.col("o_size").eqNullSafe(F.col("n_size")) | ~F.col("o_mtime").eqNullSafe(F.col("n_mtime")))).alias("stale"), fresh.alias("fresh"), "k1", "k2",
    )
    d = stored(d)
    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = ranked(d.where("fresh"), "k1", "k2").crossJoin(F.broadcast(top)).withColumn("id", (F.col("top") + F.col("rank")).cast(index.schema["id"].dataType)).drop("top", "rank")
    return d.where("not fresh").unionByName(numbered).drop("fresh", "k1", "k2")


def stale_rows(derived: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows (file_id, ...) that a merge leaves valid: none of a file that changed or is gone."""
    return derived.join(merged.where("not stale").select(F.col("id").alias("file_id")), "file_id", "left_semi")


#: Beyond so many unreadable folders nothing is called missing.
MOST_SCOPES = 300


def reconcile_guarded(files: DataFrame, root: str, gen: int, unreadable: list[str], cancelled: bool = False, write_errors: int = 0, unknown_errors: int = 0) -> DataFrame:
    """``reconcile`` unless the scan can't be trusted: cancelled, errors of unknown place, or too many unreadable folders. Failed writes fail it."""
    if write_errors:
        raise RuntimeError(f"ERR_SCAN_WRITE_FAILED|{write_errors} batch failed")
    if cancelled or unknown_errors or len(unreadable) > MOST_SCOPES:
        return files.withColumn("newly_missing", F.lit(False))
    return reconcile(files, root, gen, unreadable)


def reconcile(files: DataFrame, root: str, gen: int, unreadable: list[str] | None = None) -> DataFrame:
    """Files of the root that the scan ``gen`` has not seen become missing, but for those under folders it couldn't read."""
    gone = in_scope(F.upper("dir_path"), root) & (F.col("seen_gen") < gen) & F.col("status").isin(0, 2)
    for u in unreadable or []:
        gone = gone & ~in_scope(F.upper("dir_path"), u)
    return files.withColumn("newly_missing", gone).withColumn("status", F.when(gone, 1).otherwise(F.col("status")))


def minimal_scopes(scopes: DataFrame) -> DataFrame:
    """Paths without those that lie under another (of equal ones one stays)."""
    d = scopes.select(F.upper("path").alias("key")).distinct().withColumn("own", _bare(F.col("key")))
    above = d.select("key", "own", F.explode(_ancestors(F.col("own"))).alias("k")).where("k <> own")
    under = above.join(d.select(F.col("own").alias("k")).distinct(), "k", "left_semi").select("key")
    return d.select("key").join(under, "key", "left_anti")


def pair_live_photos(files: DataFrame) -> DataFrame:
    """Image and .mov of one folder and stem: (file_id, pair_id) both ways; of several the least id.

    Two images may share a video, which points back to the one of least id.
    """
    d = files.where(F.col("status").isin(0, 2)).select("id", "ext", "kind", F.upper("dir_path").alias("k1"), nocase(stem(F.col("name"))).alias("k2"))
    videos = d.where("kind = 1 and ext = 'mov'").groupBy("k1", "k2").agg(F.min("id").alias("pair_id"))
    forward = d.where("kind = 0").where(F.col("ext").isin("heic", "heif", "jpg", "jpeg")).join(videos, ["k1", "k2"]).select(F.col("id").alias("file_id"), "pair_id")
    back = forward.groupBy(F.col("pair_id").alias("file_id")).agg(F.min("file_id").alias("pair_id"))
    return forward.unionByName(back)


def pending_meta(files: DataFrame, meta: DataFrame, kind_max: int, after: int, limit: int) -> DataFrame:
    d = files.where((F.col("kind") <= kind_max) & (F.col("status") == 0) & (F.col("id") > after))
    return d.join(meta.select(F.col("file_id").alias("id")), "id", "left_anti").select("id").orderBy("id").limit(limit)


def guarded(files: DataFrame, results: DataFrame) -> DataFrame:
    """Results (file_id, src_size, src_mtime, ...) whose file is unchanged since they were made."""
    now = files.select(F.col("id").alias("file_id"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))
    return results.join(now, ["file_id", "src_size", "src_mtime"], "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def evict(thumbs: DataFrame, cap: int, lot: int = 256) -> DataFrame:
    """What a cache keeps: beyond ``cap`` bytes, lots of the least recently used go until at most 9/10 of it are left.

    Rows are numbered range by range, and only lots (one row for each 256 files) are summed in one order.
    """
    total = thumbs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    d = ranked(thumbs.select("file_id", "bytes", "last_used"), "last_used", "file_id", name="rn").withColumn("lot", F.floor((F.col("rn") - 1) / lot).cast("long"))
    lots = d.groupBy("lot").agg(F.sum("bytes").alias("freed"))
    lots = lots.withColumn("before", F.sum("freed").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("freed")).crossJoin(total)
    drop = lots.where((F.col("total") > cap) & (F.col("total") - F.col("before") > F.lit(cap // 10 * 9))).select("lot")
    return d.join(drop, "lot", "left_anti").select("file_id", "bytes", "last_used")


def zone_changed(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata after the library's zone has changed: that of videos is void, their times being derived with the zone."""
    return meta.join(files.where("kind = 1").select(F.col("id").alias("file_id")), "file_id", "left_anti")


TOUCH_SECONDS = 3600


def thumb_get(thumbs: DataFrame, wanted: DataFrame, now_s: int) -> tuple[DataFrame, DataFrame]:
    """(hits, thumbs after them): a picture counts only if made of the file's present time (wanted: file_id, s, src_mtime).

    ``last_used`` of a hit moves on if it is more than an hour old.
    """
    key = ["file_id", "s", "src_mtime"]
    w = wanted.select(*key).distinct()
    hits = thumbs.join(w, key, "left_semi")
    d = thumbs.join(w.withColumn("hit", F.lit(True)), key, "left")
    touched = d.withColumn("last_used", F.when(F.col("hit") & (F.lit(now_s) - F.col("last_used") > TOUCH_SECONDS), F.lit(now_s)).otherwise(F.col("last_used"))).drop("hit")
    return hits, touched.select(*thumbs.columns)


def thumb_put(thumbs: DataFrame, new: DataFrame) -> DataFrame:
    """Thumbs with ``new`` ones, which replace those of the same file and size."""
    return thumbs.join(new.select("file_id", "s").distinct(), ["file_id", "s"], "left_anti").unionByName(new.select(*thumbs.columns))
