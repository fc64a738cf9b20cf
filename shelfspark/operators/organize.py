"""Plans that move files into a library: candidates, items, name ladder, previews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.dates import FROM_MTIME, resolve_taken
from shelfspark.functions.media import camera
from shelfspark.functions.templates import Template, join_target, render_dir, render_file
from shelfspark.functions.text import in_scope, join_path, last_segment, nocase, relative_to, same_volume, stem, utf16_length
from shelfspark.session import stored

MAX_UTF16, LAST_SUFFIX, SAMPLE = 259, 99, 500
DULL = ("RENAME", "COPY_VERIFY", "SKIP_ORGANIZED")


def _movable(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin(0, 2)).where("kind = 0 or live_pair_id is null")


def candidates(files: DataFrame, meta: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files to organize, with metadata, valid hash and the paired video where the link is mutual; paired videos are hidden.

    The pair carries path, ext, status, size, mtime and its own valid hash.
    """
    f = _movable(files)
    if "original_name" not in files.columns:
        f = f.withColumn("original_name", F.lit(None).cast("string"))
    h = hashes.select(F.col("file_id").alias("id"), "full_hash", "hashed_size", "hashed_mtime")
    m = meta.select(F.col("file_id").alias("id"), "taken_at", "date_source", "make", "model")
    valid = (F.col("hashed_size") == F.col("size")) & (F.col("hashed_mtime") == F.col("mtime"))
    one = F.struct(F.col("id").alias("file_id"), join_path(F.col("dir_path"), F.col("name")).alias("path"), F.lower("ext").alias("ext"), "status", "size", "mtime", F.when(valid, F.col("full_hash")).alias("hash_hex"))
    p = files.where("kind = 1 and live_pair_id is not null").join(h, "id", "left").select(F.col("id").alias("p_id"), F.col("live_pair_id").alias("p_back"), one.alias("pair"))
    d = f.join(m, "id", "left").join(h, "id", "left").join(p, (F.col("live_pair_id") == F.col("p_id")) & (F.col("p_back") == F.col("id")) & (F.col("kind") == 0), "left")
    return d.withColumn("hash_hex", F.when(valid, F.col("full_hash"))).drop("p_id", "p_back", "full_hash", "hashed_size", "hashed_mtime")


def count_candidates(files: DataFrame) -> DataFrame:
    """How many files there are to organize."""
    return _movable(files).agg(F.count("*").alias("n"))


def valid_hash_at_path(files: DataFrame, hashes: DataFrame, paths: DataFrame) -> DataFrame:
    """For each path (folder, name) the valid full hash of the present file there."""
    ok = (F.col("hashed_size") == F.col("size")) & (F.col("hashed_mtime") == F.col("mtime")) & F.col("full_hash").isNotNull()
    h = hashes.select(F.col("file_id").alias("id"), "full_hash", "hashed_size", "hashed_mtime")
    there = files.where("status = 0").join(h, "id").where(ok).select(F.upper("dir_path").alias("k1"), nocase(F.col("name")).alias("k2"), "full_hash")
    return paths.withColumn("k1", F.upper("folder")).withColumn("k2", nocase(F.col("name"))).join(there, ["k1", "k2"]).select("folder", "name", "full_hash")


def build_items(cands: DataFrame, roots: list[str], library: str, now_ms: int, zone: str | None = None, fallback_minutes: int = 0) -> DataFrame:
    """Planner inputs: path, taken_ms, taken_source, rel_dir, folder, orig_stem.

    The relative folder is taken from the library, else from the first watched root that holds the file; ``folder`` is
    the last segment, none at a root itself.
    """
    bases = [library, *roots]
    rel = F.coalesce(*(relative_to(F.col("dir_path"), F.lit(b)) for b in bases))
    leaf = F.when(rel.isNull(), F.when(F.length("dir_path") > 3, last_segment(F.col("dir_path")))).when(rel != "", last_segment(rel))
    t = resolve_taken(F.col("taken_at"), F.col("date_source"), F.col("name"), F.col("mtime"), F.lit(now_ms), zone, fallback_minutes)
    d = cands.withColumn("t", t)
    return d.select("id", join_path(F.col("dir_path"), F.col("name")).alias("path"), F.lower("ext").alias("ext"), "status", F.col("t.ms").alias("taken_ms"), F.col("t.source").alias("taken_source"), "hash_hex", "size", "mtime", camera(F.col("make"), F.col("model")).alias("camera"), F.nullif(rel, F.lit("")).alias("rel_dir"), leaf.alias("folder"), stem(F.coalesce("original_name", "name")).alias("orig_stem"), "pair")


def first_actions(items: DataFrame, library: str, file_template: Template, include_uncertain: bool = False) -> Column:
    """What the checks before the name ladder decide; null for items that go on to it."""
    near = same_volume(F.col("path"), F.lit(library))
    pair_far = F.col("pair").isNotNull() & ~same_volume(F.col("pair.path"), F.lit(library)) & F.col("pair.hash_hex").isNull()
    needs = (F.col("hash_hex").isNull() & (F.lit(file_template.has_hash) | ~near)) | pair_far
    return (
        F.when(F.col("status") == 2, "SKIP_CLOUD")
        .when(F.col("status") != 0, "SKIP_MISSING")
        .when((F.col("taken_source") == FROM_MTIME) & F.lit(not include_uncertain), "SKIP_UNCERTAIN")
        .when(F.col("pair.status") != 0, "SKIP_PAIR_BLOCKED")
        .when(needs, "NEEDS_HASH")
    )


def _units(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def _names(it) -> Iterator[str]:
    """The ladder of names: the template's, with longer hashes, then numbered."""
    seen = list(dict.fromkeys(it.names))
    yield from seen
    for i in range(2, LAST_SUFFIX + 1):
        yield f"{seen[-1]}_{i}"


def _place(pdf: pd.DataFrame, occupied: pd.DataFrame | None = None) -> pd.DataFrame:
    """Settle the files of whole target folders in the order of their ids; claims are by full path."""
    claimed: dict[str, str | None] = {}
    there = {} if occupied is None else dict(zip(occupied.key, occupied.held, strict=True))
    out = []
    for it in pdf.sort_values("id").itertuples():
        base, mine = it.target_dir.rstrip("\\"), it.hash_hex or ""
        paired = isinstance(it.pair_path, str)
        action, new, pair_new, long_ = None, None, None, False
        for name in _names(it):
            target = f"{base}\\{name}.{it.ext}"
            other = f"{base}\\{name}.{it.pair_ext}" if paired else None
            loose = paired and it.pair_path.upper() != other.upper()
            key = target.upper()
            if it.path.upper() == key:
                claimed[key] = it.hash_hex
                action = "SKIP_ORGANIZED"
                if loose:
                    claimed[other.upper()] = None
                    pair_new = other
                break
            if _units(target) > MAX_UTF16 or (paired and _units(other) > MAX_UTF16):
                long_ = True
                continue
            if key in claimed or key in there:
                held = claimed[key] if key in claimed else there[key]
                if mine and held == mine:
                    action, new = "SKIP_DUPLICATE", target
                    break
                continue
            if loose and (other.upper() in claimed or other.upper() in there):
                continue
            action, new = ("RENAME" if it.near else "COPY_VERIFY"), target
            claimed[key] = mine
            if paired:
                claimed[other.upper()] = None
                pair_new = other
            break
        out.append((it.id, action or ("SKIP_PATH_TOO_LONG" if long_ else "SKIP_COLLISION"), new, pair_new))
    return pd.DataFrame(out, columns=["id", "action", "new_path", "pair_new_path"])


def _root(name: Column) -> Column:
    """A name in upper case without the numbers that the ladder adds; two names can be equal only if their roots are."""
    return F.regexp_replace(F.upper(name), r"(_[0-9]{1,2})+$", "")


def plan(items: DataFrame, library: str, dir_template: Template, file_template: Template, occupied: DataFrame | None = None, include_uncertain: bool = False) -> DataFrame:
    """The plan of every item: (id, action, new_path, pair_new_path).

    The first free name of the ladder counts, a duplicate where the same content holds it, else numbered up to 99, in the order
    of ids. ``occupied`` (path, hash_hex) is what is on disk. A null id, path or date gives no name: such rows come back as
    SKIP_COLLISION.

    Names never leave their target folder, and within it only names of one root can meet. So items are settled in groups of
    folder and root: one that is alone takes its first name at once, only groups of several, or with a file on disk,
    climb the ladder one by one. A folder in which names of different roots can meet after all is one group.
    """
    # written once: dates are resolved once, not in every expression and branch that uses them
    items = stored(items)
    d = items.withColumn("action", first_actions(items, library, file_template, include_uncertain))
    none = F.lit(None).cast("string")
    done = d.where("action is not null").select("id", "action", none.alias("new_path"), none.alias("pair_new_path"))
    args = (F.col("taken_ms"), F.col("hash_hex"), F.col("camera"))
    names = [render_file(file_template, *args, F.col("orig_stem"), n) for n in ((None, 8, 16) if file_template.has_hash else (None,))]
    segs = render_dir(dir_template, *args, F.col("rel_dir"), F.col("folder"), F.col("orig_stem"))
    folder = F.concat_ws("\\", F.lit(library.rstrip("\\")), F.nullif(F.array_join(segs, "\\"), F.lit("")))
    todo = d.where("action is null").select("id", "path", "ext", "hash_hex", F.array(*names).alias("names"), folder.alias("target_dir"), same_volume(F.col("path"), F.lit(library)).alias("near"), F.col("pair.path").alias("pair_path"), F.col("pair.ext").alias("pair_ext"))
    bad = F.col("id").isNull() | F.col("path").isNull() | F.exists("names", lambda x: x.isNull())
    todo = stored(todo.withColumn("bad", bad).withColumn("fk", F.regexp_replace(F.upper("target_dir"), r"\\+$", "")).withColumn("root", _root(F.col("names")[0])))
    lost = todo.where("bad").select("id", F.lit("SKIP_COLLISION").alias("action"), none.alias("new_path"), none.alias("pair_new_path"))
    rows = todo.where("not bad").drop("bad")
    # folders where a later name of one root is a name of another
    met = rows.select("fk", "root", F.explode(F.array_distinct(F.transform("names", _root))).alias("other")).groupBy("fk", "other").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    tangled = met.where("a <> b").select("fk").distinct().withColumn("whole", F.lit(True))
    rows = rows.join(tangled, "fk", "left").withColumn("root", F.when(F.col("whole"), F.lit("")).otherwise(F.col("root"))).drop("whole")
    size = rows.groupBy("fk", "root").agg(F.count("*").alias("n"))
    if occupied is None:
        there = None
    else:
        key = F.upper("path")
        there = occupied.where("path is not null").select(key.alias("key"), F.coalesce("hash_hex", F.lit("")).alias("held"), F.regexp_replace(key, r"\\[^\\]*$", "").alias("fk"), _root(stem(last_segment(F.col("path")))).alias("root"))
        there = there.join(tangled, "fk", "left").withColumn("root", F.when(F.col("whole"), F.lit("")).otherwise(F.col("root"))).drop("whole")
        size = size.unionByName(there.groupBy("fk", "root").agg(F.count("*").alias("n"))).groupBy("fk", "root").agg(F.sum("n").alias("n"))
    base = F.regexp_replace("target_dir", r"\\+$", "")
    target = F.concat(base, F.lit("\\"), F.col("names")[0], F.lit("."), F.col("ext"))
    other = F.concat(base, F.lit("\\"), F.col("names")[0], F.lit("."), F.col("pair_ext"))
    rows = stored(rows.join(size, ["fk", "root"]).withColumn("target", target).withColumn("other", F.when(F.col("pair_path").isNotNull(), other)))
    short = (utf16_length(F.col("target")) <= MAX_UTF16) & F.coalesce((utf16_length(F.col("other")) <= MAX_UTF16) & (F.upper("other") != F.upper("target")), F.lit(True))
    alone = (F.col("n") == 1) & short
    here = F.upper("path") == F.upper("target")
    action = F.when(here, "SKIP_ORGANIZED").when(F.col("near"), "RENAME").otherwise("COPY_VERIFY")
    first = rows.where(alone).select("id", action.alias("action"), F.when(~here, F.col("target")).alias("new_path"), F.when(~here | (F.upper("pair_path") != F.upper("other")), F.col("other")).alias("pair_new_path"))
    # a few buckets for each partition, each of whole groups
    buckets = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("fk", "root"), F.lit(buckets)).alias("bucket")
    made = "id long, action string, new_path string, pair_new_path string"
    climb = rows.where(~alone).select("id", "path", "ext", "hash_hex", "names", "target_dir", "near", "pair_path", "pair_ext", bucket).groupBy("bucket")
    if there is None:
        placed = climb.applyInPandas(lambda pdf: _place(pdf), made)
    else:
        placed = climb.cogroup(there.select("key", "held", bucket).groupBy("bucket")).applyInPandas(_place, made)
    return done.unionByName(lost).unionByName(first).unionByName(placed)


def default_targets(items: DataFrame, library: str, dir_template: Template, file_template: Template) -> DataFrame:
    """The path that the template gives each item before any collision."""
    args = (F.col("taken_ms"), F.col("hash_hex"), F.col("camera"))
    target = join_target(F.lit(library), render_dir(dir_template, *args, F.col("rel_dir"), F.col("folder"), F.col("orig_stem")), render_file(file_template, *args, F.col("orig_stem")), F.col("ext"))
    return items.select("id", target.alias("target"))


def preview_tally(planned: DataFrame) -> DataFrame:
    """Rows of each action; a pair that moves along counts as one more of the same kind."""
    pair = planned.where("pair_new_path is not null").select(F.when(F.col("action") == "COPY_VERIFY", "COPY_VERIFY").otherwise("RENAME").alias("action"))
    return planned.select("action").unionByName(pair).groupBy("action").agg(F.count("*").alias("n"))


def preview_sample(planned: DataFrame) -> DataFrame:
    """The first 500 rows that need a look, by id."""
    return planned.where(~F.col("action").isin(*DULL)).orderBy("id").limit(SAMPLE)


def missing_libraries(volumes: DataFrame, libraries: DataFrame) -> DataFrame:
    return volumes.join(libraries.select("volume_id").distinct(), "volume_id", "left_anti")


def source_state(items: DataFrame, disk: DataFrame) -> DataFrame:
    """Items with status 1, and pairs likewise, where the disk (file_id, size, mtime) no longer has what the index says."""

    def checked(d: DataFrame, at: str) -> tuple[DataFrame, Column]:
        now = disk.select(F.col("file_id").alias("d_id"), F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"))
        same = (F.col("d_size") == F.col(f"{at}size")) & (F.col("d_mtime") == F.col(f"{at}mtime"))
        d = d.join(now, F.col("d_id") == F.col(f"{at}file_id" if at else "id"), "left").withColumn("same", F.coalesce(same, F.lit(False))).drop("d_id", "d_size", "d_mtime")
        return d, F.when((F.col(f"{at}status") == 0) & ~F.col("same"), F.lit(1)).otherwise(F.col(f"{at}status"))

    d, status = checked(items, "")
    d = d.withColumn("status", status).drop("same")
    if "pair" not in items.columns:
        return d
    d, status = checked(d, "pair.")
    return d.withColumn("pair", F.when(F.col("pair").isNotNull(), F.col("pair").withField("status", status))).drop("same")


def hashes_needed(items: DataFrame, library: str, file_template: Template, include_uncertain: bool = False) -> DataFrame:
    """Files (file_id) whose full hash the plan waits for: for names or to check copies; items and pairs that are skipped anyway are not read."""
    lib = F.lit(library)
    live = (F.col("status") == 0) & (F.lit(include_uncertain) | (F.col("taken_source") != FROM_MTIME)) & F.coalesce(F.col("pair.status") == 0, F.lit(True))
    own = items.where(live & F.col("hash_hex").isNull() & (F.lit(file_template.has_hash) | ~same_volume(F.col("path"), lib))).select(F.col("id").alias("file_id"))
    pairs = items.where(live & F.col("pair").isNotNull() & F.col("pair.hash_hex").isNull() & ~same_volume(F.col("pair.path"), lib)).select("pair.file_id")
    return own.unionByName(pairs).distinct()


def freeze(planned: DataFrame, folder: str, preview_id: int) -> None:
    """Write a previewed plan under its number, so that exactly it is carried out; a number that is there already is refused."""
    planned.write.mode("errorifexists").parquet(f"{folder}/preview-{preview_id}")


def frozen(spark: SparkSession, folder: str, preview_id: int) -> DataFrame:
    """The plan of the newest preview; an older number is refused."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [x.getPath().getName() for x in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
    last = max((int(n.removeprefix("preview-")) for n in names if n.startswith("preview-")), default=None)
    if preview_id != last:
        raise ValueError(f"ERR_PREVIEW_STALE|{preview_id}")
    return spark.read.parquet(f"{folder}/preview-{preview_id}")


def probe_target(targets: DataFrame, files: DataFrame, hashes: DataFrame) -> DataFrame:
    """State of each target (id, folder, name, hash_hex): FREE, SAME_CONTENT (equal valid hash) or OCCUPIED."""
    f = files.where("status = 0").select(F.upper("dir_path").alias("k1"), nocase(F.col("name")).alias("k2"), F.col("id").alias("there"), "size", "mtime")
    h = hashes.select(F.col("file_id").alias("there"), "full_hash", "hashed_size", "hashed_mtime")
    there = f.join(h, "there", "left").groupBy("k1", "k2").agg(F.max(F.when((F.col("hashed_size") == F.col("size")) & (F.col("hashed_mtime") == F.col("mtime")), F.col("full_hash"))).alias("held"), F.count("*").alias("n"))
    d = targets.withColumn("k1", F.upper("folder")).withColumn("k2", nocase(F.col("name"))).join(there, ["k1", "k2"], "left")
    return d.select("id", F.when(F.col("n").isNull(), "FREE").when(F.col("held") == F.col("hash_hex"), "SAME_CONTENT").otherwise("OCCUPIED").alias("state"))


def in_library(files: DataFrame, library: str) -> DataFrame:
    return files.where(in_scope(F.upper("dir_path"), library))
