"""Near-duplicate pictures by Hamming distance of their fingerprints, with guards by shape and capture time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.media import hamming
from shelfspark.session import stored

from . import grid
from .graph import components
from .index import guarded
from .rank import ranked

MAX_DISTANCE, ASPECT_TOLERANCE = 16, grid.ASPECT_TOLERANCE
#: Bands narrower than this select too little to be join keys; nor do bands that bring together more pairs than this for each of their rows.
LEAST_BAND_BITS, MOST_MET = 8, 20


def pending_fingerprints(files: DataFrame, phashes: DataFrame, after: int, limit: int) -> DataFrame:
    """Present pictures without a fingerprint or a tombstone (kind 0 or 3)."""
    have = phashes.where("kind in (0, 3) and seq = 0").select(F.col("file_id").alias("id"))
    return files.where((F.col("kind") == 0) & (F.col("status") == 0) & (F.col("id") > after)).select("id").join(have, "id", "left_anti").orderBy("id").limit(limit)


def fingerprint_items(files: DataFrame, meta: DataFrame, phashes: DataFrame, words: int = 4) -> DataFrame:
    """Present files all of whose fingerprint words are there: (file_id, hash, width, height, taken_at)."""
    h = phashes.where((F.col("kind") == 0) & (F.col("seq") < words)).groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "hash64"))).alias("w"))
    h = h.where(F.col("n") == words).select("file_id", F.transform("w", lambda x: x.getField("hash64")).alias("hash"))
    m = meta.select("file_id", "width", "height", "taken_at")
    return h.join(files.where("status = 0").select(F.col("id").alias("file_id")), "file_id", "left_semi").join(m, "file_id", "left")


def _ratio(d: str) -> Column:
    w, h = F.col(f"{d}.width"), F.col(f"{d}.height")
    return F.when((w > 0) & (h > 0), w.cast("double") / h)


def _bands(hash_: Column, words: int, count: int) -> Column:
    """Array of (band, value): the bits cut into ``count`` stretches of nearly equal length, none across words' order."""
    bits = words * 64
    cut = [bits * k // count for k in range(count + 1)]

    def value(lo: int, hi: int) -> Column:
        parts = []
        while lo < hi:
            word, at = divmod(lo, 64)
            n = min(hi - lo, 64 - at)
            w = F.shiftrightunsigned(F.element_at(hash_, word + 1), at)
            parts.append((w if n == 64 else w.bitwiseAND(F.lit((1 << n) - 1))).cast("string"))
            lo += n
        return F.concat_ws(":", *parts)

    return F.array(*(F.struct(F.lit(k).alias("band"), value(cut[k], cut[k + 1]).alias("value")) for k in range(count)))


def _banded_pairs(items: DataFrame, max_distance: int, words: int) -> DataFrame | None:
    """The pairs of ``similar_pairs`` by equi-join on bands, one of which is equal; None where bands select too little, as told by counts of all of them."""
    count = max_distance + 1
    if words * 64 // count < LEAST_BAND_BITS:
        return None
    d = items.select(F.col("file_id").alias("id"), "hash", "width", "height", "taken_at").where("id is not null and hash is not null")
    d = d.where(F.size("hash") == words).withColumn("k", F.explode(_bands(F.col("hash"), words, count)))
    n = F.col("n").cast("double")
    met, rows = d.groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if met > MOST_MET * rows:
        return None
    x, y = d.alias("x"), d.alias("y")
    ra, rb = _ratio("x"), _ratio("y")
    shape = F.coalesce(F.abs(ra - rb) <= ASPECT_TOLERANCE * F.greatest(ra, rb), F.lit(True))
    time = F.coalesce(F.col("x.taken_at") == F.col("y.taken_at"), F.lit(True))
    dist = hamming(F.col("x.hash"), F.col("y.hash"))
    got = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & shape & time & (dist <= max_distance))
    return got.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), dist.alias("distance")).distinct()


def similar_pairs(items: DataFrame, max_distance: int = MAX_DISTANCE, words: int = 4) -> DataFrame:
    """Pairs (a, b, distance), a < b, at most ``max_distance`` bits apart, of like shape and the same capture time.

    A missing or non-positive dimension, or a missing time, blocks nothing. Where bands select well, pairs meet by equi-join on
    (band, value); else tiles of all rows meet tiles of all others. Their number may grow with the square of the rows: see
    ``similar_links`` and ``similar_clusters``.
    """
    found = _banded_pairs(items, max_distance, words)
    return grid.pairs(items, max_distance, words) if found is None else found


def similar_links(items: DataFrame, max_distance: int = MAX_DISTANCE, words: int = 4) -> DataFrame:
    """A row for each picture with a fingerprint: file_id, class_id, links.

    ``links`` are the others that ``similar_pairs`` pairs it with, ``class_id`` is the least id that a chain of them leads to, its own if there
    is none. Every pair is compared, but none is listed. A picture with several fingerprints has the links of all.
    """
    found = _banded_pairs(items, max_distance, words)
    if found is None:
        got = grid.links(items, max_distance, words)
    else:
        one, found = F.lit(1).cast("long").alias("links"), stored(found)
        got = found.select(F.col("a").alias("node"), one, F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("node"), one, F.col("a").alias("root")))
    got = stored(got)
    comp = components(got.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "file_id")
    count = got.groupBy(F.col("node").alias("file_id")).agg(F.sum("links").alias("links"))
    ids = items.where("file_id is not null and hash is not null").select("file_id").distinct()
    d = ids.join(count, "file_id", "left").join(comp, "file_id", "left")
    return d.select("file_id", F.coalesce("root", "file_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_clusters(items: DataFrame, max_distance: int = MAX_DISTANCE, words: int = 4) -> DataFrame:
    """Pairs (a, b) that connect the same pictures as ``similar_pairs`` does, a few for each."""
    found = _banded_pairs(items, max_distance, words)
    return grid.clusters(items, max_distance, words) if found is None else found.select("a", "b")


def similar_members(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members (group_id, file_id) of clusters; a cluster of several capture times is split by them.

    Members without a time leave a split cluster; groups of one are dropped. group_id is the least member.
    """
    comp = components(pairs.select("a", "b")).select(F.col("node").alias("file_id"), "root")
    d = comp.join(items.select("file_id", "taken_at"), "file_id")
    stamps = d.groupBy("root").agg(F.count_distinct("taken_at").alias("stamps"))
    d = d.join(stamps, "root").where("stamps < 2 or taken_at is not null").withColumn("part", F.when(F.col("stamps") >= 2, F.col("taken_at")))
    g = d.groupBy("root", "part").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n >= 2")
    on = d["root"].eqNullSafe(g["root"]) & d["part"].eqNullSafe(g["part"])
    return d.join(g, on).select(g["group_id"], d["file_id"])


def inherit_ids(members: DataFrame, previous: DataFrame) -> DataFrame:
    """``members`` (group_id, file_id) with the ids of earlier groups (``previous``, same columns) where they live on.

    In the order of least members, each group takes of the earlier groups its members were in the one of most members
    (ties: least id) that no group before took; others are numbered after the highest. Only groups that share an earlier
    one depend on each other, so each such cluster is settled by itself.
    """
    votes = members.join(previous.select("file_id", F.col("group_id").alias("old")), "file_id").groupBy("group_id", "old").agg(F.count("*").alias("votes"))
    # earlier ids get negative node numbers, so that they don't mix with the new ones
    comp = components(votes.select((-F.col("old") - 1).alias("a"), F.col("group_id").alias("b")))
    work = votes.join(comp.withColumnRenamed("node", "group_id"), "group_id")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        for g, rows in pdf.sort_values(["group_id", "votes", "old"], ascending=[True, False, True]).groupby("group_id", sort=True):
            free = [o for o in rows.old if o not in taken]
            if free:
                taken.add(free[0])
                out.append((g, free[0]))
        return pd.DataFrame(out, columns=["group_id", "old"])

    kept = stored(work.groupBy("root").applyInPandas(settle, "group_id long, old long"))
    top = previous.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top"))
    ids = members.select("group_id").distinct()
    fresh = ranked(ids.join(kept, "group_id", "left_anti"), "group_id").crossJoin(F.broadcast(top))
    named = kept.select("group_id", F.col("old").alias("new_id")).unionByName(fresh.select("group_id", (F.col("top") + F.col("rank")).alias("new_id")))
    return members.join(named, "group_id").select(F.col("new_id").cast("long").alias("group_id"), "file_id")


def similar_waste(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, n, waste): all sizes but the largest."""
    d = members.join(files.select(F.col("id").alias("file_id"), "size"), "file_id")
    return d.groupBy("group_id").agg(F.count("*").alias("n"), (F.sum("size") - F.max("size")).alias("waste"))


def sign_words(vector: Column, words: int) -> Column:
    """Fingerprint of a vector: the signs of 64 dimensions to a word."""

    def word(k: int) -> Column:
        bits = F.transform(F.slice(vector, k * 64 + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*(word(k) for k in range(words)))


NO_FINGERPRINT = 3


def upsert_fingerprints(files: DataFrame, phashes: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprint rows (file_id, kind, seq, hash64) after results ``new`` (file_id, hash or null, src_size, src_mtime) of unchanged files.

    Four words replace what was there; a picture without contrast leaves one row of kind 3, so that it isn't tried again.
    """
    fresh = guarded(files, new)
    words = fresh.where("hash is not null").select("file_id", F.lit(0).alias("kind"), F.posexplode("hash").alias("seq", "hash64"))
    none = fresh.where("hash is null").select("file_id", F.lit(NO_FINGERPRINT).alias("kind"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("hash64"))
    over = fresh.select("file_id").distinct().withColumn("over", F.lit(True))
    old = phashes.join(over, "file_id", "left").where("over is null or kind not in (0, 3)").select("file_id", "kind", "seq", "hash64")
    return old.unionByName(words).unionByName(none)


def fingerprint_job(files: DataFrame, meta: DataFrame, phashes: DataFrame, read: Callable[[DataFrame], DataFrame], max_distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, members) after what is pending has been read (``read``: file_id in, results of ``upsert_fingerprints`` out) and all are grouped anew."""
    have = phashes.where("kind in (0, 3) and seq = 0").select(F.col("file_id").alias("id"))
    pending = files.where("kind = 0 and status = 0").select("id").join(have, "id", "left_anti").select(F.col("id").alias("file_id"))
    phashes = stored(upsert_fingerprints(files, phashes, read(pending)))
    items = stored(fingerprint_items(files, meta, phashes))
    return phashes, similar_members(items, stored(similar_clusters(items, max_distance)))
