"""Filtered listing, windows of it and lookups."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import in_scope, join_path, nocase, normalize_for_search
from shelfspark.session import drop_stored, stored

from .rank import ranked

PRESENT = (0, 2)
PAGE_LIMIT = 500


@dataclass(frozen=True)
class FileFilter:
    text: str | None = None
    kind: int | None = None
    exts: tuple[str, ...] = field(default_factory=tuple)
    size_min: int | None = None
    size_max: int | None = None
    date_from: int | None = None
    date_to: int | None = None
    date_field: str = "taken"
    min_px: int | None = None
    dur_min: int | None = None
    dur_max: int | None = None
    root: str | None = None
    include_missing: bool = False
    sort: str | None = None


def normalized_query(text: str) -> str:
    import unicodedata

    flat = unicodedata.normalize("NFD", text.strip().replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


def filter_files(files: DataFrame, meta: DataFrame, f: FileFilter) -> DataFrame:
    """Files that meet all given conditions, with ``date_key`` and ``order_keys`` ready for ``ordered``.

    Metadata is joined only where a condition or the order needs it; missing metadata fails size-of-picture and duration
    conditions and falls back to the modification time in dates.
    """
    conditions: list[Column] = [(F.col("kind") == 0) | F.col("live_pair_id").isNull()]
    if not f.include_missing:
        conditions.append(F.col("status").isin(*PRESENT))
    if f.text and (q := normalized_query(f.text)):
        norm = F.col("name_norm") if "name_norm" in files.columns else normalize_for_search(F.col("name"))
        conditions.append(F.contains(norm, F.lit(q)))
    if f.kind is not None:
        conditions.append(F.col("kind") == f.kind)
    if f.exts:
        conditions.append(F.col("ext").isin(*(e.strip().lstrip(".").lower() for e in f.exts)))
    if f.size_min is not None:
        conditions.append(F.col("size") >= f.size_min)
    if f.size_max is not None:
        conditions.append(F.col("size") <= f.size_max)
    if f.root:
        conditions.append(in_scope(F.upper("dir_path"), f.root))
    # one filter and one projection: a search as one types spends its time on planning
    d = files.where(reduce(and_, conditions))
    taken = f.date_field == "taken"
    inner = f.min_px is not None or f.dur_min is not None or f.dur_max is not None
    if inner or taken:
        m = meta.select(F.col("file_id").alias("id"), "width", "height", "duration_ms", "taken_at")
        d = d.join(m, "id", "inner" if inner else "left")
    date, after = F.coalesce("taken_at", "mtime") if taken else F.col("mtime"), []
    if f.min_px is not None:
        after.append(F.col("width") * F.col("height") >= f.min_px)
    if f.dur_min is not None:
        after.append(F.col("duration_ms") >= f.dur_min)
    if f.dur_max is not None:
        after.append(F.col("duration_ms") <= f.dur_max)
    if f.date_from is not None:
        after.append(date >= f.date_from)
    if f.date_to is not None:
        after.append(date <= f.date_to)
    return (d.where(reduce(and_, after)) if after else d).withColumn("date_key", date)


def order_of(sort: str | None) -> list[Column]:
    """Sort keys; ids break ties so that pages are stable."""
    keys = {"date_asc": F.asc("date_key"), "mtime_asc": F.asc("date_key"), "name": nocase(F.col("name")).asc(), "size_desc": F.desc("size"), "size_asc": F.asc("size")}
    return [keys.get(sort or "", F.desc("date_key")), F.asc("id")]


def listing(files: DataFrame, meta: DataFrame, f: FileFilter) -> DataFrame:
    return filter_files(files, meta, f).orderBy(*order_of(f.sort))


def page(rows: DataFrame, start: int, count: int) -> DataFrame:
    """A window of an ordered listing, of at most 500 rows."""
    return rows.offset(max(0, start)).limit(max(0, min(count, PAGE_LIMIT)))


class QueryCache:
    """The listings of the last two queries, kept as tables of ranked ids, so that a window is a range of ranks and no new sort.

    A window of a query that two others have followed is refused.
    """

    def __init__(self) -> None:
        self.last, self.kept = 0, {}

    def query(self, files: DataFrame, meta: DataFrame, f: FileFilter) -> tuple[int, DataFrame]:
        """(number of the query, its ids with their ranks from 1)."""
        # only what orders the files is sorted, stored and sent, not their contents
        d = filter_files(files, meta, f)
        keys = {"name": "name", "size_desc": "size", "size_asc": "size"}.get(f.sort or "", "date_key")
        ids = ranked(d.select("id", keys), *order_of(f.sort)).select("id", "rank")
        self.last += 1
        self.kept[self.last] = stored(ids.repartitionByRange("rank").sortWithinPartitions("rank"))
        for old in [k for k in self.kept if k <= self.last - 2]:
            drop_stored(self.kept.pop(old))
        return self.last, self.kept[self.last]

    def window(self, query_id: int, start: int, count: int) -> DataFrame:
        """Ids of the ranks from ``start`` (from 0) on, at most 500; none past the end."""
        if query_id not in self.kept:
            raise LookupError("ERR_QUERY_EXPIRED")
        start, count = max(0, start), max(0, min(count, PAGE_LIMIT))
        return self.kept[query_id].where(F.col("rank").between(start + 1, start + count)).orderBy("rank").limit(count)


def with_search_name(files: DataFrame) -> DataFrame:
    """Files with ``name_norm`` stored, so that text searches are a scan of one narrow column."""
    return files.withColumn("name_norm", normalize_for_search(F.col("name")))


def media_src(files: DataFrame, meta: DataFrame, file_id: int) -> DataFrame:
    """Path and duration of a file."""
    m = meta.where(F.col("file_id") == file_id).select(F.col("file_id").alias("id"), "duration_ms")
    return files.where(F.col("id") == file_id).join(m, "id", "left").select("id", join_path(F.col("dir_path"), F.col("name")).alias("path"), "duration_ms")


def shown_range(ordered: DataFrame, anchor: int | None, clicked: int) -> DataFrame:
    """Ids (id, rank) between the last and this click in the order shown; only this one if the last is gone, none if this one is."""
    at = ordered.where(F.col("id").isin(*{clicked, *([anchor] if anchor is not None else [])})).agg(
        F.max(F.when(F.col("id") == clicked, F.col("rank"))).alias("to"), F.max(F.when(F.col("id") == (anchor if anchor is not None else clicked), F.col("rank"))).alias("start")
    )
    d = ordered.crossJoin(F.broadcast(at)).where("to is not null")
    start = F.coalesce("start", "to")
    return d.where(F.col("rank").between(F.least(start, F.col("to")), F.greatest(start, F.col("to")))).select("id", "rank")


def prune_selection(selected: DataFrame, groups: DataFrame) -> DataFrame:
    """Selected groups (group_id) that are still there."""
    return selected.join(groups.select("group_id"), "group_id", "left_semi")


#: What the filter form offers: pixels, and durations (least, most) in milliseconds.
MEGAPIXELS = {mp: mp * 1_000_000 for mp in (2, 5, 8, 12)}
DURATIONS = {"short": (None, 60_000), "medium": (60_000, 600_000), "long": (600_000, None)}


def bytes_of_mb(text: str) -> int | None:
    """Bytes of a number of megabytes as typed; None while it is no number of at least 0."""
    m = re.match(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)", text)
    return math.floor(float(m[1]) * 1024 * 1024 + 0.5) if m else None


def fetch_rows(files: DataFrame, meta: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each requested (pos, id), in that order, null columns where the file is gone."""
    m = meta.select(F.col("file_id").alias("id"), "width", "height", "duration_ms", "taken_at")
    found = files.join(m, "id", "left").select("id", "name", "dir_path", "size", "width", "height", F.col("live_pair_id").isNotNull().alias("is_live"))
    return ids.join(found, "id", "left").orderBy("pos")


def file_detail(files: DataFrame, meta: DataFrame, file_id: int) -> DataFrame:
    m = meta.where(F.col("file_id") == file_id).select(F.col("file_id").alias("id"), "width", "height", "duration_ms", "taken_at", "orientation")
    return files.where(F.col("id") == file_id).join(m, "id", "left").withColumn("path", join_path(F.col("dir_path"), F.col("name")))


def present_after(files: DataFrame, after: int, limit: int) -> DataFrame:
    return files.where((F.col("status") == 0) & (F.col("id") > after)).select("id").orderBy("id").limit(limit)
