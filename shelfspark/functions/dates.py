"""Dates of files as column expressions. Wall-clock times are milliseconds as if they were UTC."""

from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

EARLIEST, DAY = 631_152_000_000, 86_400_000
FROM_META, FROM_QUICKTIME, FROM_NAME, FROM_MTIME = 0, 1, 2, 3


def known_zone(zone: str | None) -> bool:
    try:
        return bool(zone) and ZoneInfo(zone) is not None
    except (ZoneInfoNotFoundError, ValueError):
        return False


def offset_ms(ms: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """The zone's offset at that instant; the fallback where the zone is unknown."""
    if not known_zone(zone):
        return F.lit(fallback_minutes * 60_000).cast("long")
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) - ms


def civil_ms(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, last_second: int = 59, years: tuple[int, int] = (1900, 2100)) -> Column:
    """Wall-clock milliseconds of a civil time, null if there is no such time."""
    ok = y.between(*years) & (h < 24) & (mi < 60) & (s <= last_second)
    day = F.unix_date(F.expr("null").cast("date"))
    date = F.try_make_timestamp(y, mo, d, F.lit(0), F.lit(0), F.lit(0.0))
    day = F.unix_millis(date)
    return F.when(ok, day + (h * 3600 + mi * 60 + s).cast("long") * 1000)


_YEAR, _TWO = r"((?:19|20)\d{2})", r"(\d{2})"
_OPEN, _CLOSE = r"(?:^|[^0-9])", r"(?:[^0-9]|$)"
_FORMS = {
    "compact_time": _OPEN + _YEAR + _TWO + _TWO + r"[_\- .]?" + _TWO * 3 + r"(?:\d{3})?" + _CLOSE,
    "dashed_time": _OPEN + _YEAR + "-" + _TWO + "-" + _TWO + r"[ _T.\-]" + r"[.\-:]".join([_TWO] * 3) + _CLOSE,
    "epoch_ms": _OPEN + r"(1[3-9]\d{11})" + _CLOSE,
    "epoch_s": _OPEN + r"(1[3-9]\d{8})" + _CLOSE,
    "compact_day": _OPEN + _YEAR + _TWO + _TWO + _CLOSE,
    "dashed_day": _OPEN + _YEAR + "-" + _TWO + "-" + _TWO + _CLOSE,
}


def _first_valid(name: Column, form: str, time: bool) -> Column:
    groups = [F.regexp_extract_all(name, F.lit(_FORMS[form]), F.lit(g)) for g in range(1, 7 if time else 4)]
    first = groups[0]

    def ms(i: Column) -> Column:
        p = [F.get(g, i).cast("int") for g in groups]
        return civil_ms(p[0], p[1], p[2], *(p[3:] if time else [F.lit(0)] * 3))

    return F.try_element_at(F.filter(F.transform(F.transform(first, lambda x, i: i), ms), lambda x: x.isNotNull()), F.lit(1))


def filename_date(name: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """Struct (ms, has_time) of the date that a name tells, null if none: times before epochs before mere days."""

    def epoch(form: str, unit: int) -> Column:
        instant = F.nullif(F.regexp_extract(name, _FORMS[form], 1), F.lit("")).cast("long") * unit
        return instant + offset_ms(instant, zone, fallback_minutes)

    timed = F.coalesce(_first_valid(name, "compact_time", True), _first_valid(name, "dashed_time", True), epoch("epoch_ms", 1), epoch("epoch_s", 1000))
    day = F.coalesce(_first_valid(name, "compact_day", False), _first_valid(name, "dashed_day", False))
    ms = F.coalesce(timed, day)
    return F.when(ms.isNotNull(), F.struct(ms.alias("ms"), timed.isNotNull().alias("has_time")))


def sane(ms: Column, now_ms: Column) -> Column:
    return ms.between(F.lit(EARLIEST), now_ms + DAY)


def resolve_taken(taken: Column, source: Column, name: Column, mtime: Column, now_ms: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """Struct (ms, source): the metadata's time if sane, else the name's, else the modification time in the wall frame."""
    named = filename_date(name, zone, fallback_minutes).getField("ms")
    wall = mtime + offset_ms(mtime, zone, fallback_minutes)
    return (
        F.when(sane(taken, now_ms), F.struct(taken.alias("ms"), F.coalesce(source, F.lit(FROM_META)).cast("int").alias("source")))
        .when(sane(named, now_ms), F.struct(named.alias("ms"), F.lit(FROM_NAME).alias("source")))
        .otherwise(F.struct(wall.alias("ms"), F.lit(FROM_MTIME).alias("source")))
    )


def exif_ms(text: Column, subsec: Column, now_ms: Column) -> Column:
    """An EXIF time "YYYY:MM:DD hh:mm:ss" with up to three sub-second digits; second 60 runs over, the far future is null."""
    form = r"^(\d{4})[:\-](\d{2})[:\-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
    p = [F.regexp_extract(text, form, k).try_cast("int") for k in range(1, 7)]
    digits = F.regexp_extract(F.coalesce(subsec, F.lit("")), r"^(\d{1,3})", 1)
    ms = civil_ms(*p, last_second=60, years=(1990, 2100)) + F.coalesce(F.rpad(F.nullif(digits, F.lit("")), 3, "0").try_cast("long"), F.lit(0))
    return F.when(ms <= now_ms + DAY, ms)


def iso_datetime(text: Column) -> Column:
    """Struct (ms, has_offset) of the local part of an ISO time; null if it is none."""
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"

    def read(t: Column) -> Column:
        # the form has fixed places
        p = [F.substring(t, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
        digits = F.when(F.substring(t, 20, 1) == ".", F.regexp_extract(F.substring(t, 21, 3), r"^\d{1,3}", 0))
        ms = civil_ms(*p, last_second=60) + F.coalesce(F.rpad(F.nullif(digits, F.lit("")), 3, "0").try_cast("long"), F.lit(0))
        rest = F.substring(t, 20, 1 << 30)
        return once(F.when(t.rlike(form), ms), lambda x: F.when(x.isNotNull(), F.struct(x.alias("ms"), rest.rlike(r"^(?:\.\d+)?[+\-].*$").alias("has_offset"))))

    return once(text, read)


def video_taken(creation: Column, plain: Column, now_ms: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """Wall clock of a video: the first of both times that reads; one with an offset is local already, others are UTC."""

    def local(t: Column) -> Column:
        ms = t.getField("ms")
        return F.when(t.getField("has_offset"), ms).otherwise(ms + offset_ms(ms, zone, fallback_minutes))

    ms = F.coalesce(once(iso_datetime(creation), local), once(iso_datetime(plain), local))
    return once(ms, lambda x: F.when(sane(x, now_ms), x))


def day_bound(date: str, zone: str | None, end: bool = False, fallback_minutes: int = 0) -> int | None:
    """Instant where a local day begins (or ends, to the millisecond); None for a date that the zone skips or that is none."""
    try:
        day = datetime.date.fromisoformat(date)
    except ValueError:
        return None
    if not known_zone(zone):
        tz: datetime.tzinfo = datetime.timezone(datetime.timedelta(minutes=fallback_minutes))
    else:
        tz = ZoneInfo(zone)

    def first(d: datetime.date) -> int | None:
        base = int(datetime.datetime.combine(d, datetime.time(), datetime.UTC).timestamp() * 1000)
        local = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, tz).date()
        lo, hi = base - 16 * 3_600_000, base + 40 * 3_600_000
        hits = [x for x in range(lo, hi, 900_000) if local(x) == d]
        if not hits:
            return None
        a = hits[0]
        lo = a - 900_000
        while a - lo > 1:
            m = (a + lo) // 2
            a, lo = (m, lo) if local(m) == d else (a, m)
        return a

    start = first(day)
    if start is None or not end:
        return start
    later = day
    for _ in range(3):
        later += datetime.timedelta(days=1)
        if (x := first(later)) is not None:
            return x - 1
    return None


def _shown(ms: Column, zone: str | None, fallback_minutes: int, form: str, otherwise: str) -> Column:
    """A time in a zone by its form; ``otherwise`` beyond the years 0 to 9999 and for null."""
    # the session's zone plays no part: days and minutes apart
    wall = ms + offset_ms(ms, zone, fallback_minutes)
    day = F.date_from_unix_date(F.floor(wall / DAY).cast("int"))
    minute = F.floor(F.pmod(wall, F.lit(DAY)) / 60_000).cast("int")
    text = F.date_format(day, "yyyy-MM-dd")
    if form == "minute":
        text = F.concat(text, F.format_string(" %02d:%02d", F.floor(minute / 60), minute % 60))
    return F.when(ms.between(-62_135_596_800_000, 253_402_300_799_999), text).otherwise(F.lit(otherwise))


def date_input(ms: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """The day of an instant in a zone as yyyy-mm-dd; "" if there is none."""
    return _shown(ms, zone, fallback_minutes, "day", "")


def date_time_text(ms: Column, zone: str | None = None, fallback_minutes: int = 0) -> Column:
    """The minute of an instant in a zone as yyyy-mm-dd hh:mm; "-" if there is none."""
    return _shown(ms, zone, fallback_minutes, "minute", "-")
