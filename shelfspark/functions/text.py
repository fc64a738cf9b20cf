"""Names, paths and sizes as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@cache
def _accents() -> tuple[str, str]:
    """Precomposed letters with marks, and their bare letters."""
    src, dst = [], []
    for c in range(0xC0, 0x2000):
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != chr(c):
            src.append(chr(c))
            dst.append(bare)
    return "".join(src) + "đĐ", "".join(dst) + "dD"


def normalize_for_search(c: Column) -> Column:
    """Without accents and combining marks, đ as d, in lower case."""
    src, dst = _accents()
    return F.lower(F.regexp_replace(F.translate(c, src, dst), r"\p{M}", ""))


def nocase(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(c, _UPPER, _LOWER)


def normalize_path(c: Column) -> Column:
    """Back slashes, no trailing one beyond a drive's root, drive letter in upper case."""
    p = F.regexp_replace(c, "/", r"\\")
    p = F.when(F.length(p) > 3, F.concat(F.substring(p, 1, 3), F.regexp_replace(F.substring(p, 4, 1 << 30), r"\\+$", ""))).otherwise(p)
    p = F.when((F.length(p) > 3) & p.endswith("\\"), F.regexp_replace(p, r"\\+$", "")).otherwise(p)
    return F.when(p.rlike("^[a-z]:"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)


def path_key(c: Column) -> Column:
    return F.upper(c)


def in_scope(key: Column, root: Column | str) -> Column:
    """Whether an upper-case path is the root itself or lies under it; comparisons that a scan can prune by."""
    root = F.lit(root.upper()) if isinstance(root, str) else F.upper(root)
    base = F.regexp_replace(root, r"\\$", "")
    return (key == base) | (key == root) | ((key >= F.concat(base, F.lit("\\"))) & (key < F.concat(base, F.lit("]"))))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder.endswith("\\"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("\\"), name))


def drive_letter(c: Column) -> Column:
    """Upper-case drive letter, null without one."""
    return F.upper(F.nullif(F.regexp_extract(c, "^([A-Za-z]):", 1), F.lit("")))


def same_volume(a: Column, b: Column) -> Column:
    return F.coalesce(drive_letter(a) == drive_letter(b), F.lit(False))


def extension(name: Column) -> Column:
    """What follows the last dot, ASCII lower case; null if there is no dot."""
    ext = nocase(F.substring_index(name, ".", -1))
    return F.when(F.length(ext) < F.length(name), ext)


def stem(name: Column) -> Column:
    """The name without its last extension; a name that only begins with a dot stays whole."""
    cut = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(cut > 0, F.substring(name, F.lit(1), cut)).otherwise(name)


def last_segment(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, r"\\"), lambda x: x != ""), F.lit(-1))


def relative_to(folder: Column, base: Column) -> Column:
    """What of ``folder`` lies under ``base`` (Unicode case ignored): "" at the base, null outside."""
    b = F.regexp_replace(base, r"\\+$", "")
    return F.when(F.upper(folder) == F.upper(b), F.lit("")).when(F.upper(folder).startswith(F.concat(F.upper(b), F.lit("\\"))), F.substring(folder, F.length(b) + 2, F.length(folder)))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def size_text(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal under 100 and none from there on."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n.cast("double") / float(1024**k)
        shown = F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v))
        out = F.when(n.cast("double") / float(1024 ** (k - 1)) >= 1023.5, F.concat(shown, F.lit(f" {unit}"))).otherwise(out) if k == 1 else F.when(n.cast("double") / float(1024 ** (k - 1)) >= 1023.5, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_text(ms: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.round(ms / 1000).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def error_code(c: Column) -> tuple[Column, Column]:
    """(code, detail) of an error text "ERR_CODE|detail"; a text of another form is all detail."""
    hit = c.rlike(r"^ERR_[A-Z0-9_]+(\||$)")
    code = F.when(hit, F.regexp_extract(c, r"^(ERR_[A-Z0-9_]+)", 1))
    return code, F.when(hit, F.regexp_extract(c, r"^ERR_[A-Z0-9_]+\|?([\s\S]*)$", 1)).otherwise(c)


_MIME = {
    "image/jpeg": "jpg jpeg jfif", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/avif": "avif", "image/x-icon": "ico",
    "video/mp4": "mp4 m4v mov", "video/webm": "webm", "video/x-matroska": "mkv", "video/x-msvideo": "avi", "video/mpeg": "mpg mpeg", "video/3gpp": "3gp",
}
MIME = {ext: kind for kind, exts in _MIME.items() for ext in exts.split()}


def mime(ext: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def byte_range(header: Column, size: Column, first: int = 8 << 20, most: int = 16 << 20) -> Column:
    """Struct (start, end, ok) of a one-part range header clamped to the size; ok is false where it can't be met."""
    a = F.expr("try_cast(null as bigint)")
    num = lambda g: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", g).try_cast("long")
    lo, hi = num(1), num(2)
    well = header.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    start = F.when(lo.isNotNull(), lo).otherwise(F.greatest(size - hi, F.lit(0)))
    end = F.when(lo.isNull(), size - 1).otherwise(F.least(F.coalesce(hi, lo + F.lit(first) - 1), lo + F.lit(most) - 1, size - 1))
    ok = well & (size > 0) & (start < size) & (start <= end) & (lo.isNotNull() | (hi > 0))
    return F.struct(F.when(ok, start).otherwise(a).alias("start"), F.when(ok, end).otherwise(a).alias("end"), F.coalesce(ok, F.lit(False)).alias("ok"))


def sanitize_camera(c: Column) -> Column:
    """Letters, digits and hyphens stay; runs of anything else become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}\-]+", "_"), F.lit("_"))


def sanitize_component(c: Column) -> Column:
    """Without the signs that file names may not have."""
    return F.regexp_replace(c, r'[<>:"|?*\\/\x00-\x1f\x7f]', "")


def sanitize_relpath(c: Column) -> Column:
    """Segments cleaned one by one; empty ones and dots go."""
    parts = F.transform(F.split(F.regexp_replace(c, "/", r"\\"), r"\\"), lambda x: F.trim(sanitize_component(x)))
    return F.array_join(F.filter(parts, lambda x: ~x.isin("", ".", "..")), "\\")


def clean_component(c: Column) -> Column:
    """Repeated separators once, none at the ends, device names with an underscore before."""
    one = F.trim(F.regexp_replace(c, r"([_\- ])\1+", "$1"), F.lit("_-. "))
    device = F.upper(F.substring_index(one, ".", 1)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(device, F.concat(F.lit("_"), one)).otherwise(one)
