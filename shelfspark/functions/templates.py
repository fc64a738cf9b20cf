"""Path templates: parsed on the driver, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_component, sanitize_camera, sanitize_component, sanitize_relpath

DEFAULT_DIR, DEFAULT_FILE = r"{YYYY}\{YYYY}-{MM}", "{YYYYMMDD}_{hhmmss}_{hash4}"
_DATES = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "YYYYMMDD": "yyyyMMdd", "hh": "HH", "mm": "mm", "ss": "ss", "hhmmss": "HHmmss"}
_DIR_ONLY = ("relpath", "folder")
_NAMES = (*_DATES, "hash4", "hash8", "hash16", "camera", *_DIR_ONLY, "name")


class TemplateError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}{': ' + detail if detail else ''}")
        self.code = code


@dataclass(frozen=True)
class Template:
    parts: tuple[tuple[str, str], ...]  # ("text", literal) or ("token", name)
    folder: bool

    @property
    def has_hash(self) -> bool:
        return any(k == "token" and v.startswith("hash") for k, v in self.parts)


def parse(source: str, folder: bool) -> Template:
    """The template, or a TemplateError with one of the codes Empty, Unclosed, UnknownToken, BadChar, Absolute, ParentRef, SepInFile, DirOnlyToken."""
    if not source.strip():
        raise TemplateError("Empty")
    parts: list[tuple[str, str]] = []
    rest = source
    while rest:
        text, brace, after = rest.partition("{")
        for c in text:
            if c in '<>:"|?*' and not (folder and c == ":") or ord(c) < 32:
                raise TemplateError("BadChar", c)
            if c == ":":
                raise TemplateError("BadChar", c)
            if c in "\\/" and not folder:
                raise TemplateError("SepInFile")
        if text:
            parts.append(("text", text))
        if not brace:
            break
        name, close, rest = after.partition("}")
        if not close:
            raise TemplateError("Unclosed")
        if name not in _NAMES:
            raise TemplateError("UnknownToken", name)
        if name in _DIR_ONLY and not folder:
            raise TemplateError("DirOnlyToken", name)
        parts.append(("token", name))
    if folder:
        flat = "".join(v if k == "text" else "x" for k, v in parts).replace("/", "\\")
        if flat.startswith("\\"):
            raise TemplateError("Absolute")
        if any(s.strip() == ".." for s in flat.split("\\")):
            raise TemplateError("ParentRef")
    return Template(tuple(parts), folder)


def _raw(t: Template, taken: Column, hash_hex: Column, cam: Column, rel: Column, folder: Column, name: Column, hash_length: int | None) -> Column:
    when = F.timestamp_millis(taken)

    def token(v: str) -> Column:
        if v in _DATES:
            return F.date_format(when, _DATES[v])
        if v.startswith("hash"):
            return F.substring(F.coalesce(hash_hex, F.lit("")), 1, hash_length or int(v[4:]))
        if v == "camera":
            return F.coalesce(sanitize_camera(cam), F.lit(""))
        if v == "relpath":
            return F.coalesce(sanitize_relpath(rel), F.lit(""))
        return F.coalesce(sanitize_component(folder if v == "folder" else name), F.lit(""))

    return F.concat(*(F.lit(v) if k == "text" else token(v) for k, v in t.parts))


def render_file(t: Template, taken: Column, hash_hex: Column, cam: Column, name: Column, hash_length: int | None = None) -> Column:
    none = F.lit(None).cast("string")
    return clean_component(_raw(t, taken, hash_hex, cam, none, none, name, hash_length))


def render_dir(t: Template, taken: Column, hash_hex: Column, cam: Column, rel: Column, folder: Column, name: Column) -> Column:
    """Array of the folder's cleaned segments, empty ones left out."""
    raw = F.regexp_replace(_raw(t, taken, hash_hex, cam, rel, folder, name, None), "/", r"\\")
    return F.filter(F.transform(F.split(raw, r"\\"), clean_component), lambda x: x != "")


def join_target(root: Column, segments: Column, name: Column, ext: Column) -> Column:
    base = F.regexp_replace(root, r"\\+$", "")
    return F.concat_ws("\\", base, F.nullif(F.array_join(segments, "\\"), F.lit("")), F.concat(name, F.lit("."), ext))
