"""Media facts as column expressions: classes, dimensions, probe output, fingerprints and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

IMAGE = tuple("jpg jpeg png gif bmp webp heic heif hif tif tiff avif jxl dng cr2 cr3 nef arw orf rw2 raf srw pef".split())
VIDEO = tuple("mp4 mov m4v avi mkv wmv flv webm mts m2ts ts 3gp 3g2 mpg mpeg vob divx".split())
CLOUD_MASK = 0x1000 | 0x40000 | 0x400000


def kind_of(ext: Column) -> Column:
    """0 for images, 1 for videos, null for anything else."""
    return F.when(ext.isin(*IMAGE), F.lit(0)).when(ext.isin(*VIDEO), F.lit(1))


def is_cloud(attrs: Column) -> Column:
    return attrs.cast("long").bitwiseAND(F.lit(CLOUD_MASK).cast("long")) != 0


def is_transport_stream(content: Column) -> Column:
    """Whether bytes 0 and 188 are the sync byte of a transport stream."""
    sync = F.lit(bytes([0x47]))
    return (F.octet_length(content) >= 189) & (F.substring(content, 1, 1) == sync) & (F.substring(content, 189, 1) == sync)


def oriented(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def camera(make: Column, model: Column) -> Column:
    """The model, with the make before it unless it begins with it."""
    mk, md = F.trim(make), F.trim(model)
    return F.when(F.coalesce(md, F.lit("")) == "", F.nullif(mk, F.lit(""))).when((F.coalesce(mk, F.lit("")) == "") | F.lower(md).startswith(F.lower(mk)), md).otherwise(F.concat_ws(" ", mk, md))


PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,side_data_list:array<struct<rotation:double>>>>,format:struct<duration:string,bit_rate:string,tags:map<string,string>>>"


def probe(text: Column) -> Column:
    """Struct of a video's facts from probe JSON: width, height, fps, duration_ms, bitrate, vcodec, acodec, ok."""
    j = F.from_json(text, PROBE)
    first = lambda kind: F.try_element_at(F.filter(j.getField("streams"), lambda s: s.getField("codec_type") == kind), F.lit(1))
    v, a = first("video"), first("audio")
    turn = F.coalesce(F.try_element_at(F.filter(F.transform(v.getField("side_data_list"), lambda d: d.getField("rotation")), lambda r: r.isNotNull()), F.lit(1)), F.lit(0.0))
    turned = F.abs(turn) % 180 == 90

    def fraction(c: Column) -> Column:
        n, d = F.try_element_at(F.split(c, "/"), F.lit(1)).try_cast("double"), F.try_element_at(F.split(c, "/"), F.lit(2)).try_cast("double")
        return F.when((d != 0) & (n > 0), n / d)

    fmt = j.getField("format")
    secs = fmt.getField("duration").try_cast("double")
    w, h = F.when(turned, v.getField("height")).otherwise(v.getField("width")), F.when(turned, v.getField("width")).otherwise(v.getField("height"))
    return F.struct(
        w.alias("width"), h.alias("height"), F.coalesce(fraction(v.getField("avg_frame_rate")), fraction(v.getField("r_frame_rate"))).alias("fps"),
        F.when(secs >= 0, (secs * 1000).cast("long")).alias("duration_ms"), fmt.getField("bit_rate").try_cast("long").alias("bitrate"),
        v.getField("codec_name").alias("vcodec"), a.getField("codec_name").alias("acodec"), (w.isNotNull() & h.isNotNull()).alias("ok"),
    )


def thumb_bucket(size: Column) -> Column:
    return F.when(size <= 256, F.lit(256)).otherwise(F.lit(1600))


def fit(width: Column, height: Column, target: int) -> tuple[Column, Column]:
    """Dimensions that fit the target, never enlarged and at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(target)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(x * scale + 0.5).cast("int")) for x in (width, height))


def seek_seconds(duration_ms: Column) -> Column:
    return F.coalesce(F.least(F.greatest(duration_ms * 0.1 / 1000, F.lit(1.0)), F.lit(30.0)), F.lit(1.0))


def difference_hash(gray: Column, width: int = 17, height: int = 16, least_contrast: int = 12) -> Column:
    """Four 64-bit words of left-brighter-than-right bits over a gray grid; null if the contrast is too low."""
    per = (width - 1) * height // 4

    def word(g: Column, k: int) -> Column:
        at = [(i // (width - 1)) * width + i % (width - 1) for i in range(k * per, (k + 1) * per)]
        return reduce(Column.bitwiseOR, (F.shiftleft((F.get(g, x) > F.get(g, x + 1)).cast("long"), per - 1 - i) for i, x in enumerate(at)))

    def words(g: Column) -> Column:
        ok = (F.size(g) == width * height) & (F.array_max(g) - F.array_min(g) >= least_contrast)
        return F.when(ok, F.array(*(word(g, k) for k in range(4))))

    return once(gray, words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))


def quick_hash(content: Column, size: Column) -> Column:
    """Hash of the first and last 4096 bytes and the size."""
    tail = F.least(F.lit(4096), F.greatest(size - 4096, F.lit(0))).cast("int")
    return F.xxhash64(F.substring(content, 1, 4096), F.when(tail > 0, F.substring(content, (size - tail + 1).cast("int"), tail)), size)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance on a sphere of 6371 km."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * 6371.0
