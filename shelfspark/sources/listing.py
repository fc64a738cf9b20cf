"""Listings of files as DataFrames, and a made-up library to try things on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.media import IMAGE, VIDEO, is_cloud, is_transport_stream, quick_hash
from shelfspark.operators.rank import ranked


def scan(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Files under a folder: dir_path, name, size, mtime (ms), attrs (0), and their content only if asked for.

    Paths are given with back slashes, as the rest of the library has them.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "/", r"\\")
    cols = [F.regexp_replace(path, r"\\[^\\]*$", "").alias("dir_path"), F.regexp_extract(path, r"([^\\]*)$", 1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.lit(0).alias("attrs")]
    return d.select(*cols, *([F.col("content")] if with_content else []))


def readable_names(listing: DataFrame) -> DataFrame:
    """Without names that are no valid text (they hold the replacement character)."""
    return listing.where(~F.col("name").contains("\ufffd"))


def drop_source_code(listing: DataFrame) -> DataFrame:
    """Rows whose extension .ts is not that of a transport stream go; so do those in the cloud, which can't be read."""
    here = ~is_cloud(F.col("attrs")) if "attrs" in listing.columns else F.lit(True)
    return listing.where(~F.lower("name").endswith(".ts") | (here & F.coalesce(is_transport_stream(F.col("content")), F.lit(False))))


def hashed(listing: DataFrame) -> DataFrame:
    """Quick and full hashes of rows with content, taken in the JVM."""
    return listing.select("dir_path", "name", "size", "mtime", quick_hash(F.col("content"), F.col("size")).alias("quick"), F.sha2("content", 256).alias("full_hash"))


def synthetic(spark: SparkSession, n: int, copies_every: int = 10) -> DataFrame:
    """A made-up listing of ``n`` files in year and month folders, seven kinds of names, every tenth a copy of the one before."""
    i = F.col("id")
    y, m = F.lit(2005) + i % 18, F.lit(1) + F.floor(i / 18) % 12
    stamp = F.format_string("%04d%02d%02d_%02d%02d%02d", y, m, F.lit(1) + i % 28, i % 24, i % 60, (i * 7) % 60)
    forms = [F.concat(F.lit("IMG_"), stamp), F.concat(F.lit("PXL_"), stamp, F.lit("123")), F.format_string("Screenshot_%04d-%02d-%02d-10-11-12", y, m, F.lit(1) + i % 28), F.format_string("VID-%04d%02d01-WA%04d", y, m, i % 10000), F.format_string("DSC_%04d", i % 10000), F.concat(F.lit("FB_IMG_"), (F.lit(1_500_000_000_000) + i).cast("string")), F.format_string("ảnh tết %d", i)]
    name = forms[-1]
    for k, f in enumerate(forms[:-1]):
        name = F.when(i % len(forms) == k, f).otherwise(name)
    ext = F.element_at(F.array(*map(F.lit, (IMAGE[0], IMAGE[2], VIDEO[0]))), (i % 3 + 1).cast("int"))
    body = F.when(i % copies_every == copies_every - 1, i - 1).otherwise(i)
    return spark.range(n).select(F.format_string("D:\\Corpus\\%04d\\%02d", y, m).alias("dir_path"), F.concat_ws(".", name, ext).alias("name"), (F.lit(64) + F.abs(F.hash(body)) % 192).cast("long").alias("size"), (F.lit(1_500_000_000_000) + i * 1000).alias("mtime"), F.lit(0).alias("attrs"), body.alias("content_of"))


def manifest(listing: DataFrame) -> DataFrame:
    """The sets of copies in a ``synthetic`` listing: (set, paths), numbered in the order of their content."""
    d = listing.groupBy("content_of").agg(F.array_sort(F.collect_list(F.concat_ws("\\", "dir_path", "name"))).alias("paths")).where(F.size("paths") > 1)
    return ranked(d, "content_of", name="set").select("set", "paths")
