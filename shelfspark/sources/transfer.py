"""Export and import of an index, plan files, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 7


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables of an index side by side; a folder that is there already is refused."""
    for name, d in tables.items():
        d.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([("version", str(VERSION))], "key string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/kv.parquet")


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """One row: version, files, root paths in order, and whether this library reads that version."""
    v = spark.read.parquet(f"{folder}/kv.parquet").where("key = 'version'").agg(F.max(F.col("value").try_cast("int")).alias("version"))
    n = spark.read.parquet(f"{folder}/files.parquet").agg(F.count("*").alias("files"))
    r = spark.read.parquet(f"{folder}/roots.parquet").agg(F.array_sort(F.collect_list("path")).alias("roots"))
    return v.crossJoin(n).crossJoin(r).withColumn("compatible", F.coalesce(F.col("version").between(1, VERSION), F.lit(False)))


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of an exported index; one of a newer version is refused."""
    if not inspect(spark, folder).first()["compatible"]:
        raise ValueError("ERR_SCHEMA_NEWER")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


STAGED, BACKUP = ".incoming", ".bak"


def apply_import(spark: SparkSession, folder: str) -> bool:
    """Put a staged import (index.incoming, perhaps thumbs.incoming) in the place of the live one; False if there is none.

    What was live is kept for one generation (index.bak). Without staged thumbs the live ones go, as they are of other files.
    """
    jvm = spark._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path("index" + STAGED)):
        return False
    for name in ("index", "thumbs"):
        if not fs.exists(path(name + STAGED)):
            fs.delete(path(name), True)
            continue
        if fs.exists(path(name)):
            fs.delete(path(name + BACKUP), True)
            if not fs.rename(path(name), path(name + BACKUP)):
                raise OSError(f"ERR_IMPORT_SWAP|{name}")
        if not fs.rename(path(name + STAGED), path(name)):
            raise OSError(f"ERR_IMPORT_SWAP|{name}")
    return True


def write_plan(planned: DataFrame, folder: str) -> None:
    """The executable rows of a plan as JSON lines."""
    planned.where(F.col("action").isin("RENAME", "COPY_VERIFY") | F.col("pair_new_path").isNotNull()).write.mode("errorifexists").json(folder)


def read_plan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id long, action string, new_path string, pair_new_path string").json(folder)


def setting(kv: DataFrame, key: str, kind: str = "string") -> DataFrame:
    """The value of a setting, parsed if ``kind`` is more than a string (excluded paths are 'array<string>')."""
    value = F.col("value") if kind == "string" else F.from_json("value", kind)
    return kv.where(F.col("key") == key).select(value.alias("value"))


def with_setting(kv: DataFrame, key: str, value: object) -> DataFrame:
    """Settings with one put in or replaced; lists become JSON."""
    spark = kv.sparkSession
    if isinstance(value, list):
        new = spark.createDataFrame([(key, value)], "key string, v array<string>").select("key", F.to_json("v").alias("value"))
    else:
        new = spark.createDataFrame([(key, str(value))], "key string, value string")
    return kv.where(F.col("key") != key).select("key", "value").unionByName(new)


def next_generation(kv: DataFrame) -> DataFrame:
    """The number of the next scan."""
    return kv.where("key = 'scan_gen'").agg((F.coalesce(F.max(F.col("value").try_cast("long")), F.lit(0)) + 1).alias("gen"))
