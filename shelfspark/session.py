"""Session helpers: the package on the workers, the shared folder, tables written once."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shelfspark-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "shelfspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._shelfspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        if base.isDefined():
            base = base.get()
        elif sc.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        else:
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The files go when the application ends, or before with ``drop_stored``.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by ``stored``."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
