"""Row numbers over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import stored


def ranked(d: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``d`` with ``name``: the number of the row, from 1, in ascending order (nulls first).

    Ranges of the order are sorted and numbered side by side; a prefix sum over one count for each range gives where they
    begin. Ties are numbered as they come: make the order unique where that matters. The ranges are written to the
    shared folder first, so that counts and numbers see the same ones even if a task is run again.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = stored(d.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    # a row for each range: never more than there are shuffle partitions
    return parts.join(F.broadcast(starts), "__part").withColumn(name, (within + F.col("__before")).cast("long")).drop("__part", "__before")
