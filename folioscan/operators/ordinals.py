"""Numbering and running sums that don't bring a key's rows, or all rows, to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that one window partition covers.
WIDTH = 1 << 16


def numbered(df: DataFrame, key: str, order: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with out: the 1-based place of each row in its key by an integer order column (unique in the key).

    Rows are numbered inside runs of order values, and runs get their offset from a window over counts, which are 1/width as many.
    """
    run = F.floor(F.col(order) / width)
    counts = df.groupBy(F.col(key).alias("__k"), run.alias("__r")).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__k").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = df.withColumn("__run", run).withColumn("__i", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)))
    joined = inside.join(offsets, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r")))
    return joined.withColumn(out, (F.col("__before") + F.col("__i")).cast("int")).drop("__run", "__i", "__k", "__r", "__before")


def running_sum(df: DataFrame, order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with out: the sum of value over rows up to this one by an integer order column (unique)."""
    run = F.floor(F.col(order) / width)
    sums = df.groupBy(run.alias("__r")).agg(F.sum(value).alias("__s"))
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = df.withColumn("__run", run).withColumn("__i", F.sum(value).over(Window.partitionBy("__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(offsets, F.col("__run") == F.col("__r")).withColumn(out, F.col("__before") + F.col("__i")).drop("__run", "__i", "__r", "__before")
