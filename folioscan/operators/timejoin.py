"""Joins in time: the last row before each row (as-of), and intervals that overlap. No key's rows meet in one task.

As-of: a key's time is cut into runs. Inside a run the last right row is carried along by a window; what a run starts with is the last right row of the runs before it, found over one row for each run and
put in front of the run as a row of its own. Intervals: each lies in two bins at most of the level whose bins are as wide as it is long, and meets the other side on the coarser of both levels, so
an interval of any length is copied twice for each level of the other side, 64 times two at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(df: DataFrame, column: str) -> Column:
    return F.unix_micros(column) if df.schema[column].dataType.typeName() == "timestamp" else F.unix_micros(F.col(column).cast("timestamp")) if df.schema[column].dataType.typeName() == "timestamp_ntz" else F.col(column).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Sequence[str], tie: str, width: int) -> DataFrame:
    """left with the columns `take` of the last row of right with its key and a time not after its own; of equal times that with the greatest tie (not null). Null where there is none, where a key or
    a time is null. Times are timestamps or whole numbers; width: how long a run is, in microseconds or in that unit. take has no column of left."""
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    payload = F.struct(*[F.col(f"`{c}`") for c in take])
    run = lambda t: F.floor(t / F.lit(width)).cast("long")
    a = left.select(F.col(f"`{key}`").alias("k"), _micros(left, left_time).alias("t"), rows.alias("l"), F.lit(None).cast(_type(right, take)).alias("r"), F.lit(2).alias("kind"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"))
    b = right.select(F.col(f"`{key}`").cast(left.schema[key].dataType).alias("k"), _micros(right, right_time).alias("t"), payload.alias("r"), F.lit(1).alias("kind"), F.col(f"`{tie}`").alias("tie")).where("k is not null and t is not null")
    a, b = a.withColumn("run", run(F.col("t"))), b.withColumn("run", run(F.col("t")))
    placed = a.where("k is not null and t is not null")
    ends = b.groupBy("k", "run").agg(F.max_by("r", F.struct("t", "tie")).alias("r"))
    runs = placed.select("k", "run").distinct().select("k", "run", F.lit(None).cast(_type(right, take)).alias("r")).unionByName(ends).groupBy("k", "run").agg(F.first("r", ignorenulls=True).alias("r"))
    before = F.last("r", ignorenulls=True).over(Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    first = runs.select("k", "run", before.alias("r")).where("r is not null").withColumn("kind", F.lit(0))
    both = placed.unionByName(b, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    order = Window.partitionBy("k", "run").orderBy(F.col("t").asc_nulls_first(), "kind", F.col("tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("r", F.last("r", ignorenulls=True).over(order)).where("kind = 2").select("l", "r")
    return found.unionByName(a.where("k is null or t is null").select("l", "r")).select("l.*", "r.*")


def _type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ", ".join(f"`{c}`: {df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def overlapping(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows with one key whose intervals (both ends included) overlap: struct columns left and right. Intervals with a null end or the end before the start, and null keys, have none."""

    def prepared(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").alias("k"), _micros(df, ends[0]).alias("lo"), _micros(df, ends[1]).alias("hi"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
        return rows.where("k is not null and lo <= hi").withColumn("home", F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double"))).cast("int") + 1)

    a, b = prepared(left, left_ends, "left"), prepared(right, right_ends, "right")
    levels = [[r["home"] for r in side.select("home").distinct().collect()] for side in (a, b)]  # 65 at most
    if not all(levels):
        levels = [[1], [1]]

    def binned(df: DataFrame, others: list[int], name: str) -> DataFrame:
        met = F.array_distinct(F.transform(F.array(*map(F.lit, others)), lambda o: F.greatest(o, F.col("home"))))
        rows = df.withColumn("level", F.explode(met))
        return rows.select("k", "level", F.explode(F.expr("sequence(shiftright(lo, level), shiftright(hi, level))")).alias("bin"), *[F.col(c).alias(f"{name}_{c}") for c in ("lo", "hi", "home")], name)

    x, y = binned(a, levels[1], "left"), binned(b, levels[0], "right")
    once = (F.col("level") == F.greatest("left_home", "right_home")) & (F.col("bin") == F.expr("shiftright(greatest(left_lo, right_lo), level)"))
    return x.join(y, ["k", "level", "bin"]).where(once & (F.col("left_lo") <= F.col("right_hi")) & (F.col("right_lo") <= F.col("left_hi"))).select("left", "right")
