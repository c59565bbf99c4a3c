"""Vector expressions over array columns, in double precision, and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(vec: Column | str) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; raises where the lengths differ, null where a side is null."""
    product = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double")))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + x * x))


def unit(vec: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    norm = l2_norm(vec)
    return F.when(norm > 0, F.transform(as_double(vec), lambda x: x / norm)).otherwise(as_double(vec))


def is_sound(vec: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def mean_long(patches: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, dim, mean): the mean of all patches of a key per dimension; partial sums combine before the shuffle."""
    return patches.select(key, F.posexplode(as_double(vec)).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("mean"))


def mean_pool(patches: DataFrame, key: str, vec: str = "vec", out: str = "vec") -> DataFrame:
    """(key, out): one mean vector per key. Ragged patch counts are fine; all rows count, padding too."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return mean_long(patches, key, vec).groupBy(key).agg(F.transform(ordered, lambda s: s["mean"]).alias(out))
