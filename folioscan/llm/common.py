"""Shared plumbing: written tables that cut lineage, stream helpers and integer mixing."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import scratch
from folioscan.scratch import checkpoint_dir  # noqa: F401

U64 = np.uint64
#: A join side is broadcast only when a count has shown it to hold at most so many narrow rows.
BROADCAST_ROWS = 500_000
#: What operators set on a session that doesn't set it itself: small Arrow batches, as several copies of one are held on both sides, and shuffle files that
#: go with the query which wrote them, as a written table takes their place.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _lean() -> None:
    """Lets freed arrays of some MB go back to the system at once: workers are reused from stage to stage."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)
        pa.set_memory_pool(pa.system_memory_pool())


_lean()


def configured(df: DataFrame) -> SparkSession:
    """The session of df, with SETTINGS where it has none of its own."""
    spark = df.sparkSession
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


class Scratch(scratch.Scratch):
    """Scratch tables written under SETTINGS."""

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        configured(df)
        return super().table(df, name, rows)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hints a broadcast only for a side counted to be at most BROADCAST_ROWS rows; otherwise a shuffle join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_by_degree(rows: DataFrame, table: DataFrame, on: list[str], degree: str, n_rows: int, written: Scratch, hot: int = 512, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) on `on` with table, which has one row a key; table's column `degree` is the number of rows with that key and goes.

    Keys of over `most` rows, n_rows / most of them at most, are broadcast: that number is bounded by BROADCAST_ROWS, and none of their rows moves. No other
    key has more than `most` rows for its task.
    """
    most = max(hot, -(-n_rows // BROADCAST_ROWS))
    if n_rows <= most:
        return rows.join(table.drop(degree), on, how)
    busy = written.table(table.where(F.col(degree) > most).drop(degree), "hot", n_rows)
    rest = table.where(F.col(degree) <= most).drop(degree)
    if busy.isEmpty():
        return rows.join(rest, on, how)
    return rows.join(F.broadcast(busy), on).unionByName(rows.join(F.broadcast(busy.select(*on)), on, "left_anti").join(rest, on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
