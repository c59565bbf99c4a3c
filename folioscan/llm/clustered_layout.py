"""A multidimensional clustered layout: rows in z-order of rank coordinates, cut into files, and a packed R-tree that says which files a box query has to read.

A value's coordinate is its rank's share of 2**bits, so any column that sorts will do. A dimension's coordinates are 2**bits - 1 thresholds at most, found with running counts over its
distinct values in ranges; rows get theirs from constants. Rows are sorted by (z, id) in ranges, and a position is a range's offset plus the place in it.

Everything but the rows follows from the rows' number in each cell, 2**(bits * dimensions) numbers at most (65,536 for four dimensions of four bits), however many rows there are.
Files of a single cell are one leaf with their number, and every other file holds a boundary between cells; so the tree has at most twice as many leaves as there are cells,
and only it is broadcast.

Null values are least, as are null ids; equal rows (repeated ids in a cell) lie next to one another in the order of the input. Extra columns are passed over unless `keep` names them.
An empty table gives an empty result. Long values cost what Spark's sort of them costs; thresholds travel with the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscan.llm.common import Scratch, configured, partitions

#: Children of a node.
FAN = 16
#: Query cells that are probed at once.
PROBES = 512


@dataclass(frozen=True)
class Dimension:
    """A column to lay out by: a string or an integer. A query reaches so many coordinates to both sides."""

    name: str
    value: Column
    reach: int = 0
    text: bool = False


def thresholds(values: DataFrame, dims: Sequence[Dimension], bits: int, scratch: Scratch) -> list[list[tuple[int, object]]]:
    """For each dimension (coordinate, its least value), ascending, without coordinate 0. values: the columns d0, d1, ..."""
    each = [F.struct(F.lit(i).alias("dim"), (F.col(f"d{i}") if d.text else F.lit(None)).cast("string").alias("s"), (F.lit(None) if d.text else F.col(f"d{i}")).cast("long").alias("n")) for i, d in enumerate(dims)]
    counts = values.select(F.explode(F.array(*each)).alias("v")).select("v.*").groupBy("dim", "s", "n").agg(F.count("*").alias("c"))
    order = ["dim", F.col("s").asc_nulls_first(), F.col("n").asc_nulls_first()]
    spread = counts.repartitionByRange(partitions(values.sparkSession), *order).sortWithinPartitions(*order)
    runs = scratch.table(spread.withColumn("at", F.monotonically_increasing_id()), "values").withColumn("run", F.shiftright("at", 33))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("run", "dim").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = runs.groupBy("dim", "run").agg(F.sum("c").alias("total"))  # a row for each range
    offset = F.coalesce(F.sum("total").over(Window.partitionBy("dim").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("dim", "run", offset.alias("offset"))
    n = values.count()
    smaller = runs.withColumn("before", before).join(F.broadcast(offsets), ["dim", "run"]).select("dim", "s", "n", (F.col("before") + F.col("offset")).alias("smaller"))
    coordinate = F.expr(f"smaller * {1 << bits} div {max(n, 1)}")
    rows = smaller.groupBy("dim", coordinate.alias("c")).agg(F.min("s").alias("s"), F.min("n").alias("n")).where("c > 0").collect()  # 2**bits - 1 for each dimension at most
    return [sorted((r["c"], r["s"] if d.text else r["n"]) for r in rows if r["dim"] == i) for i, d in enumerate(dims)]


def _coordinate(value: Column, steps: list[tuple[int, object]]) -> Column:
    found = None
    for c, least in reversed(steps):
        found = F.when(value >= F.lit(least), F.lit(c)) if found is None else found.when(value >= F.lit(least), F.lit(c))
    return F.lit(0) if found is None else found.otherwise(F.lit(0))


def _z(coordinates: list[Column], bits: int) -> Column:
    z = F.lit(0).cast("long")
    for b in reversed(range(bits)):
        for c in coordinates:
            z = z * 2 + F.shiftright(c, b).bitwiseAND(1)
    return z


def _cell_coordinates(z: np.ndarray, n_dims: int, bits: int) -> np.ndarray:
    out = np.zeros((len(z), n_dims), np.int64)
    for b in range(bits):
        for d in range(n_dims):
            out[:, d] |= ((z >> (n_dims * b + n_dims - 1 - d)) & 1) << b
    return out


class PackedTree:
    """Bulk-loaded over files in z-order. cells: the z of cells that have rows, ascending; counts: their rows."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, rows_per_file: int, n_dims: int, bits: int):
        self.n_dims, self.bits = n_dims, bits
        self.points = _cell_coordinates(cells, n_dims, bits)
        end = np.cumsum(counts)
        begin, n, size = end - counts, int(counts.sum()), rows_per_file
        files = -(-n // size)
        whole = -(-begin // size)
        alone = np.maximum(np.where(end < n, end // size, files) - whole, 0)
        single = np.flatnonzero(alone)
        mixed = np.unique(begin[begin % size != 0] // size)
        first = np.searchsorted(end, mixed * size, "right")
        last = np.searchsorted(begin, np.minimum((mixed + 1) * size, n), "left")
        leaf_file = np.concatenate([whole[single], mixed])
        order = np.argsort(leaf_file)
        self.file, self.files = leaf_file[order], np.concatenate([alone[single], np.ones(len(mixed), np.int64)])[order]
        self.first, self.last = np.concatenate([single, first])[order], np.concatenate([single + 1, last])[order]
        self.levels = []
        if len(order):
            cuts = np.column_stack([self.first, self.last]).ravel()
            padded = np.vstack([self.points, self.points[-1:]])
            low, high = np.minimum.reduceat(padded, cuts)[::2], np.maximum.reduceat(padded, cuts)[::2]
            self.levels.append((low, high))
            while len(low) > 1:
                at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
                self.levels.append((low, high))

    def probe(self, z: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query cell: the files whose bounds meet its box, and the files with a row in it."""
        touched, matching = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
        middle = _cell_coordinates(z, self.n_dims, self.bits)
        low, high = middle - reach, middle + reach
        q, node = np.arange(len(z)), np.zeros(len(z), np.int64)
        for depth in reversed(range(len(self.levels))):
            node_low, node_high = self.levels[depth]
            meets = ((node_low[node] <= high[q]) & (node_high[node] >= low[q])).all(axis=1)
            q, node = q[meets], node[meets]
            if depth:
                width = np.minimum((node + 1) * FAN, len(self.levels[depth - 1][0])) - node * FAN
                node = np.repeat(node * FAN, width) + _within(width)
                q = np.repeat(q, width)
        np.add.at(touched, q, self.files[node])
        width = self.last[node] - self.first[node]
        cell = np.repeat(self.first[node], width) + _within(width)
        asked = np.repeat(q, width)
        inside = ((self.points[cell] >= low[asked]) & (self.points[cell] <= high[asked])).all(axis=1)
        if len(width):
            hit = np.logical_or.reduceat(inside, np.cumsum(width) - width)
            np.add.at(matching, q[hit], self.files[node[hit]])
        return touched, matching

    def leaf_of(self, file: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.file, file, "right") - 1

    def bounds(self, leaf: int) -> list[int]:
        low, high = self.levels[0]
        return [int(x) for pair in zip(low[leaf], high[leaf], strict=True) for x in pair]

    def files_meeting(self, low: Sequence[int], high: Sequence[int]) -> list[tuple[int, int]]:
        """(first file, number of files) of the leaves whose bounds meet a box."""
        if not self.levels:
            return []
        meets = ((self.levels[0][0] <= np.array(high)) & (self.levels[0][1] >= np.array(low))).all(axis=1)
        return [(int(a), int(b)) for a, b in zip(self.file[meets], self.files[meets], strict=True)]


def _within(width: np.ndarray) -> np.ndarray:
    """0 to w - 1 for each w."""
    total = int(width.sum())
    return np.arange(total) - np.repeat(np.cumsum(width) - width, width)


def _probes(tree, reach: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), PROBES):
                z = b["z"].to_numpy()[at : at + PROBES]
                touched, matching = tree.value.probe(z, reach)
                yield pd.DataFrame({"z": z, "files_touched": touched, "files_matching": matching})

    return run


def _bounds(tree):
    """Rows with their file's bounds; file is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, back = np.unique(b.column(b.num_columns - 1).to_numpy(), return_inverse=True)
            names = pa.array([",".join(map(str, tree.value.bounds(leaf))) for leaf in tree.value.leaf_of(files)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names.take(pa.array(back))], names=[*b.schema.names, "file_bounds"])

    return run


@dataclass
class Layout:
    """rows: the id, kept columns, z, position and file of each row, in the order of the files; the tree over the files; the dimensions' thresholds."""

    spark: SparkSession
    rows: DataFrame
    tree: PackedTree
    dims: Sequence[Dimension]
    steps: list[list[tuple[int, object]]]
    id_col: str

    def with_queries(self) -> DataFrame:
        """Each row with the query of its own cell: files_touched, files_matching; and its file's bounds. Each cell is probed once."""
        tree = self.spark.sparkContext.broadcast(self.tree)
        reach = np.array([d.reach for d in self.dims])
        probed = self.rows.select("z").distinct().mapInPandas(_probes(tree, reach), "z long, files_touched long, files_matching long")
        found = self.rows.join(F.broadcast(probed), "z")  # a row a cell
        order = [*[c for c in self.rows.columns if c != "file"], "files_touched", "files_matching", "file"]
        found = found.select(*order)
        return found.mapInArrow(_bounds(tree), StructType([*found.schema.fields, StructField("file_bounds", StringType())]))

    def files_for(self, low: Sequence[object], high: Sequence[object]) -> list[tuple[int, int]]:
        """(first file, number of files) that can hold rows with values between low and high in each dimension; None: open."""
        ends = (1 << self.tree.bits) - 1
        a = [0 if v is None else max([0, *(c for c, least in s if least <= v)]) for v, s in zip(low, self.steps, strict=True)]
        b = [ends if v is None else max([0, *(c for c, least in s if least <= v)]) for v, s in zip(high, self.steps, strict=True)]
        return self.tree.files_meeting(a, b)

    def write(self, path: str) -> None:
        """The rows as Parquet, one folder file=... for each file, each written by one task."""
        spread = self.rows.repartitionByRange(partitions(self.spark), "file").sortWithinPartitions("file", "position")
        spread.write.mode("overwrite").partitionBy("file").parquet(path)

    def read(self, path: str, low: Sequence[object], high: Sequence[object]) -> DataFrame:
        """The rows written to path with values between low and high (both included; None: open): only files that the tree names are listed and read."""
        wanted = F.lit(False)
        for first, n in self.files_for(low, high):
            wanted = wanted | F.col("file").between(first, first + n - 1)
        rows = self.spark.read.parquet(path).where(wanted)
        for d, a, b in zip(self.dims, low, high, strict=True):
            rows = rows if a is None else rows.where(d.value >= F.lit(a))
            rows = rows if b is None else rows.where(d.value <= F.lit(b))
        return rows


def layout(docs: DataFrame, dims: Sequence[Dimension], id_col: str = "doc_id", bits: int = 4, rows_per_file: int = 1000, keep: Sequence[str] = ()) -> Layout:
    """Lays docs out by dims. keep: columns of docs that move with the rows, such as those which the dimensions read, to be written."""
    if not 0 < bits * len(dims) <= 20:
        raise ValueError("bits times dimensions has to be between 1 and 20")
    spark = configured(docs)
    scratch = Scratch(spark, "layout")
    kept = [c for c in keep if c != id_col]
    values = [d.value.cast("string" if d.text else "long").alias(f"d{i}") for i, d in enumerate(dims)]
    narrow = scratch.table(docs.select(F.col(f"`{id_col}`").alias("id"), *values, *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("entry")), "values-of-rows")
    steps = thresholds(narrow, dims, bits, scratch)
    z = _z([_coordinate(F.col(f"d{i}"), s) for i, s in enumerate(steps)], bits)
    kept_now = [f"k{i}" for i in range(len(kept))]
    placed = narrow.select("id", *kept_now, z.alias("z"), "entry").orderBy("z", F.col("id").asc_nulls_first(), "entry")
    placed = scratch.table(placed.select("id", *kept_now, "z", F.monotonically_increasing_id().alias("at")), "sorted").withColumn("run", F.shiftright("at", 33))
    cells = placed.groupBy("z").agg(F.count("*").alias("n")).toArrow().sort_by("z")  # a row a cell, 2**(bits * dimensions) at most
    tree = PackedTree(cells["z"].to_numpy(), cells["n"].to_numpy(), rows_per_file, len(dims), bits)
    totals = placed.groupBy("run").agg(F.count("*").alias("total"))  # a row for each range
    offsets = totals.select("run", F.coalesce(F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    position = (F.col("offset") + F.col("at") - F.shiftleft("run", 33)).cast("long")
    rows = placed.join(F.broadcast(offsets), "run").select(F.col("id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(kept_now, kept, strict=True)], "z", position.alias("position"))
    return Layout(spark, rows.withColumn("file", F.expr(f"position div {rows_per_file}")), tree, dims, steps, id_col)
