"""Approximate nearest neighbours: k-means cells as partitions of a store, probed by partition pruning, with copies near boundaries.

Every vector is in the store: once in its own cell (home) and, where another cell's centre is nearly as near, there, too. A search reads the cells that its queries probe and no others;
with all cells probed it reads each vector once and is exact. Cells are trained on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import clusters, search

#: Cells at most, so that centres stay some MB; larger stores have larger cells.
MOST_CELLS = 4096


def _assigned(centroids: np.ndarray, margin: float):
    """Batches (page_ord, vec) to (page_ord, vec, home, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                far = np.sqrt(clusters.squared_distances(search.rectangle(part.column(1), centroids.shape[1]), centroids))
                order = np.argsort(far, axis=1, kind="stable")[:, :2]
                rows = np.arange(len(far))
                copied = rows[far[rows, order[:, -1]] <= (1 + margin) * far[rows, order[:, 0]]] if order.shape[1] > 1 else rows[:0]
                take = pa.array(np.concatenate([rows, copied]))
                home = np.concatenate([np.ones(len(rows), bool), np.zeros(len(copied), bool)])
                cell = np.concatenate([order[:, 0], order[copied, -1]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(home), pa.array(cell)], names=["page_ord", "vec", "home", "cell"])

    return run


def _chosen(matrix: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The cells that each query probes: those whose centres are nearest."""
    return np.argsort(clusters.squared_distances(matrix, centroids), axis=1, kind="stable")[:, :probes]


class _CellTopK(search._TopK):
    """The best pages of each query in the cells that it probes; a batch's token is its cell."""

    def __init__(self, k: int, centroids: np.ndarray, probes: int, *queries: np.ndarray):
        super().__init__(k, *queries)
        self.wants = np.zeros((len(self.names), len(centroids)), bool)
        np.put_along_axis(self.wants, _chosen(self.matrix, centroids, probes), True, axis=1)

    def take(self, batch):
        cells = batch.column(2).to_numpy()
        for cell in np.unique(cells):
            rows, asked = np.flatnonzero(cells == cell), np.flatnonzero(self.wants[:, cell])
            for at in range(0, len(rows) if len(asked) else 0, search.PAGES_AT_ONCE):
                part = pa.array(rows[at : at + search.PAGES_AT_ONCE])
                vectors = search.rectangle(batch.column(1).take(part), self.matrix.shape[1])
                pages = batch.column(0).take(part).to_numpy()
                for first in range(0, len(asked), search.QUERIES_AT_ONCE):
                    own = asked[first : first + search.QUERIES_AT_ONCE]
                    self.merge(own, pages, np.round(self.matrix[own] @ vectors.T, search.PLACES))
        return iter(())


@dataclass(frozen=True)
class IvfIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def build(pages: DataFrame, path: str, cells: int | None = None, margin: float = 0.05, sample: int = clusters.SAMPLE) -> IvfIndex:
        """Writes pages (page_ord, unit_vec) to path. cells: the square root of their number by default. margin: a vector is copied to the second nearest cell if
        that is at most so much farther."""
        spark = pages.sparkSession
        cells = min(MOST_CELLS, max(1, cells or round(pages.count() ** 0.5)))
        clusters.trained(clusters.sampled(pages, "unit_vec", sample), cells).write.mode("overwrite").parquet(f"{path}/centroids")
        index = IvfIndex(spark, path)
        rows = pages.select(F.col("page_ord").cast("long").alias("page_ord"), F.col("unit_vec").cast("array<double>").alias("vec"))
        placed = rows.mapInArrow(_assigned(index.centroids(), margin), "page_ord long, vec array<double>, home boolean, cell int")
        placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        return index

    def centroids(self) -> np.ndarray:
        return clusters.collected(self.spark.read.parquet(f"{self.path}/centroids"))[0]

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema("page_ord long, vec array<double>, home boolean, cell int").parquet(f"{self.path}/vectors")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """The stored vectors that a search of queries (query_id, unit_vec) reads: those of the cells that any of them probes."""
        centroids = self.centroids()
        if probes >= len(centroids):
            return self._vectors().where("home")

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.unique(_chosen(search.rectangle(batch.column(0), centroids.shape[1]), centroids, probes))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["cell"])

        doubles = queries.select(F.col("unit_vec").cast("array<double>"))
        names = [r["cell"] for r in doubles.mapInArrow(wanted, "cell int").distinct().collect()]  # cells, so MOST_CELLS at most
        return self._vectors().where(F.col("cell").isin(names))

    def search(self, queries: DataFrame, k: int = 3, probes: int = 8) -> DataFrame:
        """(query_id, rank, page_ord, similarity) over the probes nearest cells of each query."""
        if k <= 0 or probes <= 0:
            raise ValueError("k and probes have to be positive")
        centroids = self.centroids()
        pages = self.probed(queries, probes).select("page_ord", "vec", F.col("cell").alias("token"))
        asked = queries.select("query_id", F.lit(0).alias("token"), F.col("unit_vec").cast("array<double>").alias("vec"))
        held = k if probes >= len(centroids) else 2 * k  # a page and its copy may both be among a task's best
        found = search.met(pages, asked, lambda *q: _CellTopK(held, centroids, probes, *q), "query_id long, page_ord long, similarity double")
        return search.best(found.groupBy("query_id", "page_ord").agg(F.max("similarity").alias("similarity")), k)

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the exact k best pages that a search with so many probes finds."""
        exact = self.search(queries, k, MOST_CELLS).select("query_id", "page_ord")
        row = exact.join(self.search(queries, k, probes).select("query_id", "page_ord", F.lit(1).alias("hit")), ["query_id", "page_ord"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()
        return 1.0 if row[0] is None else float(row[0])

    def calibrate(self, k: int = 10, least: float = 0.9, n_queries: int = 256) -> int:
        """The probes that reach a recall of least on n_queries stored vectors (those of the least hash), in steps of a quarter."""
        asked = self._vectors().where("home").select(F.col("page_ord").alias("query_id"), F.col("vec").alias("unit_vec")).orderBy(F.xxhash64("page_ord")).limit(n_queries)
        asked = self.spark.createDataFrame(asked.collect(), asked.schema)
        probes, n = 1, len(self.centroids())
        while probes < n and self.recall(asked, k, probes) < least:
            probes = max(probes + 1, probes * 5 // 4)
        return min(probes, n)
