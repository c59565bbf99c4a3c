"""Product quantisation with exact results: codes apart from vectors, lookup-table scores with error bounds, a second read by id.

A vector's code is the nearest codeword of each part, and beside it stands how far it lies from what its code says. A query's score lies within |query| times that of the sum of its
tables' entries, so every page whose greatest score reaches the k-th least score is read exactly, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.vectors import dot
from folioscan.operators import clusters, search

LEVELS = 256
#: What float32 and the tables' sums may be off by.
SLACK = 1e-5


class Codebook:
    """parts matrices of up to LEVELS codewords each."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.width = words[0].shape[1]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors)"""
        w = self.width
        codes = np.column_stack([clusters.nearest(vectors[:, i * w : (i + 1) * w], words) for i, words in enumerate(self.words)]).astype(np.uint8)
        return codes, np.sqrt(((vectors - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([words[codes[:, i]] for i, words in enumerate(self.words)], axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part the products of every query with every codeword."""
        w = self.width
        return [queries[:, i * w : (i + 1) * w] @ words.T for i, words in enumerate(self.words)]

    @staticmethod
    def scores(tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        found = tables[0][:, codes[:, 0]]
        for i, table in enumerate(tables[1:], 1):
            found += table[:, codes[:, i]]
        return found


def trained(vectors: DataFrame, vec: str, parts: int | None, sample: int) -> DataFrame:
    """Codewords (part, cell, centroid) of two dimensions each by default."""
    rows = clusters.sampled(vectors, vec, sample)
    dim = vectors.select(F.size(vec).alias("n")).first()["n"]
    parts = parts or max(1, dim // 2)
    if dim % parts:
        raise ValueError("parts have to divide the dimension")
    return clusters.trained(rows, LEVELS, parts)


def encoded(book: Codebook):
    """Batches (..., vec) to (..., code, err)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes, err = book.encode(search.rectangle(part.column(part.num_columns - 1), book.width * len(book.words)))
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err * (1 + SLACK) + SLACK)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "code", "err"])

    return run


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _bounded(book: Codebook, names: np.ndarray, matrix: np.ndarray, k: int):
    """Batches (page_ord, code, err) to (query_id, page_ord, low, high) of pages that may be among a query's k best, as far as the task has seen."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes, err, pages = bytes_of(part.column(1), len(book.words)), part.column(2).to_numpy(), part.column(0).to_numpy()
                for first in range(0, len(names), 256):
                    rows = slice(first, first + 256)  # tables of 256 queries at once, so that they stay some MB
                    found = book.scores(book.tables(matrix[rows]), codes)
                    room = norms[rows, None] * err
                    low = found - room
                    best[rows] = np.sort(np.partition(np.concatenate([best[rows], low], axis=1), -k, axis=1)[:, -k:], axis=1)
                    q, p = np.nonzero(found + room >= best[rows, :1])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[q + first]), pa.array(pages[p]), pa.array(low[q, p]), pa.array((found + room)[q, p])], names=["query_id", "page_ord", "low", "high"])

    return run


@dataclass(frozen=True)
class CodeIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def build(pages: DataFrame, path: str, parts: int | None = None, sample: int = clusters.SAMPLE) -> CodeIndex:
        """Writes pages (page_ord, unit_vec): codebooks, codes, and vectors in ranges of page_ord."""
        trained(pages, "unit_vec", parts, sample).write.mode("overwrite").parquet(f"{path}/codebooks")
        index = CodeIndex(pages.sparkSession, path)
        rows = pages.select(F.col("page_ord").cast("long").alias("page_ord"), F.col("unit_vec").cast("array<double>").alias("vec"))
        rows.mapInArrow(encoded(index.codebook()), "page_ord long, code binary, err double").write.mode("overwrite").parquet(f"{path}/codes")
        rows.repartitionByRange("page_ord").sortWithinPartitions("page_ord").write.mode("overwrite").parquet(f"{path}/vectors")
        return index

    def codebook(self) -> Codebook:
        return Codebook(clusters.collected(self.spark.read.parquet(f"{self.path}/codebooks")))

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, page_ord) of pages that the codes don't exclude from a query's k best. Queries travel to the codes in blocks of search.BLOCK_BYTES."""
        book, found = self.codebook(), self.spark.createDataFrame([], "query_id long, page_ord long, low double, high double")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("unit_vec").cast("array<double>").alias("vec"))
        size = asked.agg(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0
        blocks = -(-size // search.BLOCK_BYTES)
        codes = self.spark.read.parquet(f"{self.path}/codes").select("page_ord", "code", "err")
        for b in range(blocks):
            rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            if rows:
                names, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
                found = found.unionByName(codes.mapInArrow(_bounded(book, names, matrix, k), found.schema))
        order = Window.partitionBy("query_id").orderBy(F.col("low").desc())
        least = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
        kept = found.join(least, "query_id").where((F.col("n") < k) | (F.col("high") >= F.col("least")))
        return kept.select("query_id", "page_ord")

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """(query_id, rank, page_ord, similarity), exact."""
        if k <= 0:
            raise ValueError("k has to be positive")
        vectors = self.spark.read.parquet(f"{self.path}/vectors")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("unit_vec").cast("array<double>").alias("q"))
        rows = self.candidates(queries, k).join(vectors, "page_ord").join(asked, "query_id")
        return search.best(rows.select("query_id", "page_ord", F.round(dot(F.col("q"), F.col("vec")), search.PLACES).alias("similarity")), k)
