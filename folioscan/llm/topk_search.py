"""Exact top-k search by inner product with vector approximations.

Every vector has an approximation: for each dimension the cell of a grid, one byte. Queries come in slices of bounded size,
which every task holds; a task scans its approximations for upper bounds of the scores, then reads exact vectors in descending order
of that bound until the k-th best score found exceeds every bound left. What each task is sure of (k rows per query) goes
through one shuffle to the final k, with map-side selection.

Grid: per dimension, the range of the whole table in equal cells, from one aggregate pass. Scores are integer inner products
of floor(scale * component). Lists of different length never meet. Vectors that are null, empty or hold null or
non-finite components take no part, nor do rows with a null id. Repeated rows are candidates each; a query id that occurs twice counts as the
queries it has (its rows compete under the one id), and a query's candidates are rows with another id. Ties go to the smaller id. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch
from folioscan.llm.vectors import matrices

#: Queries in one slice at most: what the driver gathers and each task holds (8 MB at 128 dimensions).
QUERY_SLICE = 8192
#: Rows whose bounds are computed at once.
ROWS = 2048
CELLS = 256


def _ranges(scale: float):
    """Per length of the lists: least and greatest scaled component of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in matrices(batch.column(0)):
                m, n = np.floor(scale * m), m.shape[1]
                low[n] = np.minimum(low.get(n, np.inf), m.min(axis=0))
                high[n] = np.maximum(high.get(n, -np.inf), m.max(axis=0))
        rows = [(n, d, float(low[n][d]), float(high[n][d])) for n in low for d in range(n)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=["n", "d", "low", "high"])

    return run


def _approximate(scale: float, grid: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Batches (id, vector) to (id, n, cells, exact): one byte per dimension, and the scaled vector as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0))
            for rows, m in matrices(batch.column(1)):
                m = np.floor(scale * m)
                low, step = grid[m.shape[1]]
                cells = np.clip((m - low) // step, 0, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), m.shape[1], np.int32)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "n", "cells", "exact"])

    return run


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _scan(queries, grid, k: int):
    """Streams (id, n, cells, exact) against the slice of queries: {n: (query ids, matrix)}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = queries.value
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [(np.zeros(0), np.zeros(0, np.int64))] * len(q[0]) for n, q in slice_.items()}
        sure = {n: np.full(len(q[0]), -np.inf) for n, q in slice_.items()}
        for batch in batches:
            all_ids, all_n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for n in np.unique(all_n).tolist():
                if n not in slice_:
                    continue
                query_ids, q = slice_[n]
                low, step = grid[n]
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                rows_n = np.flatnonzero(all_n == n)
                for at in range(0, len(rows_n), ROWS):
                    rows = rows_n[at : at + ROWS]
                    ids = all_ids[rows]
                    cells = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), dtype=np.uint8).reshape(len(rows), n)
                    # Components are whole numbers, so a cell's last is step - 1 above its first.
                    floor = low + cells * step
                    for first in range(0, len(q), 1024):
                        own = slice(first, min(first + 1024, len(q)))
                        bound = up[own] @ (floor + step - 1).T + down[own] @ floor.T
                        bound[query_ids[own][:, None] == ids[None, :]] = -np.inf
                        for i in np.flatnonzero(bound.max(axis=1) >= sure[n][own]).tolist():
                            at_query = first + i
                            order = np.flatnonzero(bound[i] >= max(sure[n][at_query], np.finfo(float).min))
                            order = order[np.argsort(-bound[i][order], kind="stable")]
                            scores, found = best[n][at_query]
                            for start in range(0, len(order), 32):
                                part = order[start : start + 32]
                                if bound[i][part[0]] < sure[n][at_query]:
                                    break
                                exact = np.frombuffer(b"".join(batch.column(3).take(pa.array(rows[part])).to_pylist())).reshape(len(part), n)
                                scores, found = np.concatenate([scores, exact @ q[at_query]]), np.concatenate([found, ids[part]])
                                top = _better(scores, found, k)
                                scores, found = scores[top], found[top]
                                if len(scores) == k:
                                    sure[n][at_query] = scores[-1]
                            best[n][at_query] = (scores, found)
        for n, (query_ids, _) in slice_.items():
            for first in range(0, len(query_ids), 1024):
                part = best[n][first : first + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids[first : first + 1024], [len(s) for s, _ in part])), pa.array(np.concatenate([f for _, f in part])), pa.array(np.concatenate([s for s, _ in part]).astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def _read_slice(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for r in rows:
        ids, vectors = out.setdefault(r["n"], ([], []))
        ids.append(r["id"])
        vectors.append(np.frombuffer(r["exact"]))
    return {n: (np.array(ids, dtype=np.int64), np.vstack(vectors)) for n, (ids, vectors) in out.items()}


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_slice: int = QUERY_SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that the column is_query picks.

    Exact up to sums of 2**53. Work is queries times rows, as exact search has to be; memory is a slice of queries and one
    batch of rows for each task. A table with q queries is scanned ceil(q / query_slice) times.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    plain = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    spans = plain.select("vector").mapInArrow(_ranges(scale), "n int, d int, low double, high double").groupBy("n", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("n", "d").collect()
    grid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {r["n"] for r in spans}:
        low = np.array([r["low"] for r in spans if r["n"] == n])
        high = np.array([r["high"] for r in spans if r["n"] == n])
        grid[n] = (low, np.maximum(1.0, np.ceil((high - low + 1) / CELLS)))
    approximated = scratch.table(plain.select("id", "vector").mapInArrow(_approximate(scale, grid), "id long, n int, cells binary, exact binary"), "approximations")
    asked = scratch.table(plain.where("query").select("id", "vector").mapInArrow(_approximate(scale, grid), "id long, n int, cells binary, exact binary").select("id", "n", "exact"), "queries")
    total = asked.count()
    slices = -(-total // query_slice)
    found = None
    for s in range(max(1, slices)):
        # Slices by hash may exceed the mean a little; they stay bounded.
        rows = asked if slices <= 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == s)
        shared = spark.sparkContext.broadcast(_read_slice(rows.toLocalIterator()))
        part = approximated.mapInArrow(_scan(shared, grid, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
