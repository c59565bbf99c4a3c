"""Exact inner-product search: expressions for a few queries, an Arrow kernel for many, late interaction.

Queries are a table. As many as BLOCK_BYTES hold travel to the pages, which don't move. More are dealt into blocks of that size, and each block meets each share of the pages in one task
of a grid: one shuffle sends pages once for each block of queries and queries once for each share; a task holds one block, and pages stream past it. Scores are compared at PLACES
decimals, so the arithmetic's order doesn't decide ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.vectors import dot

#: Bytes of query vectors that a task holds at once.
BLOCK_BYTES = 16 << 20
#: Up to so many queries the expression form is used.
FEW = 4
#: Decimals at which scores are compared.
PLACES = 12
#: Rows of a product's two sides.
QUERIES_AT_ONCE, PAGES_AT_ONCE = 1024, 4096


class _Kernel:
    """Some queries (names, tokens, matrix) that pages are taken past: take() for each batch (page_ord, vec, token), end() after the last."""

    def __init__(self, names: np.ndarray, tokens: np.ndarray, matrix: np.ndarray):
        self.names, self.tokens, self.matrix = names, tokens, matrix

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def products(self, batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(pages, first row of the matrix, inner products)."""
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            vectors = rectangle(part.column(1), self.matrix.shape[1])
            for first in range(0, len(self.matrix), QUERIES_AT_ONCE):
                yield part.column(0).to_numpy(), first, np.round(self.matrix[first : first + QUERIES_AT_ONCE] @ vectors.T, PLACES)


def rectangle(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a matrix of doubles; raises for vectors of another length."""
    flat = column.flatten()
    if column.null_count or (np.diff(np.asarray(column.offsets)) != width).any():
        raise ValueError("vectors of different length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _All(_Kernel):
    """Every score."""

    def take(self, batch):
        for pages, first, found in self.products(batch, 64):
            q, p = np.divmod(np.arange(found.size), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(self.names[q + first]), pa.array(pages[p]), pa.array(found.ravel())], names=["query_id", "page_ord", "similarity"])


class _TopK(_Kernel):
    """The k best pages of each query, ties to the lesser page."""

    def __init__(self, k: int, *queries: np.ndarray):
        super().__init__(*queries)
        self.k = k
        self.s, self.p = np.full((len(self.names), k), -np.inf), np.full((len(self.names), k), np.iinfo(np.int64).max)

    def take(self, batch):
        for pages, first, found in self.products(batch, PAGES_AT_ONCE):
            self.merge(np.arange(first, first + len(found)), pages, found)
        return iter(())

    def merge(self, rows: np.ndarray, pages: np.ndarray, found: np.ndarray) -> None:
        """Takes the scores of pages (columns) for some queries."""
        near = found >= self.s[rows, -1:]
        if near.sum() > 4 * found.shape[0] * self.k and found.shape[1] > self.k:
            near &= found >= np.partition(found, found.shape[1] - self.k, axis=1)[:, -self.k, None]
        q, j = np.nonzero(near)
        if not len(q):
            return
        q = np.concatenate([q, np.repeat(np.arange(len(found)), self.k)])
        s, p = np.concatenate([found[near], self.s[rows].ravel()]), np.concatenate([pages[j], self.p[rows].ravel()])
        order = np.lexsort((p, -s, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.s[rows], self.p[rows] = s[order].reshape(-1, self.k), p[order].reshape(-1, self.k)

    def end(self):
        real = self.s > -np.inf
        names = np.broadcast_to(self.names[:, None], self.s.shape)[real]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(self.p[real]), pa.array(self.s[real])], names=["query_id", "page_ord", "similarity"])


class _PageScores(_Kernel):
    """Late interaction with whole pages, whose patches come one after another: of a page that isn't over yet only each token's greatest product is held."""

    def __init__(self, *queries: np.ndarray):
        order = np.lexsort((queries[1], queries[0]))
        super().__init__(*(q[order] for q in queries))
        self.ids, first = np.unique(self.names, return_index=True)
        self.ends = np.append(first, len(self.names))
        # rows of one token of a query count once
        self.begins = np.flatnonzero(np.append(True, (np.diff(self.names) != 0) | (np.diff(self.tokens) != 0)))
        self.places = np.searchsorted(self.begins, self.ends)
        self.page, self.top = None, np.full(len(self.names), -np.inf)

    def groups(self, size: int) -> Iterator[tuple[slice, slice]]:
        """(queries, their tokens) in groups of about so many tokens."""
        q = 0
        while q < len(self.ids):
            to = max(q + 1, int(np.searchsorted(self.ends, self.ends[q] + size, "right")) - 1)
            yield slice(q, to), slice(self.ends[q], self.ends[to])
            q = to

    def take(self, batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pages, vectors = part.column(0).to_numpy(), rectangle(part.column(1), self.matrix.shape[1])
            if self.page is not None and pages[0] != self.page:
                yield from self.end()
            cuts = np.append(0, np.flatnonzero(np.diff(pages)) + 1)
            goes_on, done = pages[0] == self.page, pages[cuts[:-1]]
            for q, t in self.groups(4 * QUERIES_AT_ONCE):
                best = np.maximum.reduceat(self.matrix[t] @ vectors.T, cuts, axis=1)
                if goes_on:
                    best[:, 0] = np.maximum(best[:, 0], self.top[t])
                self.top[t] = best[:, -1]
                if len(done):
                    yield self.summed(q, t, done, best[:, :-1])
            self.page = pages[-1]

    def summed(self, q: slice, t: slice, pages: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        if len(self.begins) < len(self.names):
            best = np.maximum.reduceat(best, self.begins[self.places[q.start] : self.places[q.stop]] - t.start, axis=0)
        found = np.add.reduceat(np.round(best, PLACES), self.places[q] - self.places[q.start], axis=0)
        columns = [pa.array(np.repeat(self.ids[q], len(pages))), pa.array(np.tile(pages, len(found))), pa.array(found.ravel())]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "page_ord", "score"])

    def end(self):
        if self.page is not None:
            for q, t in self.groups(1 << 16):
                yield self.summed(q, t, np.array([self.page], np.int64), self.top[t][:, None])
        self.page = None


def _matrix(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len({len(r[2]) for r in rows}) > 1:
        raise ValueError("vectors of different length")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)


def _past(make: Callable[..., _Kernel], queries: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make(*queries)
        for batch in batches:
            yield from kernel.take(batch)
        yield from kernel.end()

    return run


def _grid(make: Callable[..., _Kernel]):
    """Rows (cell, kind, key, token, vec) sorted by cell and kind: the queries (kind 0) of each cell, then the pages that pass them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kernel = None, [], None
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != now:
                    if kernel is not None:
                        yield from kernel.end()
                    now, rows, kernel = cells[a], [], None
                if kinds[a] == 0:
                    rows += zip(part.column("key").to_pylist(), part.column("token").to_pylist(), part.column("vec").to_pylist(), strict=True)
                elif rows:
                    kernel = kernel or make(*_matrix(rows))
                    yield from kernel.take(pa.RecordBatch.from_arrays([part.column(c) for c in ("key", "vec", "token")], names=["page_ord", "vec", "token"]))
        if kernel is not None:
            yield from kernel.end()

    return run


def met(pages: DataFrame, asked: DataFrame, make: Callable[..., _Kernel], schema: str, whole: bool = False) -> DataFrame:
    """What make's kernel gives for every query (query_id, token, vec) and all pages (page_ord, vec, and token if the kernel takes one). The rows of a query stay together; those of a page follow one another in one task if whole."""
    spark = pages.sparkSession
    size = asked.agg(F.sum(F.size("vec").cast("long") * 8).alias("bytes")).first()["bytes"]
    if not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // BLOCK_BYTES)
    pages = pages.select(F.col("page_ord").cast("long").alias("page_ord"), "vec", (F.col("token") if "token" in pages.columns else F.lit(0)).cast("int").alias("token"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if blocks == 1:
        if whole:
            pages = pages.repartition(tasks, F.xxhash64("page_ord")).sortWithinPartitions("page_ord")
        return pages.mapInArrow(_past(make, _matrix(asked.select("query_id", "token", "vec").collect())), schema)
    shares = max(1, tasks // blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    doubles = F.col("vec").cast("array<double>").alias("vec")
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b"), every(shares).alias("s"), F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("key"), F.col("token").cast("int").alias("token"), doubles)
    right = pages.select(every(blocks).alias("b"), F.pmod(F.xxhash64("page_ord"), F.lit(shares)).cast("int").alias("s"), F.lit(1).alias("kind"), F.col("page_ord").alias("key"), "token", doubles)
    both = left.unionByName(right).select((F.col("b") * shares + F.col("s")).alias("cell"), "kind", "key", "token", "vec")
    return both.repartition(blocks * shares, "cell").sortWithinPartitions("cell", "kind", *["key"] * whole).mapInArrow(_grid(make), schema)


def scores(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, page_ord, similarity) of every query with every page. pages: page_ord, unit_vec; queries: query_id, unit_vec."""
    asked = queries.select("query_id", F.lit(0).alias("token"), F.col("unit_vec").alias("vec"))
    return met(pages.select("page_ord", F.col("unit_vec").alias("vec")), asked, _All, "query_id long, page_ord long, similarity double")


def _few(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """The scores of a few queries as expressions."""
    few = queries.select("query_id", F.col("unit_vec").alias("__q")).collect()
    table = F.array(*[F.struct(F.lit(r["query_id"]).cast("long").alias("query_id"), F.array(*map(F.lit, r["__q"])).cast("array<double>").alias("q")) for r in few])
    found = pages.select("page_ord", "unit_vec", F.explode(table).alias("__x"))
    return found.select(F.col("__x.query_id").alias("query_id"), "page_ord", F.round(dot(F.col("unit_vec"), F.col("__x.q")), PLACES).alias("similarity"))


def top_k(pages: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, page_ord, similarity): the k pages of greatest inner product for each query, ties to the lesser page_ord.

    Each task keeps k pages per query; only those are shuffled.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    asked = queries.select("query_id", "unit_vec")
    if len(asked.select("query_id").take(FEW + 1)) <= FEW:
        found = _few(pages, asked) if not asked.isEmpty() else pages.sparkSession.createDataFrame([], "query_id long, page_ord long, similarity double")
    else:
        asked = asked.select("query_id", F.lit(0).alias("token"), F.col("unit_vec").alias("vec"))
        found = met(pages.select("page_ord", F.col("unit_vec").alias("vec")), asked, lambda *q: _TopK(k, *q), "query_id long, page_ord long, similarity double")
    return best(found, k)


def best(found: DataFrame, k: int, score: str = "similarity") -> DataFrame:
    """found (query_id, page_ord, score) with rank, up to k, ties to the lesser page_ord."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "page_ord")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "page_ord", score)


def with_metadata(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with source, page, total_pages and image_path. Joined after the top k, so k rows per query meet the metadata."""
    return hits.join(meta.select("page_ord", "source", "page", "total_pages", "image_path"), "page_ord").select("query_id", "rank", "page_ord", "source", "page", "total_pages", "image_path", "similarity")


def max_sim(patches: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, page_ord, score): for each token of a query the greatest inner product with a page's patches, summed. patches: page_ord, vec; tokens: query_id, token, vec.

    Patches are shuffled, once for each block of queries; products and scores aren't.
    """
    return met(patches.select("page_ord", "vec"), tokens.select("query_id", "token", "vec"), _PageScores, "query_id long, page_ord long, score double", whole=True)


def _rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, page_ord, vec) sorted by the first two; page_ord is null for the query's tokens, which come first. One score for each page."""
    query, page, tokens, top = None, None, [], None
    out: list[tuple[int, int, float]] = []
    for batch in batches:
        queries, pages = batch.column("query_id").to_numpy(), batch.column("page_ord")
        real, named = pages.is_valid().to_numpy(zero_copy_only=False), pages.fill_null(0).to_numpy()
        vectors = batch.column("vec")
        cuts = [0, *(np.flatnonzero((np.diff(queries) != 0) | (np.diff(named) != 0) | (np.diff(real.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if page is not None and (queries[a] != query or named[a] != page):
                out.append((query, page, float(top.sum())))
                page = None
            if queries[a] != query:
                query, tokens = queries[a], []
            if not real[a]:
                tokens += vectors.slice(a, b - a).to_pylist()
                continue
            if not len(tokens):
                continue
            matrix = np.array(tokens, np.float64)
            found = np.round(matrix @ rectangle(vectors.slice(a, b - a), matrix.shape[1]).T, PLACES).max(axis=1)
            top = found if page is None else np.maximum(top, found)
            page = named[a]
        if len(out) > 4096:
            yield _scored(out)
            out = []
    if page is not None:
        out.append((query, page, float(top.sum())))
    if out:
        yield _scored(out)


def _scored(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    q, p, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "page_ord", "score"])


def rescore(patches: DataFrame, tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, page_ord, score): late interaction for candidates (query_id, page_ord) only. A page's patches go to the queries that it is a candidate of, where their tokens are."""
    wanted = candidates.select("query_id", "page_ord").distinct()
    doubles = F.col("vec").cast("array<double>").alias("vec")
    pages = patches.select(F.col("page_ord").cast("long").alias("page_ord"), doubles).join(wanted, "page_ord").select(F.col("query_id").cast("long").alias("query_id"), "page_ord", "vec")
    asked = tokens.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    both = asked.select(F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("long").alias("page_ord"), doubles).unionByName(pages)
    # by an expression: a repartition by the column itself is left out where both sides of the union seem to be dealt by it, which adaptive joins then undo
    both = both.repartition(F.xxhash64("query_id")).sortWithinPartitions("query_id", F.col("page_ord").asc_nulls_first())
    return both.mapInArrow(_rescored, "query_id long, page_ord long, score double")
