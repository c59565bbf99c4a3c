"""An index for late interaction: inverted lists from patch centroids to pages, with codes that bound scores; only candidates' patches are read.

A list (cell) holds the codes of the patches nearest to its centre, and it is a partition of the table. A query probes the lists nearest to its tokens. For a page met there, a token's greatest
product lies between bounds that the codes give; a token that no list gave one for is bounded by what the lists it didn't probe can hold, which their radius says. Pages whose
upper bound reaches the k-th lower bound are scored exactly from their patches. A query is certain if its k-th exact score exceeds what a page in no probed list could have; the others go through
all lists. So results are exact whatever is probed, and probing decides the cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators import clusters, codes, ivf, search
from folioscan.scratch import Scratch

#: Bytes of tokens that a task holds at once.
TOKEN_BYTES = 8 << 20
#: Tokens and patches of a product's two sides.
TOKENS_AT_ONCE, PATCHES_AT_ONCE = 512, 1024


def _listed(centroids: np.ndarray, book: codes.Codebook):
    """Batches (page_ord, patch, vec) to (page_ord, code, err, far, size, cell): far is the distance from the centre, size the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = search.rectangle(part.column(1), centroids.shape[1])
                own = clusters.nearest(vectors, centroids)
                far = np.sqrt(((vectors - centroids[own]) ** 2).sum(axis=1))
                made, err = book.encode(vectors)
                columns = [part.column(0), pa.array([c.tobytes() for c in made], pa.binary()), pa.array(err * (1 + codes.SLACK) + codes.SLACK), pa.array(far), pa.array(np.sqrt((vectors**2).sum(axis=1))), pa.array(own.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_ord", "code", "err", "far", "size", "cell"])

    return run


class _Tokens:
    """Tokens (query_id, token, vec) and the lists that they probe: for each query those nearest to any of its tokens."""

    def __init__(self, rows: list, centroids: np.ndarray, radius: np.ndarray, probes: int):
        self.queries, self.tokens, self.matrix = search._matrix(rows)
        self.norms = np.sqrt((self.matrix**2).sum(axis=1))
        said = self.matrix @ centroids.T + self.norms[:, None] * radius
        own = np.zeros(said.shape, bool)
        np.put_along_axis(own, np.argsort(-said, axis=1, kind="stable")[:, :probes], True, axis=1)
        names, at = np.unique(self.queries, return_inverse=True)
        wants = np.zeros((len(names), said.shape[1]), bool)
        np.logical_or.at(wants, at, own)
        wants = wants[at]
        #: The tokens that probe each list: tasks get these few rows, not a table of all tokens by all lists.
        self.asked = {int(cell): np.flatnonzero(wants[:, cell]).astype(np.int32) for cell in np.flatnonzero(wants.any(axis=0))}
        #: What a patch in a list that the query doesn't probe can give a token at most.
        self.rest = np.where(wants, -np.inf, said).max(axis=1) + codes.SLACK

    def rows(self) -> list[tuple[int, int, float, float]]:
        return [(int(q), int(t), float(r), float(n)) for q, t, r, n in zip(self.queries, self.tokens, self.rest, self.norms, strict=True)]


def _bounds(tokens: _Tokens, book: codes.Codebook):
    """Batches (page_ord, code, err, cell) to (query_id, page_ord, token, low, high), the greatest of a page in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(3).to_numpy()
            for cell in np.unique(cells):
                asked = tokens.asked.get(int(cell), ())
                rows = np.flatnonzero(cells == cell)
                for at in range(0, len(rows) if len(asked) else 0, 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    said, err = book.decode(codes.bytes_of(part.column(1), len(book.words))).T, part.column(2).to_numpy()
                    names, own = np.unique(part.column(0).to_numpy(), return_inverse=True)
                    order = np.argsort(own, kind="stable")
                    cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
                    for first in range(0, len(asked), 256):
                        some = asked[first : first + 256]
                        found = tokens.matrix[some] @ said
                        room = tokens.norms[some, None] * err
                        low, high = (np.maximum.reduceat(x[:, order], cuts, axis=1) for x in (found - room, found + room))
                        t, p = np.divmod(np.arange(low.size), low.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(tokens.queries[some[t]]), pa.array(names[p]), pa.array(tokens.tokens[some[t]], pa.int32()), pa.array(low.ravel()), pa.array(high.ravel())], names=["query_id", "page_ord", "token", "low", "high"])

    return run


def _page_bounds(tokens: _Tokens, book: codes.Codebook, k: int):
    """Batches (page_ord, codes) of packed pages to (query_id, page_ord, low, high) of pages that may be among a query's k best, as far as the task has seen."""
    order = np.argsort(tokens.queries, kind="stable")
    names, first = np.unique(tokens.queries[order], return_index=True)
    matrix, norms = tokens.matrix[order], tokens.norms[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ends = np.full((len(names), k), -np.inf), np.append(first, len(matrix))
        for batch in batches:
            pages, lists = batch.column(0).to_numpy(), batch.column(1)
            begin = np.asarray(lists.offsets)
            flat = lists.flatten()
            made, errs, begin = flat.field("code"), flat.field("err").to_numpy(), begin - begin[0]
            a = 0
            while a < len(pages):
                b = max(a + 1, int(np.searchsorted(begin, begin[a] + PATCHES_AT_ONCE, "right")) - 1)
                said, err = book.decode(codes.bytes_of(made.slice(begin[a], begin[b] - begin[a]), len(book.words))).T, errs[begin[a] : begin[b]]
                cuts, q = begin[a:b] - begin[a], 0
                while q < len(names):
                    to = max(q + 1, int(np.searchsorted(ends, ends[q] + TOKENS_AT_ONCE, "right")) - 1)
                    t = slice(ends[q], ends[to])
                    found, room = matrix[t] @ said, norms[t, None] * err
                    summed = lambda x: np.add.reduceat(np.maximum.reduceat(x, cuts, axis=1), ends[q:to] - ends[q], axis=0)  # noqa: B023, E731
                    found -= room
                    low = summed(found)
                    found += 2 * room
                    high = summed(found)
                    best[q:to] = np.sort(np.concatenate([best[q:to], low], axis=1), axis=1)[:, -k:]
                    i, j = np.nonzero(high >= best[q:to, :1] - codes.SLACK)
                    yield pa.RecordBatch.from_arrays([pa.array(names[q + i]), pa.array(pages[a + j]), pa.array(low[i, j]), pa.array(high[i, j])], names=["query_id", "page_ord", "low", "high"])
                    q = to
                a = b

    return run


@dataclass(frozen=True)
class MultiVectorIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def build(patches: DataFrame, path: str, cells: int | None = None, parts: int | None = None, sample: int = clusters.SAMPLE) -> MultiVectorIndex:
        """Writes patches (page_ord, vec): centroids and codebooks from a bounded sample, lists, the lists' radii, and the patches themselves in ranges of page_ord."""
        cells = min(ivf.MOST_CELLS, max(1, cells or round(patches.count() ** 0.5)))
        rows = patches.select(F.col("page_ord").cast("long").alias("page_ord"), F.col("vec").cast("array<double>").alias("vec"))
        clusters.trained(clusters.sampled(rows, "vec", sample), cells).write.mode("overwrite").parquet(f"{path}/centroids")
        codes.trained(rows, "vec", parts or rows.select(F.size("vec")).first()[0], sample).write.mode("overwrite").parquet(f"{path}/codebooks")
        index = MultiVectorIndex(patches.sparkSession, path)
        listed = rows.mapInArrow(_listed(index.centroids(), index.codebook()), "page_ord long, code binary, err double, far double, size double, cell int")
        listed.hint("rebalance", "cell").sortWithinPartitions("cell", "page_ord").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
        index._lists().groupBy("cell").agg(F.max("far").alias("radius"), F.max("size").alias("size")).write.mode("overwrite").parquet(f"{path}/radii")
        rows.repartitionByRange("page_ord").sortWithinPartitions("page_ord").write.mode("overwrite").parquet(f"{path}/patches")
        packed = index._lists().groupBy("page_ord").agg(F.collect_list(F.struct("code", "err")).alias("codes"))  # a page's patches are one encoder call's
        packed.write.mode("overwrite").parquet(f"{path}/pages")
        return index

    def centroids(self) -> np.ndarray:
        return clusters.collected(self.spark.read.parquet(f"{self.path}/centroids"))[0]

    def codebook(self) -> codes.Codebook:
        return codes.Codebook(clusters.collected(self.spark.read.parquet(f"{self.path}/codebooks")))

    def patches(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/patches")

    def _lists(self) -> DataFrame:
        return self.spark.read.schema("page_ord long, code binary, err double, far double, size double, cell int").parquet(f"{self.path}/lists")

    def _radii(self) -> tuple[np.ndarray, float]:
        """Each list's radius, and the length of the longest patch."""
        rows = {r["cell"]: (r["radius"], r["size"]) for r in self.spark.read.parquet(f"{self.path}/radii").collect()}  # a row a cell
        return np.array([rows.get(i, (-np.inf, 0.0))[0] for i in range(len(self.centroids()))]), max((s for _, s in rows.values()), default=0.0)

    def _blocks(self, tokens: DataFrame, probes: int) -> Iterator[_Tokens]:
        """Tokens in blocks of TOKEN_BYTES, those of a query together."""
        centroids, (radius, _) = self.centroids(), self._radii()
        asked = tokens.select(F.col("query_id").cast("long").alias("query_id"), F.col("token").cast("int").alias("token"), F.col("vec").cast("array<double>").alias("vec"))
        blocks = -(-(asked.agg(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0) // TOKEN_BYTES)
        for b in range(blocks):
            if rows := (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect():
                yield _Tokens(rows, centroids, radius, probes)

    def hopeless(self, tokens: DataFrame, probes: int) -> DataFrame:
        """(query_id) of queries that probing can't make certain, as a page in no probed list could have the greatest score there is."""
        _, longest = self._radii()
        facts = self.spark.createDataFrame([r for some in self._blocks(tokens, probes) for r in some.rows()], "query_id long, token int, rest double, norm double")
        total = facts.groupBy("query_id").agg(F.sum("rest").alias("unseen"), F.sum(F.col("norm") * F.lit(longest)).alias("most"))
        return total.where((F.col("unseen") > float("-inf")) & (F.col("unseen") >= F.col("most"))).select("query_id")

    def bounds(self, tokens: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, page_ord, low, high) of pages in the probed lists, and (query_id, unseen): what a page in none of them could score, -infinity if all lists are probed."""
        book, (_, longest), n = self.codebook(), self._radii(), len(self.centroids())
        found, facts = self.spark.createDataFrame([], "query_id long, page_ord long, token int, low double, high double"), []
        for some in self._blocks(tokens, probes):
            wanted = sorted(some.asked)
            lists = self._lists() if len(wanted) == n else self._lists().where(F.col("cell").isin(wanted))
            found = found.unionByName(lists.select("page_ord", "code", "err", "cell").mapInArrow(_bounds(some, book), found.schema))
            facts += some.rows()
        facts = self.spark.createDataFrame(facts, "query_id long, token int, rest double, norm double")
        each = found.groupBy("query_id", "page_ord", "token").agg(F.max("low").alias("low"), F.max("high").alias("high")).join(facts, ["query_id", "token"])
        part = each.groupBy("query_id", "page_ord").agg(F.sum("low").alias("low"), F.sum(F.greatest("high", "rest")).alias("high"))  # a query probes its lists with all its tokens
        return part, facts.groupBy("query_id").agg(F.sum("rest").alias("unseen"))

    def every(self, tokens: DataFrame, k: int) -> DataFrame:
        """(query_id, page_ord, low, high) from all codes, for pages that no task could exclude from a query's k best."""
        book, found = self.codebook(), self.spark.createDataFrame([], "query_id long, page_ord long, low double, high double")
        for some in self._blocks(tokens, 1):
            found = found.unionByName(self.spark.read.parquet(f"{self.path}/pages").select("page_ord", "codes").mapInArrow(_page_bounds(some, book, k), found.schema))
        return found

    def search(self, tokens: DataFrame, k: int = 10, probes: int = 2) -> DataFrame:
        """(query_id, rank, page_ord, score): the k pages of greatest late-interaction score, exact. probes: lists for each token at first."""
        if k <= 0 or probes <= 0:
            raise ValueError("k and probes have to be positive")
        scratch = Scratch(self.spark, "lists")
        lost = scratch.table(self.hopeless(tokens, probes), "hopeless")
        tried = tokens.join(lost, "query_id", "left_anti")
        pages, unseen = self.bounds(tried, probes)
        pages = scratch.table(pages, "pages")
        bars = scratch.table(self._bars(pages, tried, k), "bars")
        certain = unseen.join(bars, "query_id", "left").where((F.col("bar").isNotNull() & (F.col("unseen") < F.col("bar") - codes.SLACK)) | (F.col("unseen") == float("-inf"))).select("query_id")
        certain = scratch.table(certain, "certain")
        left = tokens.join(certain, "query_id", "left_anti")
        if not left.isEmpty():
            every = scratch.table(self.every(left, k), "every")
            bars = bars.join(certain, "query_id", "left_semi").unionByName(self._bars(every, left, k))
            pages = pages.join(certain, "query_id", "left_semi").unionByName(every)
        return search.best(search.rescore(self.patches(), tokens, self._reaching(pages, bars)), k, "score")

    def candidates(self, tokens: DataFrame, k: int) -> DataFrame:
        """(query_id, page_ord) whose patches a search that probes all lists reads."""
        pages = self.every(tokens, k)
        return self._reaching(pages, self._bars(pages, tokens, k))

    def _bars(self, pages: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
        """(query_id, bar): the least exact score of the k pages with the greatest lower bounds, for queries that have so many."""
        order = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "page_ord")
        first = pages.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "page_ord")
        return search.rescore(self.patches(), tokens, first).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")

    @staticmethod
    def _reaching(pages: DataFrame, bars: DataFrame) -> DataFrame:
        kept = pages.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar") - codes.SLACK))
        return kept.select("query_id", "page_ord")
