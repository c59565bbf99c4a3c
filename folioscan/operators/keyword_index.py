"""A stored inverted index with blocks of postings and their greatest share of a score, so that a search reads few of them.

A block holds the postings of one token in one zone of ZONE page ordinals. A page's BM25 is at most the sum of what its zone's blocks hold at most, so zones whose sum stays below the
k-th score of some pages already counted can't change the result, and their postings aren't read. Blocks' heads are columns of their own, which a scan of heads reads alone. Tokens are
dealt to folders by hash, and a search lists the folders of its tokens only.

Queries go in blocks of bounded size. The postings of a block's tokens are dealt by zone once for all its queries, and a task sums the scores of whole zones and returns each query's k best
pages of those it saw, so no row for a query and a page is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from folioscan.operators import search, text
from folioscan.scratch import Scratch

ZONE = 32
BUCKETS = 16
#: (query, token) pairs and queries of a block.
PAIRS, QUERIES = 1 << 18, 1 << 14
#: Numbers in a task's tables of tokens by pages, and of (query, token) pairs by pages.
CELLS = 1 << 21
#: Zones up to so many travel to the postings.
ZONES = 1 << 20
#: Decimals of a score.
PLACES = 9
#: Sums of shares are compared with so much room.
SLACK = 1e-6
POSTINGS = "postings array<struct<at:int,tf:int,size:int>>"


def _zoned(width: int, mean: float):
    """Batches (page_ord, tokens) in order of page_ord to (t, zone, postings, most, n), a row for each token of a zone."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        pages, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
        size, doc = pc.list_value_length(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
        coded = pc.list_flatten(lists).dictionary_encode()
        zones, place = np.unique(pages // width, return_inverse=True)
        words = len(coded.dictionary)
        # ordered by zone, token and text at once
        keys, tf = np.unique((place[doc] * words + coded.indices.to_numpy()) * len(pages) + doc, return_counts=True)
        block, doc = np.divmod(keys, len(pages))
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).astype(np.int32)
        zone, word = np.divmod(block[cuts[:-1]], max(1, words))
        postings = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pages[doc] % width, tf, size[doc])], names=["at", "tf", "size"])
        share = text.impact(tf, size[doc], mean)
        most = np.maximum.reduceat(share, cuts[:-1]) if len(block) else share
        columns = [coded.dictionary.take(pa.array(word)), pa.array(zones[zone]), pa.ListArray.from_arrays(pa.array(cuts), postings), pa.array(most), pa.array(np.diff(cuts))]
        return pa.RecordBatch.from_arrays(columns, names=["t", "zone", "postings", "most", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the texts of a zone that isn't over yet
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = pa.Table.from_batches([batch.slice(at, 512)])
                rows = rows if held is None else pa.concat_tables([held, rows])
                zones = rows.column(0).to_numpy() // width
                last = int(np.searchsorted(zones, zones[-1]))
                held = rows.slice(last)
                if last:
                    yield made(rows.slice(0, last))
        if held is not None:
            yield made(held)

    return run


class _Asked:
    """Some queries' rows (query_id, t, idf, bucket): ids, words (each token's number), and pairs of a word and its weight, those of a query in a row."""

    def __init__(self, rows: list, kind: DataType):
        ids: dict = {}
        self.words: dict[str, int] = {}
        query = np.array([ids.setdefault(r["query_id"], len(ids)) for r in rows])
        word = np.array([self.words.setdefault(r["t"], len(self.words)) for r in rows])
        order = np.argsort(query, kind="stable")
        self.ids, self.numbers, self.kind = pa.array(list(ids), to_arrow_type(kind)), pa.array(range(len(ids)), pa.int32()), kind.simpleString()
        self.buckets = sorted({r["bucket"] for r in rows})
        self.query, self.word, self.idf = query[order], word[order], np.array([r["idf"] for r in rows])[order]

    def sums(self, word: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, for each of width columns the sum of its tokens' weighted values there), in groups of queries; those without such a word are left out."""
        present, at = np.unique(word, return_inverse=True)
        table = np.bincount(at * width + column, weights=value, minlength=len(present) * width).reshape(-1, width)
        place = np.full(len(self.words), -1)
        place[present] = np.arange(len(present))
        pairs = np.flatnonzero(place[self.word] >= 0 if wanted is None else (place[self.word] >= 0) & wanted[self.query])
        queries, cuts = np.unique(self.query[pairs], return_index=True)
        cuts, a = np.append(cuts, len(pairs)), 0
        while a < len(queries):
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + CELLS // width, "right")) - 1)
            some = pairs[cuts[a] : cuts[b]]
            # summed in one order for every column, so that equal texts' scores are equal
            yield queries[a:b], np.add.reduceat(table[place[self.word[some]]] * self.idf[some, None], cuts[a:b] - cuts[a], axis=0)
            a = b


def _whole_zones(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Rows in order of zone, cut between zones: some zones of width pages at once."""
    held = None  # a zone that isn't over yet
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        zone = rows.column("zone").to_numpy()
        ends, a = np.append(np.flatnonzero(np.diff(zone)) + 1, len(zone)), 0
        for i, end in enumerate(ends[:-1]):
            n = i + 1 - np.searchsorted(ends, a, "right")
            if i + 2 == len(ends) or (ends[i + 1] - a) * (n + 1) * width > CELLS:
                yield rows.slice(a, end - a)
                a = int(end)
        held = rows.slice(a)
    if held is not None and len(held):
        yield held


def _bounds(asked: _Asked):
    """Batches (word, zone, most) in order of zone to (query, zone, most): what a page of the zone can score at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_zones(batches, 1):
            zones, z = np.unique(rows.column("zone").to_numpy(), return_inverse=True)
            for queries, most in asked.sums(rows.column("word").to_numpy(), z, rows.column("most").to_numpy(), len(zones)):
                q, z_ = np.nonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(queries[q].astype(np.int32)), pa.array(zones[z_]), pa.array(most[q, z_])], names=["query", "zone", "most"])

    return run


def _best(asked: _Asked, k: int, width: int, mean: float, bar: np.ndarray, ids: pa.Array):
    """Batches (word, zone, most, at, tf, size) in order of zone to (query_id, page_ord, score), each query's k best pages of the task. bar: a score that k pages reach, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search._TopK(k, np.arange(len(asked.ids), dtype=np.int32), None, None)
        for rows in _whole_zones(batches, width):
            zones, z = np.unique(rows.column("zone").to_numpy(), return_inverse=True)
            word, wanted = rows.column("word").to_numpy(), np.zeros(len(asked.ids), bool)
            for queries, most in asked.sums(word, z, rows.column("most").to_numpy(), len(zones)):
                wanted[queries] = most.max(axis=1) + SLACK >= np.maximum(bar[queries], best.s[queries, -1])
            at, tf, size = (rows.column(c).combine_chunks() for c in ("at", "tf", "size"))
            own = pc.list_parent_indices(at).to_numpy()
            share = text.impact(pc.list_flatten(tf).to_numpy(), pc.list_flatten(size).to_numpy(), mean)
            pages = (zones[:, None] * width + np.arange(width)).ravel()
            for queries, found in asked.sums(word[own], z[own] * width + pc.list_flatten(at).to_numpy(), share, len(pages), wanted):
                best.merge(queries, pages, np.where(found > 0, np.floor(found * 10**PLACES + 0.5) / 10**PLACES, -np.inf))
        for part in best.end():
            yield pa.RecordBatch.from_arrays([ids.take(part.column(0)), part.column(1), part.column(2)], names=["query_id", "page_ord", "score"])

    return run


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str, key: str = "page_ord", column: str = "text", zone: int = ZONE, buckets: int = BUCKETS) -> KeywordIndex:
        """Writes docs' (integer key, text) postings, tokens' document counts and the corpus' facts to path."""
        texts = docs.select(F.col(key).cast("long").alias("page_ord"), F.col(column).alias("text"))
        facts = texts.agg(F.count("*").alias("docs"), F.avg(F.size(text.tokens(F.col("text")))).alias("mean"), F.lit(zone).cast("long").alias("zone"), F.lit(buckets).cast("long").alias("buckets"))
        facts.write.mode("overwrite").parquet(f"{path}/facts")
        mean = docs.sparkSession.read.parquet(f"{path}/facts").first()["mean"] or 1.0
        # texts are dealt once, by zone, so that a task makes whole blocks and a frequent token's postings aren't one task's
        dealt = texts.repartition(F.xxhash64(F.floor(F.col("page_ord") / zone))).sortWithinPartitions("page_ord")
        blocks = dealt.select("page_ord", text.tokens(F.col("text")).alias("ts")).mapInArrow(_zoned(zone, mean), f"t string, zone long, {POSTINGS}, most double, n int")
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int"))
        blocks.sortWithinPartitions("bucket", "t", "zone").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        index = KeywordIndex(docs.sparkSession, path)
        index.blocks().groupBy("t").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"t string, zone long, {POSTINGS}, most double, n int, bucket int").parquet(f"{self.path}/blocks")

    def _asked(self, queries: DataFrame, column: str) -> Iterator[_Asked]:
        """Queries and the idf of their tokens, in blocks; queries of one id are one."""
        terms = self.spark.read.parquet(f"{self.path}/terms").crossJoin(F.broadcast(self.spark.read.parquet(f"{self.path}/facts")))  # facts is one row
        asked = text.asked_terms(queries, column).distinct().join(terms, "t")
        asked = asked.select("query_id", "t", text.idf(F.col("docs"), F.col("df")).alias("idf"), F.pmod(F.xxhash64("t"), F.col("buckets")).cast("int").alias("bucket"))
        asked = Scratch(self.spark, "asked").table(asked, "asked")
        pairs, names = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
        blocks = max(-(-pairs // PAIRS), -(-names // QUERIES))
        for b in range(blocks):
            if rows := (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect():
                yield _Asked(rows, asked.schema["query_id"].dataType)

    def _of(self, asked: _Asked, *columns: str | F.Column) -> DataFrame:
        """(word, zone, columns) of the blocks of tokens that are asked for; only those tokens' folders are listed."""
        words = self.spark.createDataFrame(pa.table({"t": list(asked.words), "word": pa.array(range(len(asked.words)), pa.int32())}))
        return self.blocks().where(F.col("bucket").isin(asked.buckets)).join(F.broadcast(words), "t").select("word", "zone", *columns)  # PAIRS words at most

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.xxhash64("zone")).sortWithinPartitions("zone")

    def plan(self, asked: _Asked, k: int, seeds: int = 4) -> tuple[DataFrame, np.ndarray]:
        """((query, zone) that can hold one of a query's k best pages, scores that each query has k pages of or -infinity). seeds: zones of the greatest bound that are counted first."""
        scratch = Scratch(self.spark, "zones")
        zones = scratch.table(self._dealt(self._of(asked, "most")).mapInArrow(_bounds(asked), "query int, zone long, most double"), "zones")
        first = Window.partitionBy("query").orderBy(F.col("most").desc(), "zone")
        tried = zones.withColumn("r", F.row_number().over(first)).where(F.col("r") <= seeds)
        bar = np.full(len(asked.ids), -np.inf)
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        bars = self._scores(asked, tried, k, bar, numbers=True).withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
        bars = scratch.table(bars.select(F.col("query_id").alias("query"), F.col("score").alias("bar")), "bars")
        for r in bars.collect():  # QUERIES at most
            bar[r["query"]] = r["bar"]
        kept = zones.join(F.broadcast(bars), "query", "left").where(F.col("bar").isNull() | (F.col("most") + SLACK >= F.col("bar")))
        return kept.select("query", "zone"), bar

    def _scores(self, asked: _Asked, zones: DataFrame, k: int, bar: np.ndarray, numbers: bool = False) -> DataFrame:
        """(query_id, page_ord, score) that hold each query's k best pages in the zones of some rows. numbers: queries' numbers in place of their ids."""
        facts = self.spark.read.parquet(f"{self.path}/facts").first()
        zones = Scratch(self.spark, "kept").table(zones.select("zone").distinct(), "zones")
        zones = F.broadcast(zones) if zones.count() <= ZONES else zones
        rows = self._of(asked, "most", *(F.col(f"postings.{c}").alias(c) for c in ("at", "tf", "size"))).join(zones, "zone", "left_semi")
        ids, kind = (asked.numbers, "int") if numbers else (asked.ids, asked.kind)
        return self._dealt(rows.select("word", "zone", "most", "at", "tf", "size")).mapInArrow(_best(asked, k, facts["zone"], facts["mean"], bar, ids), f"query_id {kind}, page_ord long, score double")

    def search(self, queries: DataFrame, k: int = 10, column: str = "text") -> DataFrame:
        """(query_id, rank, page_ord, score): BM25's k best pages, ties to the lesser page_ord, of queries (query_id, text)."""
        if k <= 0:
            raise ValueError("k has to be positive")
        found = self.spark.range(0).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("long").alias("page_ord"), F.lit(None).cast("double").alias("score"))
        for asked in self._asked(queries, column):
            kept, bar = self.plan(asked, k)
            found = found.unionByName(self._scores(asked, kept, k, bar))
        return text.ranked(found, "page_ord", "score", k).select("query_id", "rank", "page_ord", "score")

    def share_read(self, queries: DataFrame, k: int, column: str = "text") -> float:
        """Postings that a search reads beyond heads, as a share of those of its tokens."""
        read = every = 0
        for asked in self._asked(queries, column):
            heads = self._of(asked, "n")
            every += heads.agg(F.sum("n")).first()[0] or 0
            read += heads.join(self.plan(asked, k)[0].select("zone").distinct(), "zone", "left_semi").agg(F.sum("n")).first()[0] or 0
        return read / max(1, every)
