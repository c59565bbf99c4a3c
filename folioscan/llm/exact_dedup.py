"""Exact duplicates by content-defined chunk recipes: texts become ordered lists of chunk identifiers, identifiers are verified by bytes, lists are compared.

A text is cut where a rolling hash of its last 32 bytes says so, so equal stretches give equal chunks. Each row is turned into its recipe, the ordered list of its chunks'
identifiers, where it is read. Texts whose recipe no other text has are unique, as equal texts have equal recipes. Of the others each task sends every chunk once, however
often it meets it, and chunks that share an identifier are compared byte by byte; whole texts don't move. If two different chunks share one, all identifiers are made anew with
another key and twice as wide, so what is returned is never decided by a hash. The filter of recipes that occur twice is a Bloom filter of at most 16 MB; what it
lets through besides is only verified in vain.

Null texts count as empty; empty texts are equal to one another. A row without id stays behind any with one. Of rows that share text and id one stays. Extra columns are passed over
unless `keep` names them. Texts of any length work: chunks have at most 64 KiB. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folioscan.llm.common import Scratch, configured, mix64

#: Bytes of a chunk: at least LEAST (a text's last may be shorter), at most MOST, and 8 KiB on average beyond LEAST.
LEAST, MOST, MASK = 4096, 65536, np.uint32(8191 << 19)
#: Bytes that are hashed at once.
PIECE = 1 << 20
#: Rows that a group has to exceed, at least, to be broadcast.
HOT = 4096
#: Bytes of groups' recipes that may be broadcast.
BROADCAST_BYTES = 32 << 20
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _candidates(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: where the rolling hash of 32 bytes has only zeros under MASK."""
    found = []
    for at in range(0, len(data), PIECE):
        begin = max(0, at - 31)
        h = GEAR[data[begin : at + PIECE]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        ends = np.flatnonzero((h & MASK) == 0) + begin + 1
        found.append(ends[ends > at])
    return np.concatenate(found)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end. Depends on the bytes alone."""
    n = len(data)
    if n <= LEAST:
        return [n]
    ends, last, candidates = [], 0, _candidates(np.frombuffer(data, np.uint8))
    while n - last > LEAST:
        i = np.searchsorted(candidates, last + LEAST)
        last = int(min(candidates[i] if i < len(candidates) else n, last + MOST, n))
        ends.append(last)
    return ends if last == n else [*ends, n]


class _Cutter:
    """Texts to chunks with identifiers of `bits` bits under a key."""

    def __init__(self, key: int, bits: int):
        self.key, self.mask = key.to_bytes(8, "little"), (1 << bits) - 1

    def name(self, chunk: bytes) -> int:
        x = int.from_bytes(hashlib.blake2b(chunk, digest_size=8, key=self.key).digest(), "little") & self.mask
        return x - (1 << 64) if x >> 63 else x

    def cut(self, data: bytes) -> tuple[list[int], list[bytes]]:
        ends = chunk_ends(data)
        chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return [self.name(c) for c in chunks], chunks

    def mark(self, names: list[int]) -> int:
        return int.from_bytes(hashlib.blake2b(np.array(names, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column(batch.num_columns - 1):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _recipes(cutter: _Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, marks, digests = [], [], []
            for data in _texts(batch):
                recipe = cutter.cut(data)[0]
                names.append(recipe)
                marks.append(cutter.mark(recipe))
                digests.append(hashlib.sha256(data).hexdigest())
            made = [pa.array(digests, pa.string()), pa.array(names, pa.list_(pa.int64())), pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "text_sha256", "recipe", "mark"])

    return run


def _chunks_of(cutter: _Cutter, words, places: int, held: int):
    """The chunks of texts whose recipe's mark passes the filter; one that a task has met is not sent again while it is among the last `held` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, size = np.frombuffer(words.value, np.uint64), {}, 0
        for batch in batches:
            names, chunks = [], []
            for data in _texts(batch):
                recipe, parts = cutter.cut(data)
                if not all(int(bits[p >> 6]) >> (p & 63) & 1 for p in _places(cutter.mark(recipe), places)):
                    continue
                for name, chunk in zip(recipe, parts, strict=True):
                    if seen.get(name) != chunk:
                        size += len(chunk) - len(seen.get(name, b""))
                        seen[name] = chunk
                        names.append(name)
                        chunks.append(chunk)
                        if size > held:
                            seen, size = {}, 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(chunks, pa.binary())], names=["name", "chunk"])

    return run


def _places(mark: int, places: int) -> tuple[int, int]:
    return mark & (places - 1), (mark >> 32) & (places - 1)


def _filter(groups: DataFrame, n: int) -> tuple[bytes, int]:
    """A Bloom filter of the groups' marks (two bits each) as bytes, and its bits: 16 for each group, 2**27 at most, whatever their number."""
    places = 1 << min(27, max(12, (16 * n - 1).bit_length()))
    mark = F.col("mark")
    at = F.explode(F.array(mark.bitwiseAND(places - 1), F.shiftright(mark, 32).bitwiseAND(places - 1)))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    rows = groups.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(places >> 6, np.uint64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return words.tobytes(), places


def _verified(texts: DataFrame, groups: DataFrame, n_groups: int, cutter: _Cutter, held: int) -> bool:
    """Whether no two different chunks of texts with a recipe of groups share an identifier."""
    words, places = _filter(groups, n_groups)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    chunks = texts.mapInArrow(_chunks_of(cutter, shared, places, held), "name long, chunk binary").distinct()
    sound = chunks.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    shared.destroy()
    return sound


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, bits: int = 64, held: int = 8 << 20) -> DataFrame:
    """One row per row of docs: id_col and the columns of keep, keep_id (the greatest id of its equal texts), group_size, kept (one row a group), text_sha256.

    bits: how wide identifiers are at first. held: bytes of chunks that a task remembers.
    """
    spark, kept = configured(docs), [id_col, *[c for c in keep or [] if c != id_col]]
    names = [f"c{i}" for i in range(len(kept))]
    texts = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([*texts.schema.fields[:-1], StructField("text_sha256", StringType()), StructField("recipe", ArrayType(LongType())), StructField("mark", LongType())])
    for attempt in range(8):
        scratch, cutter = Scratch(spark, "exact"), _Cutter(attempt, bits)
        recipes = scratch.table(texts.mapInArrow(_recipes(cutter), schema).withColumn("row", F.monotonically_increasing_id()), "recipes")
        first = F.coalesce(F.max_by("row", "c0"), F.max("row"))
        same = recipes.groupBy("recipe").agg(F.max("c0").alias("keep_id"), F.count("*").alias("group_size"), first.alias("keep_row"), F.first("mark").alias("mark"))
        groups = scratch.table(same.where("group_size > 1"), "groups")
        n_groups = groups.count()
        if not n_groups or _verified(texts.select("text"), groups, n_groups, cutter, held):
            break
        scratch.remove()
        bits = min(64, 2 * bits)
    else:
        raise RuntimeError("chunks share identifiers under each of eight keys")
    found = _with_groups(recipes, groups)
    out = [F.col(n).alias(c) for c, n in zip(kept, names, strict=True)]
    return found.select(out[0], F.when(F.col("keep_row").isNull(), F.col("c0")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256", *out[1:])


def _with_groups(recipes: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group, if it has one. Groups of over `most` rows are broadcast: a row of theirs stays where it is, and their recipes have BROADCAST_BYTES at most, as
    each of their identifiers stands for `most` of the table's."""
    facts = recipes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("recipe")), F.lit(0)).alias("ids")).first()
    most = max(HOT, -(-(8 * facts["ids"] + 64 * facts["n"]) // BROADCAST_BYTES))
    groups, rows = groups.drop("mark"), recipes.drop("mark")
    large = groups.where(F.col("group_size") > most)
    if large.isEmpty():
        return rows.join(groups, "recipe", "left")
    small = groups.where(F.col("group_size") <= most)
    there = rows.join(F.broadcast(large), "recipe")
    return there.unionByName(rows.join(F.broadcast(large.select("recipe")), "recipe", "left_anti").join(small, "recipe", "left"))
