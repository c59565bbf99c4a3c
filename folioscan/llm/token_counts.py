"""Token counts of documents in flat token files that have no index, by a separator scan.

A file is a run of ids of fixed width; a document ends at the end-of-document id. Files come as blocks (file, block, data) of whole ids. Each block is
searched by itself in one vectorised comparison. Boundaries are stitched by a prefix scan over blocks: tokens before the block, documents
before it, and the last separator before it. The scan has two levels, SEGMENT blocks and then their sums, so the windows of one huge file don't
fall to one task block by block.

A file's ids after its last separator are its last document, without an end. An empty document (two separators in a row) counts no tokens. Null data is an
empty block. Other columns are passed over. Blocks of a file may differ in size; (file, block) is to be unique. Null file: a file of its own. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm import byte_bpe
from folioscan.llm.common import Scratch, partitions

SEGMENT = 256
_TYPES = {2: "<u2", 4: "<u4"}


def _search(end_id: int, width: int):
    """Batches (file, block, data) to (file, block, tokens, ends): places of the separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() or b"", dtype=_TYPES[width])
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *ends])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), lists], names=["file", "block", "tokens", "ends"])

    return run


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, doc_index, block, start, n_tokens, ended) of every document; start: ids of the file before it; n_tokens without the separator.

    block: where its separator lies (the file's last block for a document without one).
    """
    found = blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(_search(end_id, width), f"file {blocks.schema['file'].dataType.simpleString()}, block long, tokens long, ends array<long>")
    # Written, so that the ids are read and searched once, however often the places are used.
    found = Scratch(blocks.sparkSession, "separators").table(found, "found")
    found = found.withColumn("segment", F.floor(F.col("block") / SEGMENT))
    facts = found.select("file", "block", "segment", "tokens", F.size("ends").cast("long").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    within = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = facts.withColumn("t", F.coalesce(F.sum("tokens").over(within), F.lit(0))).withColumn("d", F.coalesce(F.sum("docs").over(within), F.lit(0))).withColumn("e", F.max(F.col("t") + F.col("last")).over(within))
    sums = before.groupBy("file", "segment").agg(F.sum("tokens").alias("st"), F.sum("docs").alias("sd"), F.max(F.col("t") + F.col("last")).alias("se"), F.max("block").alias("top"))
    across = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bt", F.coalesce(F.sum("st").over(across), F.lit(0))).withColumn("bd", F.coalesce(F.sum("sd").over(across), F.lit(0))).withColumn("be", F.max(F.col("bt") + F.col("se")).over(across))
    sums = sums.withColumnRenamed("file", "f").withColumnRenamed("segment", "s")
    at = before.join(sums, F.col("file").eqNullSafe(F.col("f")) & (F.col("segment") == F.col("s")))
    at = at.select("file", "block", "tokens", (F.col("t") + F.col("bt")).alias("base"), (F.col("d") + F.col("bd")).alias("first"), F.coalesce(F.col("bt") + F.col("e"), F.col("be"), F.lit(-1)).alias("previous"))
    at = at.withColumnRenamed("file", "f").withColumnRenamed("block", "b").drop("tokens")
    rows = found.join(at, F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")))
    spans = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("doc_index"), F.when(i == 0, F.col("previous") + 1).otherwise(F.col("base") + F.get("ends", i - 1) + 1).alias("start"), (F.col("base") + e).alias("end")))
    ended = rows.select("file", "block", F.explode(spans).alias("x")).select("file", F.col("x.doc_index").alias("doc_index"), "block", F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = sums.groupBy("f").agg(F.sum("st").alias("all"), F.sum("sd").alias("docs"), F.coalesce(F.max(F.col("bt") + F.col("se")), F.lit(-1)).alias("last"), F.max("top").alias("top"))
    rest = totals.where("all > last + 1").select(F.col("f").alias("file"), F.col("docs").alias("doc_index"), F.col("top").alias("block"), (F.col("last") + 1).alias("start"), (F.col("all") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def _open(path: str):
    """A file of any size, opened for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 16, whole: int = 1 << 29, blocks_at_once: int = 1 << 10) -> DataFrame:
    """(file, block, data) of flat files under path, of any size.

    Files of up to `whole` bytes come through Spark's own reader, a row each while they are read; larger ones, which no row could hold, are read by tasks in ranges of
    `blocks_at_once` blocks through Arrow's file systems. The blocks are the same.
    """
    step = width * block_tokens

    def rows(name: str, first: int, data) -> Iterator[pa.RecordBatch]:
        for i, at in enumerate(range(0, len(data), step), first):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([data[at : at + step].to_pybytes()], pa.binary())], names=["file", "block", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if len(data) % width:
                    raise ValueError(f"{name} does not hold whole ids")
                yield from rows(name, 0, data)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % width:
                    raise ValueError(f"{name} does not hold whole ids")
                with _open(name) as f:
                    for block in range(first, min(first + blocks_at_once, -(-size // step))):
                        yield from rows(name, block, pa.py_buffer(f.read_at(min(step, size - block * step), block * step)))

    schema = "file string, block long, data binary"
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(cut, schema)
    firsts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step), F.lit(blocks_at_once).cast("long"))
    large = files.where(F.col("length") > whole).select("path", "length", F.explode(firsts).alias("first")).repartition(partitions(spark)).mapInArrow(ranges, schema)
    return small.unionByName(large)


def _stream(path: str, end_id: int, width: int, block_tokens: int):
    """Batches (id, text) to blocks (file, block, data) of the partition's token stream, cut wherever a block is full, beside the ids in the stream's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, name, number, first = byte_bpe.loaded(path), TaskContext.get().partitionId(), 0, 0
        end, step = np.array([end_id], dtype=_TYPES[width]).tobytes(), width * block_tokens
        waiting: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def put(data: bytes) -> pa.RecordBatch:
            nonlocal number, first, ids
            columns = [pa.array([name], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            number, first, ids = number + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "data", "first", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer(bpe.encode(text.as_py()), dtype="<u4")
                if len(codes) and (int(codes.max()) >= 1 << (8 * width) or np.any(codes == end_id)):
                    raise ValueError("an id doesn't fit the width, or is the separator's")
                piece = codes.astype(_TYPES[width]).tobytes() + end
                waiting.append(piece)
                ids.append(doc)
                size += len(piece)
                if size >= step:
                    data = b"".join(waiting)
                    full = size // step * step
                    for at in range(0, full, step):
                        yield put(data[at : at + step])
                    waiting, size = [data[full:]], size - full
        if size:
            yield put(b"".join(waiting))

    return run


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 2, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as flat token streams, one per partition, in blocks (file, block, data), and which documents these are (file, first, ids).

    ids says nothing of the blocks: a file's lists, one after the other, name its documents from the first on (first: how many the lists before name).
    end_id has to be an id that no text gives. Null and empty texts have no ids but the separator. Null ids, repeated ids and repeated rows are documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_stream(tokenizer_path, end_id, width, block_tokens), "file int, block long, data binary, first long, ids array<long>")
