"""Cost-balanced packing of tokenised documents into sequences of bounded length.

Each input partition packs its own documents as they stream by, so nothing is shuffled and no key can be hot. Of a
document, whole lengths become sequences of their own; the rest waits in a group of bounded size. A group's pieces go
in descending order to the sequence of lowest estimated attention cost (linear plus quadratic in the piece's length)
that still has room; a piece that fits nowhere is cut to fill what room is left. Under one sequence of tokens is
carried to the next group, and at a partition's end it is cut into sequences whose lengths are powers of two, which need no
padding: log2(size) sequences a partition at most, and no padding at all.

Null and empty texts: the closing id alone. Repeated rows are packed once each. A null id stays null. An empty table
gives no rows. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import byte_bpe
from folioscan.llm.common import configured


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences, each a list of (piece, start in it, length), all full, and what is left over: under size tokens."""
    count = sum(lengths) // size
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    if not count:
        return [], [(i, 0, lengths[i]) for i in order]
    cost, room = np.zeros(count), np.full(count, size)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    spare = []
    for i in order:
        n = lengths[i]
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:
            spare.append((i, 0, n))
            continue
        bins[at].append((i, 0, n))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    left = []
    gaps = [b for b in np.argsort(-room, kind="stable").tolist() if room[b]]
    for i, start, n in spare:
        while n and gaps:
            part = min(n, int(room[gaps[0]]))
            bins[gaps[0]].append((i, start, part))
            room[gaps[0]] -= part
            start, n = start + part, n - part
            if not room[gaps[0]]:
                gaps.pop(0)
        if n:
            left.append((i, start, n))
    return bins, left


def _rows(path: str, size: int, end_id: int, group: int, linear: float, quadratic: float):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number, base = byte_bpe.loaded(path), 0, TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        waiting: list[tuple] = []  # (id, start, ids, all tokens)

        def put(pieces) -> None:
            nonlocal number
            offset = 0
            for (doc, start, ids, total), skip, n in pieces:
                out.append((doc, start + skip, n, zlib.crc32(memoryview(ids)[4 * skip : 4 * (skip + n)]), total, base + number, offset))
                offset += n
            number += 1

        def settle() -> None:
            bins, left = pack([len(w[2]) // 4 for w in waiting], size, linear, quadratic)
            for b in bins:
                put([(waiting[i], start, n) for i, start, n in b])
            waiting[:] = [(waiting[i][0], waiting[i][1] + s, waiting[i][2][4 * s : 4 * (s + n)], waiting[i][3]) for i, s, n in left]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = bpe.encode(text.as_py()) + end, doc.as_py()
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    put([((doc, 0, ids, total), start, size)])
                if whole < total:
                    waiting.append((doc, whole, ids[4 * whole :], total))
                if len(waiting) >= group:
                    settle()
                if len(out) >= 10_000:
                    yield flush()
        settle()
        rest = sum(len(w[2]) // 4 for w in waiting)
        queue = [(w, 0, len(w[2]) // 4) for w in waiting]
        while rest:
            length = 1 << (rest.bit_length() - 1)
            rest -= length
            pieces = []
            while length:
                w, start, n = queue.pop(0)
                part = min(n, length)
                pieces.append((w, start, part))
                length -= part
                if part < n:
                    queue.insert(0, (w, start + part, n - part))
            put(pieces)
        yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, group: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    size: tokens of a sequence, a power of two; end_id closes each document; group: documents whose rests wait together; linear and
    quadratic: weights of the cost.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size has to be a power of two")
    configured(docs)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = plain.mapInArrow(_rows(tokenizer_path, size, end_id, group, linear, quadratic), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return rows.withColumnRenamed("doc_id", id_col)
