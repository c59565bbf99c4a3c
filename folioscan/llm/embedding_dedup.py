"""Embedding near-dedup: an exact metric range join under the angle between vectors.

Pivots (taken from the table by hash) partition the vectors: each lies in the cell of its nearest pivot, at its home angle. With
theta the link angle, a vector x is also sent to every cell p whose angle from x is at most the cell's greatest home angle plus theta, and whose
border is within reach: if y lives in cell p and angle(x, y) <= theta then, by the triangle inequality, angle(x, p) <= angle(y, p) + theta, and
angle(x, p) <= angle(x, home of x) + 2 theta. So every y meets all its partners in its own cell, and cells join independently. Inside a cell, blocks
of home vectors run against blocks of all vectors there; a product in single precision with a margin picks pairs, and the cosine in double precision
decides. A task emits counts and one link per vector and local group, never pairs.

Equal vectors are one class with a weight, so copies never meet. Cells that hold many vectors are dealt to a grid of tasks
(BLOCK home rows by WIDE rows each) by the vectors that they receive, counted beforehand, so no cell is one task's work. Counting the exact links of n mutually linked distinct vectors takes n**2 products.

Null, empty and zero vectors and those that hold null or non-finite components link with nothing; lists of different length
never link. Rows that share id and vector are copies that link; where an id has several vectors, its rows share the id's links and component. A null id has a null
component, kept is null, and links with nothing. Empty table: no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch, partitions
from folioscan.llm.components import connected_components
from folioscan.llm.vectors import matrices

#: Home vectors (fewer where they are long) and vectors held against them in one task, and bytes of home vectors.
BLOCK, WIDE, HOME_BYTES = 16_384, 32_768, 8 << 20
#: Vectors a cell should have, and pivots at most (what the driver gathers and every task holds).
CELL, PIVOTS = 8192, 1024
#: Bytes of vectors sent to tasks in one batch.
OUT_BYTES = 4 << 20
_MARGIN = 1e-4


def _unit(matrix: np.ndarray) -> np.ndarray:
    peak = np.abs(matrix).max(axis=1, keepdims=True)
    scaled = matrix / np.where(peak > 0, peak, 1)
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), 1e-300)


def _classes():
    """Batches (id, vector) to (id, key, vector as doubles); key and vector are null where the row can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            values: list[bytes | None] = [None] * batch.num_rows
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, m in matrices(batch.column(1)):
                for i, x in zip(rows.tolist(), m + 0.0, strict=True):
                    if known[i] and x.any():
                        values[i] = x.tobytes()
                        keys[i] = hashlib.blake2b(values[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["id", "key", "vector"])

    return run


def _bytes_matrix(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts = column.to_pylist()
    sizes = np.array([len(p) // 8 for p in parts])
    return {n: (rows := np.flatnonzero(sizes == n), np.frombuffer(b"".join(parts[i] for i in rows), dtype=np.float64).reshape(len(rows), n)) for n in np.unique(sizes).tolist()}


def _place(pivots: dict[int, tuple[int, np.ndarray]]):
    """Batches (id, vector, weight) to the same with the cell and the angle of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for n, (rows, m) in _bytes_matrix(batch.column(1)).items():
                first, p = pivots[n]
                a = np.arccos(np.clip(_unit(m) @ p.T, -1, 1))
                near = np.argmin(a, axis=1)
                cell[rows], angle[rows] = first + near, a[np.arange(len(rows)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "vector", "weight", "cell", "angle"])

    return run


def _reached(batch: pa.RecordBatch, pivots, radius: dict[int, float], theta: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, rows at home there, rows that can have partners there) of a batch (vector, cell, angle)."""
    homes, angles = np.asarray(batch.column(1)), np.asarray(batch.column(2))
    for n, (rows, m) in _bytes_matrix(batch.column(0)).items():
        first, p = pivots[n]
        a = np.arccos(np.clip(_unit(m) @ p.T, -1, 1))
        for c in range(first, first + len(p)):
            if c in radius:
                near = (a[:, c - first] <= radius[c] + theta) & (a[:, c - first] <= angles[rows] + 2 * theta)
                yield c, rows[homes[rows] == c], rows[near]


def _received(pivots, radius: dict[int, float], theta: float):
    """Batches (vector, cell, angle) to (cell, n): how many vectors of the task each cell gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for c, _, near in _reached(whole.slice(at, 1024), pivots, radius, theta):
                    count[c] = count.get(c, 0) + len(near)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["cell", "n"])

    return run


def _replicate(pivots, radius: dict[int, float], grid: dict[int, tuple[int, int]], theta: float):
    """Batches (id, vector, weight, cell, angle) to rows for each task (cell, h, w), home or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "h", "w", "home", "id", "weight", "vector"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                deal = (np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                most = max(1, OUT_BYTES * batch.num_rows // max(1, batch.column(1).nbytes))
                out: list[tuple] = []
                size = 0

                def emit() -> pa.RecordBatch:
                    rows, cell, h, w, home = (np.concatenate(x) for x in zip(*out, strict=True))
                    taken = pa.array(rows)
                    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(home), batch.column(0).take(taken), batch.column(2).take(taken), batch.column(1).take(taken)], names=names)

                for c, own, near in _reached(batch.select([1, 3, 4]), pivots, radius, theta):
                    high, wide = grid[c]
                    for rows, times, is_home in ((own, wide, True), (near, high, False)):
                        for j in range(times if len(rows) else 0):
                            given, dealt = np.full(len(rows), j), deal[rows] % (high if is_home else wide)
                            out.append((rows, np.full(len(rows), c), dealt if is_home else given, given if is_home else dealt, np.full(len(rows), is_home)))
                            size += len(rows)
                            if size >= most:
                                yield emit()
                                out, size = [], 0
                if out:
                    yield emit()

    return run


def _join(least: float):
    """Streams tasks' rows, sorted by (cell, h, w, home first), to (id, links, to): weighted count, and one linked vertex of the local group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        home: list[tuple[int, bytes]] = []
        state: dict = {}

        def start() -> None:
            m = _unit(np.frombuffer(b"".join(x[1] for x in home), dtype=np.float64).reshape(len(home), -1))
            state.update(ids=np.array([x[0] for x in home], dtype=np.int64), m=m, f=m.astype(np.float32), links=np.zeros(len(home), np.int64), edges=[], size=0)

        def meet(ids, weights, vectors) -> None:
            if not state:
                start()
            m = _unit(np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(ids), -1))
            f = m.astype(np.float32)
            for first in range(0, len(home), 1024):
                i, j = np.nonzero(state["f"][first : first + 1024] @ f.T >= least - _MARGIN)
                for at in range(0, len(i), 100_000):
                    x, y = i[at : at + 100_000] + first, j[at : at + 100_000]
                    fits = (np.einsum("ij,ij->i", state["m"][x], m[y]) >= least) & (state["ids"][x] != ids[y])
                    x, y = x[fits], y[fits]
                    np.add.at(state["links"], x, weights[y])
                    state["edges"].append(_forest(np.column_stack([state["ids"][x], ids[y]])))
                    state["size"] += len(state["edges"][-1])
                    if state["size"] > 200_000:
                        state["edges"] = [_forest(np.vstack(state["edges"]))]
                        state["size"] = 0

        def close():
            if state:
                edges = _forest(np.vstack([np.zeros((0, 2), np.int64), *state["edges"]]))
                ids = np.concatenate([state["ids"], edges[:, 0]])
                links = np.concatenate([state["links"], np.zeros(len(edges), np.int64)])
                to = pa.array(np.concatenate([np.zeros(len(home), np.int64), edges[:, 1]]), mask=np.arange(len(ids)) < len(home))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), to], names=["id", "links", "to"])
            home.clear()
            state.clear()

        for batch in batches:
            keys = np.column_stack([np.asarray(batch.column(i)) for i in range(3)])
            own = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (own[1:] != own[:-1])) + 1 if len(keys) else []
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if tuple(keys[a]) != task:
                    yield from close()
                    task = tuple(keys[a])
                part = batch.slice(a, b - a)
                if own[a]:
                    home.extend(zip(part.column(4).to_pylist(), part.column(6).to_pylist(), strict=True))
                elif home:
                    for s in range(0, len(part), 4096):
                        c = part.slice(s, 4096)
                        meet(np.asarray(c.column(4)), np.asarray(c.column(5)), c.column(6).to_pylist())
        yield from close()

    return run


def _forest(edges: np.ndarray) -> np.ndarray:
    """Edges that connect what edges connect, each vertex to the least of its group: under one per vertex."""
    edges = edges[edges[:, 0] != edges[:, 1]]
    if not len(edges):
        return edges.reshape(0, 2)
    names, flat = np.unique(edges, return_inverse=True)
    flat = flat.reshape(-1, 2)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[flat[:, 0]], label[flat[:, 1]])
        new = label.copy()
        np.minimum.at(new, flat[:, 0], low)
        np.minimum.at(new, flat[:, 1], low)
        np.minimum.at(new, label[flat[:, 0]], low)
        np.minimum.at(new, label[flat[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(len(names))
    return np.column_stack([names[tied], names[label[tied]]])


def range_links(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row; links are pairs of rows whose cosine is at least `least`."""
    if not 0 < least <= 1:
        raise ValueError("least has to be over 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "range")
    theta = float(np.arccos(least)) + 1e-9
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = scratch.table(plain.mapInArrow(_classes(), "id long, key binary, vector binary"), "vectors")
    classes = scratch.table(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("vector").alias("vector")), "classes")
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    for r in classes.groupBy(F.length("vector").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():
        few = classes.where(F.length("vector") == r["size"]).orderBy(F.xxhash64("key"), "key").select("vector").limit(min(PIVOTS, -(-r["n"] // cell))).collect()
        pivots[r["size"] // 8] = (sum(len(p) for _, p in pivots.values()), _unit(np.array([np.frombuffer(x["vector"]) for x in few])))
    placed = scratch.table(classes.select("id", "vector", "weight").mapInArrow(_place(pivots), "id long, vector binary, weight long, cell int, angle double"), "placed")
    cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radius = {r["cell"]: r["radius"] + 1e-9 for r in cells}
    held = {c: max(1, min(block, HOME_BYTES // (8 * n))) for n, (first, p) in pivots.items() for c in range(first, first + len(p))}
    near = placed.select("vector", "cell", "angle").mapInArrow(_received(pivots, radius, theta), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    received = {r["cell"]: r["n"] for r in near}
    grid = {r["cell"]: (-(-r["n"] // held[r["cell"]]), max(1, -(-received.get(r["cell"], 0) // wide))) for r in cells}
    dealt = placed.mapInArrow(_replicate(pivots, radius, grid, theta), "cell int, h int, w int, home boolean, id long, weight long, vector binary")
    ordered = dealt.repartition(partitions(spark), "cell", "h", "w").sortWithinPartitions("cell", "h", "w", F.col("home").desc())
    found = scratch.table(ordered.mapInArrow(_join(least), "id long, links long, to long"), "links")
    merged = connected_components(found.where("to is not null").select(F.col("id").alias("u"), F.col("to").alias("v")), scratch)
    links = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    judged = classes.select("key", "id", "weight").join(links, "id", "left").join(merged, "id", "left")
    judged = scratch.table(judged.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "judged")
    scratch.keep(rows, judged)
    component = F.coalesce("component_id", "id")
    out = rows.select("id", "key").join(judged, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
