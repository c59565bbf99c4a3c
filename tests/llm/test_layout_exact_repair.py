"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, hot groups."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import clustered_layout, conversation_repair, exact_dedup

DOCS = "doc_id long, text string, recipe string, row long"


def _long(seed, n):
    return "".join(random.Random(seed).choices("abcdefghij \n", k=n))


# exact dedup


def test_chunks_follow_content():
    data = np.random.default_rng(5).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.MOST and sizes[:-1].min() >= exact_dedup.LEAST
    moved = exact_dedup.chunk_ends(b"some bytes in front" + data)
    assert len({e - 19 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert exact_dedup.chunk_ends(bytes(200_000))[:-1] == [exact_dedup.MOST * i for i in range(1, 4)]
    assert exact_dedup.chunk_ends(b"") == [0]


def _plain_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = ids.index(keep)
        out += [(i, keep, len(ids), n == kept, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("bits", [3, 64])
@pytest.mark.parametrize("hot", [2, 4096])
def test_exact_groups_equal_plain(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 1 << 30)
    texts = [None, "", "a", "A", "é", "é", "a\x00b", _long(1, 90_000), _long(1, 90_000)[:-1] + "z", _long(2, 30_000), _long(2, 30_000) * 2]
    rows = [(i, texts[i % len(texts)]) for i in range(40)] + [(7, "a"), (7, "a"), (None, "a"), (None, "only without id"), (None, None), (99, "alone")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(5)
    found = exact_dedup.exact_groups(docs, bits=bits, held=1 << 16)
    assert Counter(map(tuple, found.collect())) == _plain_groups(rows)


def test_exact_groups_of_rows_without_any_id_and_kept_columns(spark):
    docs = spark.createDataFrame([(None, "t", "p", 1), (None, "t", "q", 2)], DOCS)
    found = exact_dedup.exact_groups(docs, keep=["recipe", "row"]).collect()
    assert sorted(r["kept"] for r in found) == [False, True] and {(r["recipe"], r["row"]) for r in found} == {("p", 1), ("q", 2)}
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_shared_identifiers_are_not_taken_for_equal_chunks(spark):
    """With identifiers of one bit different texts share recipes; they are told apart by their bytes."""
    docs = spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(50)], DOCS)
    assert {r["group_size"] for r in exact_dedup.exact_groups(docs, bits=1).collect()} == {1}


# layout


def _plain_layout(rows, reach, size, bits=4):
    """rows: (id, values...)"""
    n, dims = len(rows), len(rows[0]) - 1
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    coordinates = []
    for d in range(dims):
        values = sorted(key(r[d + 1]) for r in rows)
        first = {}
        for i, v in enumerate(values):
            first.setdefault(v, i)
        coordinates.append([(first[key(r[d + 1])] << bits) // n for r in rows])
    cells = list(zip(*coordinates, strict=True))
    z = [int("".join(str(c >> b & 1) for b in reversed(range(bits)) for c in cell), 2) for cell in cells]
    order = sorted(range(n), key=lambda i: (z[i], key(rows[i][0])))
    files = [order[a : a + size] for a in range(0, n, size)]
    bounds = [[(min(cells[i][d] for i in f), max(cells[i][d] for i in f)) for d in range(dims)] for f in files]
    out = []
    for position, i in enumerate(order):
        inside = lambda j: all(abs(a - b) <= w for a, b, w in zip(cells[i], cells[j], reach, strict=True))  # noqa: E731, B023
        touched = sum(all(lo <= c + w and hi >= c - w for (lo, hi), c, w in zip(b, cells[i], reach, strict=True)) for b in bounds)
        matching = sum(any(inside(j) for j in f) for f in files)
        out.append((rows[i][0], z[i], position, position // size, touched, matching, ",".join(str(x) for b in bounds[position // size] for x in b)))
    return out


VALUES = "doc_id long, source string, size long, z string, file long"


def _dims():
    return [clustered_layout.Dimension("source", F.col("source"), 0, True), clustered_layout.Dimension("size", F.col("size"), 2)]


@pytest.mark.parametrize("size", [3, 50])
def test_layout_equals_plain(spark, size):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 5 + ["", "a", "Z", "é", "\U0001f600", "￿", None]), r.choice([7] * 3 + [None, *range(40)])) for i in range(300)]
    rows += [(None, "a", 3), (None, None, None), (5, "hot", 7), (5, "hot", 7)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], VALUES).repartition(4)
    found = clustered_layout.layout(docs, _dims(), rows_per_file=size).with_queries()
    columns = ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
    assert found.columns != [] and set(columns) <= set(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=lambda x: x[2]) == _plain_layout(rows, [0, 2], size)


def test_layout_of_one_value_and_of_none(spark):
    rows = [(i, "a", 1) for i in range(25)]
    found = clustered_layout.layout(spark.createDataFrame([(*x, "", 0) for x in rows], VALUES), _dims(), rows_per_file=4)
    assert len(found.tree.file) == 1
    got = found.with_queries().select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == _plain_layout(rows, [0, 2], 4)
    assert clustered_layout.layout(spark.createDataFrame([], VALUES), _dims()).with_queries().collect() == []


def test_tree_has_at_most_two_leaves_a_cell():
    cells = np.arange(0, 256, dtype=np.int64)
    counts = np.random.default_rng(1).integers(1, 5000, 256)
    tree = clustered_layout.PackedTree(cells, counts, 10, 2, 4)
    assert len(tree.file) <= 2 * len(cells) and tree.files.sum() == -(-counts.sum() // 10)
    assert (np.cumsum(tree.files) - tree.files == tree.file).all()


def test_written_layout_is_read_by_box(spark, tmp_path):
    rows = [(i, "abcd"[i % 4], i // 4, "", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, VALUES)
    found = clustered_layout.layout(docs.drop("z", "file"), _dims(), rows_per_file=10, keep=["source", "size"])
    found.write(str(tmp_path / "out"))
    got = found.read(str(tmp_path / "out"), ["b", 20], ["b", 40])
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(400) if i % 4 == 1 and 20 <= i // 4 <= 40]
    assert sum(n for _, n in found.files_for(["b", 20], ["b", 40])) < 12 and "PartitionFilters" in got._jdf.queryExecution().toString()


# repair


def _plain_repair(rows):
    """rows of one conversation in order: (role, text). Cheapest (cost, audit) by uniform-cost search, and its rows."""
    leads = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        nxt = 3 if state == 2 else 2
        word = "assistant" if nxt == 3 else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*out, word + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "t"):
                more = faults[i] == "t"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt, (*out, f"{word}:{text}")))
                if (role[:1], state) in leads:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, leads[role[:1], state], (*out, f"{role}:{text}")))
    first = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _plain_conversations(rows, ids):
    """rows: (conv_id, turn, role, text)"""
    out = {}
    for conv in ids:
        own = [(t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        name = "n" if conv is None else f"c{conv}"
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(f"{name}:{len(y[1])}:{y[1]}:{y[2]}".encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *_plain_repair([y[1:] for y in own]))
    return out


ROWS = "conv_id long, turn long, role string, text string, digest string, kind long"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_equals_plain(spark, block):
    r = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(0, 14)):
            if r.random() < 0.85:
                rows.append((conv, r.choice([turn, turn, turn, None, -turn]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "no", "", " \t\n", None, "é!", "a? ", f"t {turn}."])))
    rows += [(3, 2, "user", "Yes.")] * 9 + [(61, 0, "user", "x" * 300_000 + ".")] + [(62, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(50)]
    ids = [*range(70), None]
    frame = spark.createDataFrame([(*x, "clash", 5) for x in rows], ROWS).repartition(6)
    found = {x["conv_id"]: tuple(x)[1:] for x in conversation_repair.repair(frame, spark.createDataFrame([(i,) for i in ids], "conv_id long"), block=block).collect()}
    assert found == _plain_conversations(rows, ids)


def test_repair_of_hot_duplicates_and_empty(spark, monkeypatch):
    from folioscan.llm import common

    rows = [(1, i, "user", "again.") for i in range(300)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    monkeypatch.setattr(conversation_repair, "join_by_degree", lambda *a, hot, **k: common.join_by_degree(*a, hot=5, **k))
    found = {x["conv_id"]: tuple(x)[1:] for x in conversation_repair.repair(spark.createDataFrame([(*x, "", 0) for x in rows], ROWS), block=16).collect()}
    assert found == _plain_conversations(rows, [1, 2])
    assert found[2] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())
    assert conversation_repair.repair(spark.createDataFrame([], ROWS)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in [*range(8), None] for t in [*range(8), None]]
    got = Counter(tuple(r) for r in conversation_repair.damage(spark.createDataFrame([(*x, "", 0) for x in rows], ROWS)).collect())
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want[c, t, "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 else text] += 2 if k == 3 else 1
    assert got == want
