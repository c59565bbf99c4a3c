"""Repair of conversations: the cheapest edits that make roles alternate, by Dial's bucket-queue shortest paths over (row, role state).

A repaired conversation's role initials are `(s?(ua)+)?`. Keeping a row costs 0 and is possible where its initial fits, making it user or assistant 2, deleting it 3, inserting an empty row 2;
a truncated row that stays adds 1; blank rows and duplicates have to go. Of the cheapest edits those whose initials (K, R, D, I) come first in ASCII order are taken: distances to
the end are recorded, then arcs on which the distance falls by just their cost are walked, least initial first.

A conversation of any length is cut into blocks wherever the range sort or the block size cuts it. Each block's costs between its four entry and four exit states are found by itself; a scan from the last block
to the first adds them up, which gives each block the costs beyond its end; each block is then walked from all four states by itself, and the final pass, in the rows' order, takes
the walk of the state that it is in. So no task holds a conversation, and what scans read of a block is a few numbers. Rows move with their texts once, for the final hash, which
has to see a conversation's texts in order: they stream through one task and aren't gathered there. Duplicates are found by a digest of conversation, role and text that is counted before it is joined.

Null conversations are one conversation, null turns come first, null roles and texts are one space. Rows of one turn are ordered by role, then by the digest. Repeated rows are next to one another, so all but
the first are duplicates (or blank). Empty and very long texts work; extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch, configured, join_by_degree, partitions

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a block.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing so far, after system, after user, after assistant. Where a role's initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What completes a conversation after each state, and its cost.
ENDING = ["", "II", "I", ""]
BEYOND = (0, 2 * INSERT, INSERT, 0)
#: A row's code: its initial in 'sua' or 3, and 4 times its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


@functools.lru_cache(maxsize=None)
def _arcs(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row with this code: (initial, state after, cost), least initial first."""
    initial, fault = "sua?"[code & 3], code >> 2
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = CUT if fault == TRUNCATED else 0
            if state in LEADS.get(initial, {}):
                arcs.append(("K", LEADS[initial][state], KEEP + more))
            arcs.append(("R", NEXT[state], REROLE + more))
        out.append(tuple(arcs))
    return tuple(out)


@functools.lru_cache(maxsize=None)
def _arriving(code: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each state after a row: (state before, cost)."""
    return tuple(tuple((a, cost) for a in range(4) for _, b, cost in _arcs(code)[a] if b == state) for state in range(4))


@functools.lru_cache(maxsize=4096)
def distances(codes: bytes, beyond: tuple[int, ...]) -> list[list[int]]:
    """distances[i][state]: the least cost from before row i to the end of the block, and from there what `beyond` says. Dial's algorithm, backwards."""
    n, far = len(codes), 1 << 60
    found = [[far] * 4 for _ in range(n + 1)]
    buckets: dict[int, list[tuple[int, int]]] = {}
    for state, cost in enumerate(beyond):
        if cost < far:
            buckets.setdefault(cost, []).append((n, state))
    at = min(buckets, default=0)
    while buckets:
        queue = buckets.get(at)
        if not queue:
            buckets.pop(at, None)
            at += 1
            continue
        i, state = queue.pop()
        if found[i][state] <= at:
            continue
        found[i][state] = at
        if i < n:  # an insertion before row i; those at the end are the next block's, or the ending
            for before, after in NEXT.items():
                if after == state and found[i][before] > at + INSERT:
                    buckets.setdefault(at + INSERT, []).append((i, before))
        if i:
            for before, cost in _arriving(codes[i - 1])[state]:
                if found[i - 1][before] > at + cost:
                    buckets.setdefault(at + cost, []).append((i - 1, before))
    return found


def walk(codes: bytes, found: list[list[int]], state: int) -> tuple[str, int]:
    """(initials, state at the end) of the cheapest edits from a state, least in ASCII order, along tight arcs."""
    out, i = [], 0
    while i < len(codes):
        left = found[i][state]
        steps = [(e, i + 1, s, c) for e, s, c in _arcs(codes[i])[state]] + [("I", i, NEXT[state], INSERT)]
        edit, i, state, _ = min(s for s in steps if found[s[1]][s[2]] + s[3] == left)
        out.append(edit)
    return "".join(out), state


@functools.lru_cache(maxsize=65536)
def _matrix(codes: bytes) -> tuple[int, ...]:
    """Costs from each state before a block to each after it, row by row."""
    far = 1 << 60
    ends = [distances(codes, tuple(0 if s == end else far for s in range(4)))[0] for end in range(4)]
    return tuple(ends[end][start] for start in range(4) for end in range(4))


@functools.lru_cache(maxsize=65536)
def _walks(codes: bytes, beyond: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    found = distances(codes, beyond)
    return tuple(walk(codes, found, state) for state in range(4))


def _columns(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    digest = F.unhex(F.sha2(F.concat_ws(":", conv, F.length(role).cast("string"), role, text), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), text.alias("text"))


def _fault(text: Column) -> tuple[Column, Column]:
    """(blank, truncated)"""
    end = F.rtrim(text, F.lit(SPACE))
    return end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")


BLOCKS = "conv_id {}, turn long, role string, digest binary, seq long, part long, codes binary, costs array<long>, facts array<long>, low long, high long"


def _blocks(types: pa.DataType, size: int):
    """Sorted rows (conv_id, turn, role, digest, initial, blank, truncated, duplicate, n, seq) to blocks with the key of their first row."""
    kinds = [types, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["conv_id", "turn", "role", "digest", "seq", "part", "codes", "costs", "facts", "low", "high"]

    def block(key: tuple, codes: bytearray, turns: list[int]) -> tuple:
        """facts: rows, blank, duplicate, truncated, illegal inside, different turns, first and last initial."""
        faults = [sum(c >> 2 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
        roles = [c & 3 for c in codes]
        illegal = sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))
        return *key, bytes(codes), list(_matrix(bytes(codes))), [len(codes), *faults, illegal, len(set(turns)), roles[0], roles[-1]], min(turns, default=None), max(turns, default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, turns, out = None, bytearray(), [], []
        for batch in batches:
            for conv, turn, role, digest, initial, blank, truncated, duplicate, n, seq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fault = BLANK if blank else DUPLICATE if duplicate else TRUNCATED if truncated else SOUND
                code, again = initial + 4 * fault, initial + 4 * (BLANK if blank else DUPLICATE)
                part = 0
                while n:
                    if key is None or key[0] != conv or len(codes) == size:
                        if key is not None:
                            out.append(block(key, codes, turns))
                        key, codes, turns = (conv, turn, role, digest, seq, part), bytearray(), []
                        part += 1
                    codes.append(code)
                    more = min(n - 1, size - len(codes))
                    codes.extend([again] * more)
                    n, code = n - 1 - more, again
                    if turn is not None and (not turns or turns[-1] != turn):
                        turns.append(turn)
                if len(out) >= 512:
                    yield made(out)
                    out = []
        if key is not None:
            out.append(block(key, codes, turns))
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation, last first (conv_id, costs, ...), with the costs beyond their end, less the least of them, and that: base."""
    conv, now = None, None
    for batch in batches:
        beyond, base = [], []
        for c, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if now is None or c != conv:
                conv, now = c, list(BEYOND)
            least = min(now)
            beyond.append([x - least for x in now])
            now = [min(costs[4 * start + end] + now[end] for end in range(4)) for start in range(4)]
            base.append(now[START])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beyond, pa.list_(pa.int64())), pa.array(base, pa.int64())], names=[*batch.schema.names, "beyond", "cost"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(codes, beyond, ...) to walks and exits from each state, instead of those two."""
    for batch in batches:
        found = [_walks(codes, tuple(beyond)) for codes, beyond in zip(batch.column("codes").to_pylist(), batch.column("beyond").to_pylist(), strict=True)]
        made = [pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[e for _, e in f] for f in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*batch.schema.names[2:], "walks", "exits"])


class _Conversation:
    """What the final pass knows of a conversation: a hash, edits to come, counts."""

    def __init__(self):
        self.hash, self.some, self.state, self.audit, self.edits = hashlib.sha256(), False, START, io.StringIO(), deque()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.low = self.high = self.last = None
        self.seen = False

    def block(self, walks: list[str], exits: list[int], facts: list[int], low: int | None, high: int | None, cost: int) -> None:
        if not self.seen:
            self.cost, self.seen = cost, True
        self.audit.write(walks[self.state])
        self.edits.append(walks[self.state])
        self.state = exits[self.state]
        _, blank, duplicate, truncated, illegal, turns, first, last = facts
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.last is not None and (self.last, first) not in LEGAL)
        self.last = last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True


class _Writer:
    """Rows of one conversation to its hash, following the edits block by block."""

    def __init__(self, c: _Conversation):
        self.c, self.now, self.i, self.state = c, "", 0, START

    def edit(self) -> str:
        while self.i == len(self.now):
            self.now, self.i = self.c.edits.popleft(), 0
        self.i += 1
        return self.now[self.i - 1]

    def row(self, role: str, text: str) -> None:
        while (edit := self.edit()) == "I":
            self.insert()
        if edit == "D":
            return
        self.state = NEXT[self.state] if edit == "R" else LEADS[role[0]][self.state]
        self.c.put({USER: "user", ASSISTANT: "assistant"}[self.state] if edit == "R" else role, text)

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.c.put("user" if self.state == USER else "assistant", "")

    def result(self) -> tuple:
        c = self.c
        ending = ENDING[c.state]
        c.audit.write(ending)
        for _ in ending:
            self.insert()
        gaps = 0 if c.low is None else c.high - c.low + 1 - c.turns
        return gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit.getvalue(), c.hash.hexdigest()


#: Kinds of rows of the final pass, in the order in which rows with one key come.
THERE, BLOCK_OF_EDITS, ROW = range(3)
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _final(types: pa.DataType):
    kinds = [types, *[pa.int64()] * 6, pa.string(), pa.string()]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, out = None, None, []
        for batch in batches:
            for c, kind, role, text, walks, exits, facts, low, high, cost in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    conv, now = c, _Writer(_Conversation())
                if kind == ROW:
                    now.row(role, text)
                elif kind == BLOCK_OF_EDITS:
                    now.c.block(walks, exits, facts, low, high, cost)
            if len(out) >= 512:
                yield made(out)
                out = []
        if now is not None:
            out.append((conv, *now.result()))
        if out:
            yield made(out)

    return run


def repair(rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text) and of conversations (conv_id), which may name some that have no rows:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = configured(rows)
    scratch = Scratch(spark, "repair")
    kind = rows.schema["conv_id"].dataType
    arrow = pa.string() if kind.typeName() == "string" else pa.int64()
    named = rows if arrow == pa.string() else rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    texts = _columns(named)
    blank, truncated = _fault(F.col("text"))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("s", 0), ("u", 1), ("a", 2)) for x in p]), F.substring("role", 1, 1)), F.lit(3))
    narrow = texts.select("conv_id", "turn", "role", "digest", initial.cast("long").alias("initial"), blank.alias("blank"), truncated.alias("truncated"))
    narrow = scratch.table(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")), "rows")
    n_rows = narrow.count()
    first = narrow.groupBy("digest").agg(F.count("*").alias("k"), F.bool_or(F.col("turn").isNull()).alias("early"), F.min("turn").alias("least")).where("k > 1")
    narrow = join_by_degree(narrow, first, ["digest"], "k", n_rows, scratch, hot=max(4096, n_rows // 100_000), how="left")
    later = F.when(F.col("early"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    narrow = narrow.select("conv_id", "turn", "role", "digest", "initial", "blank", "truncated", F.coalesce(later, F.lit(False)).alias("duplicate"), "n")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    blocks = narrow.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()).mapInArrow(_blocks(arrow, block), BLOCKS.format("string" if arrow == pa.string() else "long"))
    blocks = scratch.table(blocks, "blocks")
    p = partitions(spark)
    back = blocks.repartition(p, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("seq").desc(), F.col("part").desc())
    back = back.mapInArrow(_beyond, f"{_ddl(blocks)}, beyond array<long>, cost long").drop("costs")
    each = back.select("codes", "beyond", *[c for c in back.columns if c not in ("codes", "beyond")]).repartition(p, "seq", "part")
    walked = each.mapInArrow(_walked, f"{_ddl(each.drop('codes', 'beyond'))}, walks array<string>, exits array<long>")
    ids = (conversations if conversations is not None else rows).select(F.col("conv_id").cast("string" if arrow == pa.string() else "long").alias("conv_id")).distinct()
    columns = ["conv_id", "kind", "turn", "role", "digest", "seq", "part", "text", "walks", "exits", "facts", "low", "high", "cost"]
    both = (
        texts.withColumn("kind", F.lit(ROW)).unionByName(walked.withColumn("kind", F.lit(BLOCK_OF_EDITS)), allowMissingColumns=True)
        .unionByName(ids.withColumn("kind", F.lit(THERE)), allowMissingColumns=True).select(*columns)
    )
    # THERE first: it has no turn, role or digest, and rows without turn have both of the others
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "kind", "seq", "part")]
    # by an expression: a repartition by the column itself is left out where all parts of the union seem to be dealt by it, which adaptive joins then undo
    both = both.repartition(p, F.xxhash64("conv_id")).sortWithinPartitions(*order)
    both = both.select("conv_id", "kind", "role", "text", "walks", "exits", "facts", "low", "high", "cost")
    found = both.mapInArrow(_final(arrow), f"conv_id {'string' if arrow == pa.string() else 'long'}, {', '.join(f'{c} long' for c in RESULT[:6])}, audit string, repaired_sha256 string")
    return found.select(F.col("conv_id").cast(kind).alias("conv_id"), *RESULT)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; nulls of the last two: one space) with faults of known kinds, by crc32 of `conv_id:turn` modulo 20 (nulls there: one space, too): 0 drops the row, 1 empties its
    text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    hurt = hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "kind")
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")
