"""Removal of byte strings that repeat anywhere in a corpus, by enhanced suffix arrays over sampled suffixes.

Every string of `length` bytes holds a sampled suffix at the same place in each of its copies: the start of its least-hashed gram (a
minimiser). So instead of all suffixes, one in some `length / 2` is sorted, and what a sampled suffix needs is its context, the
`length` bytes to its right and as many less a gram to its left.

1. Sampled suffixes are written as (hash of the gram, hash of the context, place), of a text that occurs often in a task twice at most. Contexts that are equal,
   in both hashes of 64 bits, collapse by a map-side combined count; each string in a context that occurs twice repeats.
   A Bloom filter of the contexts that matter (16 MB at most) passes over most other suffixes before these are joined with them.
2. Where several contexts share a gram, their bytes are fetched and grouped by gram. A group is sorted into a suffix array with common
   prefixes; a stack scan gives the common-prefix intervals, and the left contexts of an interval's members, sorted, tell how far each
   pair extends to the left (where they differ at once, the interval is left-diverse). Common prefix and left extension of `length` bytes
   together make a repeat; an interval holds all occurrences, not only neighbours. Groups of two, which have one interval, are scanned together.
3. Groups over GROUP contexts (a passage that very many documents share) aren't gathered: the strings around their suffixes are compared by hash
   in bands that narrow from level to level, down to single strings, each level a map-side combined count. This is exact as well.
4. Repeated strings join into spans for each distinct text, and texts are cut where they are.

Passages of so many words are found alike, in the same passes, in texts of `CODE` bytes a word: a passage of n words repeats where the n * CODE bytes of its
words' codes do. Words are what ASCII white space parts, case and all; the white space between them doesn't count.

Texts are read again for contexts and for cutting; those of which nothing is asked stay where they are, as long as the keys of the others can be broadcast.

Texts are UTF-8 bytes; null is empty. Texts under `length` bytes never change. Strings are judged on the input. Repeated rows are occurrences
of their own. Ids may be null or repeat. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import U64, Scratch, configured, join_by_degree, maybe_broadcast, mix64, partitions
from folioscan.llm.exact_dedup import _filter
from folioscan.llm.textcodes import bounds, hashes, pieces

GRAM = 32
#: Bytes of a word's code: different words share one with probability 2**-48.
CODE = 6
#: Contexts of one gram that one task sorts at most, some 20 MB. A context moves once to be sorted, and some ten times as many bytes to be compared in bands.
GROUP = 16_384
#: Bytes sampled at once: a long text in pieces, short texts together.
PIECE = 1 << 18
#: Texts of a task whose keys are held to pass over further copies; beyond that the memory of them starts anew.
SEEN = 100_000
_PLACE = 20
_LANES = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_KEY, _CTX = ["k1", "k2"], ["gram", "ctx"]


def _grams(buf: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on."""
    lanes = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,)).copy()
    n = len(buf) - GRAM + 1
    out = lanes[:n] * _LANES[0]
    for i in (1, 2, 3):
        out += lanes[8 * i : 8 * i + n] * _LANES[i]
    return mix64(out + U64(salt))


def sample(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in buf, gram) of the sampled suffixes of the texts starts:stops of buf, which has under 2**20 bytes and holds GRAM at least."""
    reach = length - GRAM
    counts = np.maximum(stops - starts - length + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    g = _grams(buf, salt)
    m = (g >> U64(_PLACE) << U64(_PLACE)) | np.arange(len(g), dtype=U64)
    span = 1
    while 2 * span <= reach + 1:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span <= reach:
        m = np.minimum(m[: span - reach - 1], m[reach + 1 - span :])
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
    own = (m[first] & U64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.concatenate(([True], own[1:] != own[:-1]))
    return text[new], own[new], g[own[new]]


def _contexts_of(data: memoryview, places: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the contexts of places in data; low, high: where the text of each begins and ends."""
    left, right = np.maximum(places - (length - GRAM), low), np.minimum(places + length, high)
    found = [xxhash.xxh3_64_intdigest(data[a:b], p - a) for p, a, b in zip(places.tolist(), left.tolist(), right.tolist(), strict=True)]
    return np.array(found, dtype=U64)


def anchors(texts: list[memoryview], length: int, salt: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in it, gram, context) of the sampled suffixes of texts, for runs of texts or pieces of one text."""
    run: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = b"".join(texts[i] for i in run)
        sizes = np.array([len(texts[i]) for i in run], dtype=np.int64)
        stops = np.cumsum(sizes)
        text, place, gram = sample(np.frombuffer(data, dtype=np.uint8), stops - sizes, stops, length, salt)
        ctx = _contexts_of(memoryview(data), place, (stops - sizes)[text], stops[text], length)
        return np.array(run)[text], place - (stops - sizes)[text], gram, ctx

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > PIECE:
            last = -1
            for first in range(0, len(t) - length + 1, PIECE):
                buf = np.frombuffer(t[first : min(len(t), first + PIECE + length - 1)], dtype=np.uint8)
                _, place, gram = sample(buf, np.zeros(1, np.int64), np.array([len(buf)]), length, salt)
                place = place + first
                new = place > last
                place, gram = place[new], gram[new]
                if len(place):
                    last = int(place[-1])
                    yield np.full(len(place), i), place, gram, _contexts_of(t, place, np.zeros(len(place), np.int64), np.full(len(place), len(t)), length)
            continue
        if size + len(t) > PIECE:
            yield together()
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield together()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of one text begin and end, and their hashes."""
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
    for at, to in pieces(data):
        begin, end = bounds(data[at:to], np.zeros(1, np.int64))
        out.append((begin + at, end + at, hashes(data[at:to], begin, end)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))  # type: ignore[return-value]


def coded(data: memoryview) -> memoryview:
    """The codes of a text's words, CODE bytes each."""
    return memoryview(words(np.frombuffer(data, dtype=np.uint8))[2].view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, end) of a suffix array by a stack scan, inner before outer; lcp[i]: of suffixes i and i+1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > value:
            common, first = stack.pop()
            yield common, first, i + 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _common(matrix: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows x and y."""
    differ = matrix[x] != matrix[y]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return np.minimum(at, np.minimum(sizes[x], sizes[y]))


def _ordered(matrix: np.ndarray) -> np.ndarray:
    """The order of the rows as byte strings."""
    rows = [r.tobytes() for r in matrix]
    return np.array(sorted(range(len(rows)), key=rows.__getitem__), dtype=np.int64)


def repeat_groups(right: np.ndarray, right_sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(common prefix, members, left extension of each member) of the intervals in which some string of length bytes repeats.

    right: bytes from the suffix on, left: bytes before it, backwards; both padded. A member's left extension is the longest that it shares
    with another member of the interval; 0 where the bytes before it already differ from all others.
    """
    order = _ordered(right)
    lcp = _common(right, right_sizes, order[:-1], order[1:])
    by_left = np.empty(len(order), np.int64)
    by_left[_ordered(left)] = np.arange(len(order))
    for common, first, end in intervals(lcp):
        if common < gram:
            continue
        members = order[first:end]
        members = members[np.argsort(by_left[members])]
        beside = _common(left, left_sizes, members[:-1], members[1:])
        extension = np.maximum(np.concatenate(([0], beside)), np.concatenate((beside, [0])))
        if common + extension.max() >= length:
            yield common, members, extension


def _anchors(lengths: tuple[int, ...]):
    """Batches (doc, k1, k2, text) to (doc, k1, k2, view, place, gram, ctx); lengths: of the strings in each view, bytes and words' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "k1", "k2", "view", "place", *_CTX]
        seen: dict[int, int] = {}
        for batch in batches:
            once = []
            for i, (k1, k2) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                # A third copy tells nothing more than a second one: its strings repeat.
                times = seen.get(key := k1 << 64 | k2 & (1 << 64) - 1, 0)
                if times < 2:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = times + 1
                    once.append(i)
            for at in range(0, len(once), 256):
                rows = once[at : at + 256]
                texts = [memoryview(batch.column(3)[i].as_buffer()) for i in rows]
                for view, length in enumerate(lengths):
                    if not length:
                        continue
                    if view:
                        texts = [coded(t) for t in texts]
                    for text, place, gram, ctx in anchors(texts, length, view):
                        own = pa.array(np.array(rows)[text])
                        columns = [batch.column(i).take(own) for i in range(3)]
                        columns += [pa.array(np.full(len(text), view, np.int8)), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _passing(words, size: int):
    """Batches to the rows whose ctx passes the Bloom filter of `size` bits that words holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(words.value, U64)
        for batch in batches:
            ctx = batch.column("ctx").to_numpy(zero_copy_only=False).view(U64)
            both = [x & U64(size - 1) for x in (ctx, ctx >> U64(32))]
            fits = np.logical_and(*((bits[x >> U64(6)] >> (x & U64(63)) & U64(1)).astype(bool) for x in both))
            if fits.any():
                yield batch.filter(pa.array(fits))

    return run


_CONTEXT = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("view", pa.int8()), ("n", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])


def _contexts(lengths: tuple[int, ...]):
    """Batches (places, text) to the bytes around the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for places, text in zip(batch.column(0), batch.column(1), strict=True):
                found = places.as_py()
                plain = memoryview(text.as_buffer())
                views = [plain, coded(plain) if any(x["view"] for x in found) else plain]
                for x in found:
                    p, length, data = x["place"], lengths[x["view"]], views[x["view"]]
                    out.append((x["gram"], x["ctx"], x["view"], x["n"], bytes(data[max(0, p - length + GRAM) : p]), bytes(data[p : p + length])))
                    if len(out) >= 4096:
                        yield _batch(out, _CONTEXT)
                        out = []
            yield _batch(out, _CONTEXT)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width), sizes


_RANGE = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _settle(members: list[list[tuple]], length: int) -> list[tuple]:
    """(gram, ctx, low, high) of the groups' members that hold repeated strings: the offsets before the suffix at which these start."""
    reach = length - GRAM
    out: list[tuple] = []
    if pairs := [m for own in members if len(own) == 2 for m in own]:
        left, left_sizes = _matrix([m[4][::-1] for m in pairs], reach)
        right, right_sizes = _matrix([m[5] for m in pairs], length)
        x = np.arange(0, len(pairs), 2)
        back, ahead = _common(left, left_sizes, x, x + 1), _common(right, right_sizes, x, x + 1)
        for i in np.flatnonzero(back + ahead >= length).tolist():
            out += [(*m[:2], length - int(ahead[i]), int(back[i])) for m in pairs[2 * i : 2 * i + 2] if m[3] == 1]
    for own in members:
        if len(own) < 3:
            continue
        left, left_sizes = _matrix([m[4][::-1] for m in own], reach)
        right, right_sizes = _matrix([m[5] for m in own], length)
        low, high = np.full(len(own), length), np.full(len(own), -1)
        for common, held, extension in repeat_groups(right, right_sizes, left, left_sizes, length):
            fits = common + extension >= length
            held, extension = held[fits], extension[fits]
            low[held] = np.minimum(low[held], length - common)
            high[held] = np.maximum(high[held], extension)
        out += [(*m[:2], int(a), int(b)) for m, a, b in zip(own, low, high, strict=True) if b >= 0 and m[3] == 1]
    return out


def _resolve(lengths: tuple[int, ...]):
    """Streams contexts (gram, ctx, view, n, before, after) sorted by gram to the offsets of repeated strings; contexts that occur twice repeat as a whole, and stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[list[tuple]]] = [[] for _ in lengths]
        own: dict[int, tuple] = {}
        gram, held = None, 0

        def close() -> None:
            nonlocal held
            if len(own) > 1:
                groups[next(iter(own.values()))[2]].append(list(own.values()))
                held += len(own)

        def settle() -> pa.RecordBatch:
            return _batch([x for view, length in enumerate(lengths) for x in _settle(groups[view], length)], _RANGE)

        for batch in batches:
            for m in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if m[0] != gram:
                    close()
                    own, gram = {}, m[0]
                    if held > 4096:
                        yield settle()
                        groups, held = [[] for _ in lengths], 0
                own[m[1]] = m
        close()
        yield settle()

    return run


_BAND = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("view", pa.int8()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("outer", pa.int64()), ("inner", pa.int64())])


def _bands(lengths: tuple[int, ...], widths: tuple[int, ...]):
    """Batches (gram, ctx, view, n, before, after, first, last) to a row for each band of its view's width of offsets: hashes of what all its strings span and share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for gram, ctx, view, n, before, after, low, high in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                text, at, length, width = before + after, len(before), lengths[view], widths[view]
                for first in range(low, high + 1, width):
                    last = min(first + width - 1, high, length - GRAM)
                    a, b = at - first, at - last + length
                    if a < 0 or b > len(text):
                        continue
                    whole = at - last >= 0 and at - first + length <= len(text)
                    # Hashes meet within their gram and offsets only.
                    outer = xxhash.xxh3_64_intdigest(text[at - last : at - first + length], 2 * first) - (1 << 63) if whole else None
                    out.append((gram, ctx, view, n, first, last, outer, xxhash.xxh3_64_intdigest(text[a:b], 2 * first + 1) - (1 << 63)))
                if len(out) >= 16_384:
                    yield _batch(out, _BAND)
                    out = []
            yield _batch(out, _BAND)

    return run


def _by_hash(contexts: DataFrame, lengths: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """(gram, ctx, low, high) of groups too large to sort, by narrowing bands of offsets."""
    bytes_ = contexts.select(*_CTX, "view", "n", "before", "after")
    whole = F.element_at(F.array(*(F.lit(n - GRAM) for n in lengths)), F.col("view") + 1)
    open_ = bytes_.select("*", F.lit(0).alias("first"), whole.alias("last"))
    found = None
    widths = tuple(max(1, n - GRAM + 1) for n in lengths)
    while max(widths) > 1:
        widths = tuple(max(1, -(-w // 8)) for w in widths)
        bands = scratch.table(open_.mapInArrow(_bands(lengths, widths), "gram long, ctx long, view tinyint, n long, first int, last int, outer long, inner long"), "bands")
        twice = lambda t, c: t.groupBy("gram", c).agg(F.sum("n").alias("all")).where("all > 1")
        kept = scratch.table(join_by_degree(bands, twice(bands, "inner"), ["gram", "inner"], "all", bands.count(), scratch).drop("inner"), "kept")
        known = kept.where("outer is not null")
        flagged = join_by_degree(known, twice(known, "outer").withColumn("outer_twice", F.lit(True)), ["gram", "outer"], "all", kept.count(), scratch, how="left")
        judged = scratch.table(flagged.unionByName(kept.where("outer is null"), allowMissingColumns=True), "judged")
        scratch.drop(bands)
        done = scratch.table(judged.where("outer_twice").groupBy(*_CTX).agg(F.min("first").alias("low"), F.max("last").alias("high"), F.min("n").alias("n")), "done")
        found = done if found is None else found.unionByName(done)
        if max(widths) > 1:
            # Settled bands stay as partners of the open ones: one context for each distinct string, counted as two.
            partners = judged.where("outer_twice").groupBy("gram", "first", "last", "outer").agg(F.min("ctx").alias("ctx")).select("gram", "ctx", F.lit(2).cast("long").alias("n"), "first", "last")
            rows = judged.where("outer_twice is null").select(*_CTX, "n", "first", "last").unionByName(partners)
            open_ = rows.join(bytes_.drop("n"), _CTX).select(*_CTX, "view", "n", "before", "after", "first", "last")
    return found.groupBy(*_CTX).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("n").alias("n")).where("n = 1").drop("n")


def _keys(text) -> tuple:
    """What tells texts apart: their MD5 as two numbers."""
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, i, 16), 16, -10).cast("long").alias(k) for i, k in zip((1, 17), _KEY, strict=True))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, n_words: int | None = None) -> DataFrame:
    """(k1, k2, view, low, high): byte ranges of each text that hold repeated strings of length bytes (view 0), or of the codes of n_words words (view 1); they may overlap.

    A text's key k1, k2 is that of `_keys`. A range may end beyond the text, which ends it. The table stays until the driver ends.
    """
    spark = configured(docs)
    scratch = Scratch(spark, "repeats")
    lengths = (length, (n_words or 0) * CODE)
    if min(n for n in lengths if n) < 2 * GRAM:
        raise ValueError(f"length has to be {2 * GRAM} at least, and passages of {-(-2 * GRAM // CODE)} words")
    # So many words and the white space between them have that many bytes at least.
    least = min(length, 2 * n_words - 1) if n_words else length
    text = F.col(text_col).cast("binary")
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), *_keys(text), text.alias("text")).where(F.length("text") >= least)
    found = scratch.table(plain.mapInArrow(_anchors(lengths), "doc long, k1 long, k2 long, view tinyint, place int, gram long, ctx long"), "suffixes")
    classes = scratch.table(found.groupBy(*_CTX).agg(F.count("*").alias("n")), "classes")
    grams = classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("gram", "contexts", (F.col("contexts") > group).alias("big"))
    shared = scratch.table(join_by_degree(classes, grams, ["gram"], "contexts", classes.count(), scratch), "shared")
    # What is left after this: suffixes whose context repeats, and those that share their gram with another context; big is null where only the former holds.
    alone = classes.where("n > 1").join(shared.where("n > 1").select(*_CTX), _CTX, "left_anti").withColumn("big", F.lit(None).cast("boolean"))
    relevant = scratch.table(shared.unionByName(alone), "relevant")
    # Most suffixes are neither; they don't move.
    bits, size = _filter(relevant.select(F.col("ctx").alias("mark")), relevant.count())
    bits = spark.sparkContext.broadcast(bits)
    near = found.mapInArrow(_passing(bits, size), found.schema)
    hits = scratch.table(join_by_degree(near, relevant.withColumn("degree", F.col("n")), _CTX, "degree", found.count(), scratch), "hits")
    bits.destroy()
    scratch.drop(found, classes, shared, relevant)
    places = hits.where("big is not null")
    firsts = [F.first(c).alias(c) for c in ("doc", *_KEY, "view", "place", "n", "big")]
    single = places.where("n = 1").unionByName(places.where("n > 1").groupBy(*_CTX).agg(*firsts))
    wanted = scratch.table(single.groupBy("doc", *_KEY, "big").agg(F.collect_list(F.struct("place", "view", *_CTX, "n")).alias("places")), "wanted")

    def contexts(big: bool) -> DataFrame:
        of = wanted.where(F.col("big") == big).drop("big")
        asked = plain.join(maybe_broadcast(of.select("doc", *_KEY)), ["doc", *_KEY], "left_semi").join(of, ["doc", *_KEY])
        return asked.select("places", "text").mapInArrow(_contexts(lengths), "gram long, ctx long, view tinyint, n long, before binary, after binary")

    small = contexts(False).repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    resolved = scratch.table(small.mapInArrow(_resolve(lengths), "gram long, ctx long, low int, high int"), "resolved")
    if not wanted.where("big").isEmpty():
        big = scratch.table(contexts(True).dropDuplicates(_CTX), "big")
        resolved = resolved.unionByName(scratch.table(_by_hash(big, lengths, scratch), "by-hash"))
    own_length = F.when(F.col("view") == 0, F.lit(lengths[0])).otherwise(F.lit(lengths[1]))
    whole = hits.where("n > 1").select(*_KEY, "view", "place", F.lit(0).alias("low"), (own_length - GRAM).alias("high"))
    parts = hits.where("n = 1").join(resolved, _CTX).select(*_KEY, "view", "place", "low", "high")
    at = whole.unionByName(parts)
    low = F.greatest(F.lit(0), F.col("place") - F.col("high"))
    ranges = at.select(*_KEY, "view", low.alias("low"), (F.col("place") - F.col("low") + own_length).alias("high")).distinct()
    kept = Scratch(spark, "spans").table(ranges, "spans")
    scratch.remove()
    return kept


def merged(spans: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the ranges that have length at least before size; ranges that touch are one run."""
    out: list[list[int]] = []
    for low, high in sorted((low, min(high, size)) for low, high in spans):
        if high - low < length:
            continue
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _places(spans: list[tuple[int, int]], data: memoryview, least: int) -> list[tuple[int, int]]:
    """Ranges of the text for those of its words' codes."""
    begins, ends, _ = words(np.frombuffer(data, dtype=np.uint8))
    whole = [(-(-low // CODE), min(high // CODE, len(begins))) for low, high in spans]
    return [(int(begins[a]), int(ends[b - 1])) for a, b in whole if b - a >= least]


def _cut(keep: int, digest: bool, length: int, least: int):
    """Batches (kept columns..., text, spans) to kept columns with the digest or the remaining text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                size, gone, runs, kept = [], [], [], []
                for text, spans in zip(batch.column(keep), batch.column(keep + 1), strict=True):
                    data = text.as_buffer()
                    data = memoryview(data) if data is not None else memoryview(b"")
                    found = spans.as_py() or []
                    cuts = merged([(s["low"], s["high"]) for s in found if not s["view"]], length, len(data))
                    if passages := [(s["low"], s["high"]) for s in found if s["view"]]:
                        cuts = merged(cuts + _places(passages, data, least), 1, len(data))
                    size.append(len(data))
                    gone.append(sum(b - a for a, b in cuts))
                    runs.append(len(cuts))
                    ends = [0, *(x for c in cuts for x in c), len(data)]
                    parts = [data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
                    if digest:
                        h = hashlib.sha256()
                        for p in parts:
                            h.update(p)
                        kept.append(h.hexdigest())
                    else:
                        kept.append(None if not text.is_valid else b"".join(parts).decode("utf-8", "ignore"))
                last = "kept_sha256" if digest else "kept_text"
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[:keep], "n_bytes", "n_removed", "n_spans", last])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: bool = False, group: int = GROUP, n_words: int | None = None) -> DataFrame:
    """The columns keep (default: the id) of each row with n_bytes, n_removed, n_spans and kept_text, or kept_sha256 if digest.

    n_words: passages of so many words that repeat are cut as well, however few bytes they have.

    kept_text is null for a null text; a character that a cut splits is left out of it. kept_sha256 is of the remaining bytes themselves.
    Kept columns of the result's names are replaced.
    """
    new = {"n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"}
    keep = [c for c in (keep or [id_col]) if c.lower() not in new]
    ranges = repeated_spans(docs, length, id_col, text_col, group, n_words)
    spans = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("view", "low", "high")).alias("__spans__")).withColumnsRenamed({"k1": "__k1__", "k2": "__k2__"})
    text = F.col(text_col).cast("binary")
    k1, k2 = _keys(text)
    rows = docs.select(*keep, text.alias("__text__"), k1.alias("__k1__"), k2.alias("__k2__"))
    on = ["__k1__", "__k2__"]
    columns = [*keep, "__text__", "__spans__"]
    # Copies of one text don't meet in one task.
    scratch = Scratch(docs.sparkSession, "cut")
    table = scratch.table(spans.join(rows.groupBy(*on).agg(F.count("*").alias("n")), on), "spans")
    n_rows = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = maybe_broadcast(table.select(*on))
    hit = join_by_degree(rows.join(keys, on, "left_semi"), table, on, "n", n_rows, scratch)
    miss = rows.where(F.col("__k1__").isNull()).unionByName(rows.where(F.col("__k1__").isNotNull()).join(keys, on, "left_anti"))
    joined = hit.select(*columns).unionByName(miss.withColumn("__spans__", F.lit(None).cast(spans.schema["__spans__"].dataType)).select(*columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return joined.mapInArrow(_cut(len(keep), digest, length, n_words or 0), f"{schema}, n_bytes long, n_removed long, n_spans long, {'kept_sha256' if digest else 'kept_text'} string")
