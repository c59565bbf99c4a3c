"""MinHash near-duplicate detection with fast similarity sketches.

Every distinct shingle set gets a sketch whose coordinates are filled by rounds of hashed bin placement; bands of
coordinates nominate candidates; candidates are confirmed on full shingle sets; links join into components.

Copies never meet in pairs: documents with equal sets form a class through its fingerprint, and one representative goes
on. Within a bucket of a band, first every member is tried against the bucket's least member. What is then still in
different components is tried across those components, bucket by bucket: brief sketches travel first, full sets only of the members whose sketches come near
enough to another component's. So no nominated link between different texts is left out, while members that are already connected are not paired again,
and no pairs travel.

With `bands` of `rows` coordinates, a pair of similarity s is nominated with probability 1 - (1 - s**rows)**bands: for
the defaults, at s = 0.8, all but 5 in 10 million.

Nulls, empty texts and texts without words: an empty set, linked with nothing. Repeated rows and rows that share an id stay
rows of the result and count as one vertex of the graph, whose links are those of all its texts. A null id is kept with a null component and is linked with nothing. Empty table: empty
result. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import U64, Scratch, configured, join_by_degree, maybe_broadcast, mix64, partitions
from folioscan.llm.components import connected_components
from folioscan.llm.textcodes import shingle_sets

#: Most pairs one confirming task group reads against one centre.
PAIRS_A_GROUP = 512
#: Members of a bucket that one task holds while others are tried against them, and bytes of full sets that it holds.
MEMBERS, HOME_BYTES = 512, 64 << 20
#: Coordinates of the brief sketches that members of different components are compared by, and the standard deviations by which one may
#: fall short of the similarity before a pair is passed over (chance 3 in a million).
BRIEF, SHORT = 256, 4.5


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """[len(sets), t] sketches; two sets agree in a coordinate with the probability of their Jaccard similarity.

    Round i < t places every element of a set in a hashed bin with a value that starts with i; round t + j places all
    elements in bin j. Lower rounds win, so a set that is complete needs no further round; after 2t rounds every bin
    of a set that isn't empty is filled.
    """
    full = np.iinfo(np.uint64).max
    out = np.full((len(sets), t), full, dtype=U64)
    open_ = [i for i, s in enumerate(sets) if len(s)]
    for i in range(2 * t):
        if not open_:
            break
        items = np.concatenate([sets[d] for d in open_])
        own = np.repeat(np.arange(len(open_)), [len(sets[d]) for d in open_])
        x = mix64(items + U64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
        value = (x >> U64(16)) | (U64(i) << U64(48))
        bins = ((x & U64(0xFFFF)) * U64(t)) >> U64(16) if i < t else np.full(len(x), i - t, dtype=U64)
        part = np.full(len(open_) * t, full, dtype=U64)
        np.minimum.at(part, own * t + bins.astype(np.int64), value)
        part = part.reshape(-1, t)
        rows = np.array(open_)
        kept = np.minimum(out[rows], part)
        out[rows] = kept
        open_ = rows[(kept == full).any(axis=1)].tolist()
    return out


def _fingerprint(codes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None


def _describe(k: int, bands: int, rows: int):
    """Batches (id, text) to (id, fp, n_shingles, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(bands, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93)
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), k):
                coords = sketch(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = np.zeros((len(sets), bands), dtype=U64)
                for j in range(rows):
                    keys = mix64(keys * U64(0x2545F4914F6CDD1D) + coords[:, :, j] + salt)
                fps = [_fingerprint(s) for s in sets]
                offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array(fps, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))],
                    names=["id", "fp", "n_shingles", "keys"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "codes"])

    return run


def with_fingerprints(docs: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """docs with the column fp of minhash_components."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(at), k):
                part = batch.slice(row, len(sets))
                fps = pa.array([_fingerprint(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, fps], names=[*part.schema.names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, fp binary")


def _shared(own: np.ndarray, other: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(own):
        return 0
    at = np.searchsorted(own, other)
    at[at == len(own)] = 0
    return int(np.count_nonzero(own[at] == other))


def _alike(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    x, y = min(len(own), len(other)), max(len(own), len(other))
    if not x or 100 * x < percent * y:
        return False
    both = _shared(own, other)
    return 100 * both >= percent * (x + y - both)


def _confirm(percent: int):
    """Rows sorted by (centre, part, other nulls first): a centre's sets, then the sets to hold against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, over = None, [], True
        for batch in batches:
            us, vs = [], []
            for a, b, codes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                codes = np.frombuffer(codes.as_buffer(), dtype=U64)
                if b is None:
                    if over or a != centre:
                        centre, own, over = a, [], False
                    own.append(codes.copy())
                    continue
                over = True
                if a != centre:
                    raise RuntimeError("a pair came without its centre")
                if any(_alike(o, codes, percent) for o in own):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _compact(t: int):
    """Batches (id, codes) to (id, size, brief): the sketch of each set, one byte per coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.frombuffer(c.as_buffer(), dtype=U64) for c in part.column(1)]
                brief = (mix64(sketch(sets, t)) >> U64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([b.tobytes() for b in brief], pa.binary())], names=["id", "size", "brief"])

    return run


def _near(percent: int, t: int):
    """Streams (key, block, probe, id, component, outer, size, brief) sorted by (key, block, probe last) to (key, block, probe, id) of the members that may be alike one of another component there."""
    least = percent / 100
    agree = t * (least + (1 - least) / 256) - SHORT * np.sqrt(t * least * (1 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, home, arrays, told = None, [], None, set()
        for batch in batches:
            out = []
            for key, block, probe, i, component, outer, size, brief in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (key, block) != task:
                    task, home, arrays, told = (key, block), [], None, set()
                if not probe:
                    home.append((i, component, outer, size, brief))
                    continue
                if arrays is None:
                    arrays = (*(np.array([h[c] for h in home]) for c in range(4)), np.frombuffer(b"".join(h[4] for h in home), dtype=np.uint8).reshape(len(home), t))
                ids, components, outers, sizes, briefs = arrays
                rows = np.flatnonzero((components != component) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (~outers | (ids > i)))
                rows = rows[np.count_nonzero(briefs[rows] == np.frombuffer(brief, dtype=np.uint8), axis=1) >= agree]
                if not len(rows):
                    continue
                out.append((key, block, True, i))
                for r in rows.tolist():
                    if r not in told:
                        told.add(r)
                        out.append((key, block, False, home[r][0]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64())], names=["key", "block", "probe", "id"])

    return run


def _across(percent: int):
    """Streams (key, block, part, probe, id, component, outer, codes) sorted by (key, block, part, probe first) to links (u, v): one for each probe and component that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, probes, done = None, [], set()
        for batch in batches:
            us, vs = [], []
            for key, block, part, probe, i, component, outer, codes in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (key, block, part) != task:
                    task, probes, done = (key, block, part), [], set()
                own = np.frombuffer(codes, dtype=U64)
                if probe:
                    probes.append((i, component, own))
                    continue
                for j, other, theirs in probes:
                    if component != other and (not outer or i > j) and (j, component) not in done and _alike(own, theirs, percent):
                        done.add((j, component))
                        us.append(j)
                        vs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _apart(placed: DataFrame, sets: DataFrame, percent: int, t: int, scratch: Scratch) -> DataFrame | None:
    """Links (u, v) between members (key, id, component_id) of buckets that lie in different components; None if there are no such buckets.

    A bucket's members are dealt to blocks; those outside its largest component go to each block and are held against its members. Members of the largest
    component, most of a hot bucket, never meet one another. First brief sketches tell which members may be alike at all; the full sets of those are then held
    against one another where they are. Only links are emitted.
    """
    spark = placed.sparkSession
    count = F.count("*").alias("n")
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y"), count).where("x <> y and n > 2").select("key", "n")
    members = scratch.table(join_by_degree(placed, mixed, ["key"], "n", placed.count(), scratch).distinct(), "apart")
    n_members = members.count()
    if not n_members:
        return None
    sizes = members.groupBy("key", "component_id").agg(count).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component_id")).alias("top"))
    sizes = sizes.select("key", "all", (F.floor((F.col("all") - 1) / MEMBERS) + 1).cast("int").alias("blocks"), F.col("top.component_id").alias("top"))
    dealt = scratch.table(join_by_degree(members, sizes, ["key"], "all", n_members, scratch).select("key", "id", "component_id", "blocks", (F.col("component_id") != F.col("top")).alias("outer")), "dealt")
    everyone = members.select("id").distinct()
    briefs = scratch.table(sets.join(maybe_broadcast(everyone), "id", "left_semi").mapInArrow(_compact(t), "id long, size long, brief binary"), "briefs")

    def streamed(rows: DataFrame, columns: list[str]) -> DataFrame:
        home = rows.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("probe"), *columns)
        probes = rows.where("outer").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), *columns)
        return home.unionByName(probes)

    columns = ["id", "component_id", "outer", "size", "brief"]
    ordered = streamed(dealt.join(briefs, "id"), columns).repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block", "probe", "id")
    near = scratch.table(ordered.mapInArrow(_near(percent, t), "key long, block int, probe boolean, id long"), "near")
    if near.isEmpty():
        return None
    # Probes are dealt once more so that those which a task holds have some HOME_BYTES of codes; the home members come to each part.
    weights = near.where("probe").join(briefs.groupBy("id").agg(F.sum("size").alias("size")), "id").groupBy("key", "block").agg((F.floor(F.sum("size") * 8 / HOME_BYTES) + 1).cast("int").alias("parts"))
    facts = dealt.select("key", "id", "component_id", "outer").distinct()
    near = near.join(weights, ["key", "block"]).join(facts, ["key", "id"])
    probes = near.where("probe").select("key", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "probe", "id", "component_id", "outer")
    home = near.where("not probe").select("key", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "probe", "id", "component_id", "outer")
    full = probes.unionByName(home).join(sets, "id").select("key", "block", "part", "probe", "id", "component_id", "outer", "codes")
    ordered = full.repartition(partitions(spark), "key", "block", "part").sortWithinPartitions("key", "block", "part", F.col("probe").desc(), "id")
    return ordered.mapInArrow(_across(percent), "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose full sets are similar enough, as links (u, v), and the sets. A centre with many partners is dealt to parts."""
    spark = docs.sparkSession
    ids = scratch.table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = scratch.table(docs.join(maybe_broadcast(ids), "id", "left_semi").mapInArrow(_sets(k), "id long, codes binary").where(F.length("codes") > 0).distinct(), "sets")
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", "n", (F.floor((F.col("n") - 1) / PAIRS_A_GROUP) + 1).cast("int").alias("parts"))
    dealt = join_by_degree(pairs, parts, ["a"], "n", pairs.count(), scratch).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    left = centres.join(sets, F.col("a") == sets["id"]).select("a", "part", "b", "codes")
    right = dealt.join(sets, F.col("b") == sets["id"]).select("a", "part", "b", "codes")
    streams = left.unionByName(right).repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return streams.mapInArrow(_confirm(percent), "u long, v long"), sets


def minhash_components(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, id_col: str = "doc_id", text_col: str = "text", fingerprint: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs; links are pairs of sets with 100*shared >= percent*union.

    fingerprint: with the column fp, which texts of equal sets share; null for an empty set.
    """
    scratch = Scratch(configured(docs), "minhash")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = scratch.table(plain.mapInArrow(_describe(k, bands, rows), "id long, fp binary, n_shingles long, keys array<long>"), "sketches")
    whole = described.where("fp is not null and id is not null")
    classes = scratch.table(whole.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    # An id with several texts ties their classes.
    several = scratch.table(whole.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id"), "several")
    ties = None if several.isEmpty() else whole.select("id", "fp").join(several, "id").distinct().join(classes, "fp").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    chosen = described.join(classes.withColumnRenamed("rep", "id"), ["id", "fp"], "left_semi").select("id", "keys").distinct()
    buckets = scratch.table(chosen, "chosen").select("id", F.explode("keys").alias("key"))
    least = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    shared = scratch.table(buckets.join(least, "key").select("key", "a", "id"), "buckets")
    tried = scratch.table(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    tested, sets = _verified(tried, plain, k, percent, scratch)
    links = scratch.table(tested if ties is None else tested.unionByName(ties), "links")
    merged = connected_components(links, scratch)

    # What the stars left apart: members of a bucket that lie in different components.
    placed = scratch.table(shared.select("key", "id").join(merged, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")), "placed")
    more = _apart(placed, sets, percent, BRIEF, scratch)
    if more is not None and not (more := scratch.table(more, "more")).isEmpty():
        # The components so far stand for the links that made them.
        merged = connected_components(merged.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(more), scratch)

    groups = classes.join(merged.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    groups = scratch.table(groups, "groups")
    scratch.keep(described, groups)
    out = described.select("id", "fp", "n_shingles").join(groups, "fp", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"), *["fp"] * fingerprint)
