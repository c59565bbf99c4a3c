"""Ingest: corpus ordinals, alignment, pooling once; a store's versions: anew, appended, replaced, deleted, compacted; documents to a store."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace as changed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.encoders import Encoder
from folioscan.functions.names import file_name, image_path
from folioscan.functions.vectors import is_sound, mean_pool, unit
from folioscan.operators.ordinals import numbered, running_sum
from folioscan.sources import manifest
from folioscan.sources.manifest import Manifest
from folioscan.sources.readers import list_documents, live, render, requested
from folioscan.sources.sinks import commit_summary, write_images, write_table


def document_offsets(documents: DataFrame) -> DataFrame:
    """(doc_ord, source, total_pages, running_total, offset) of (doc_ord, source, total_pages): pages up to and before each document."""
    return running_sum(documents, "doc_ord", "total_pages", "running_total").withColumn("offset", F.col("running_total") - F.col("total_pages"))


def page_meta(documents: DataFrame, folder: str = "page_images", start: int = 0) -> DataFrame:
    """The pages of documents in corpus order: page_ord, source, page, total_pages, image_path."""
    rows = document_offsets(documents).where("total_pages > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page"))
    ordinal = (F.lit(start) + F.col("offset") + F.col("page") - 1).cast("long")
    return rows.select(ordinal.alias("page_ord"), "source", "page", F.col("total_pages").cast("int").alias("total_pages"), image_path(folder, F.col("source"), F.col("page")).alias("image_path"))


def alignment(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """(page_ord, problem) of rows that only one of the two tables has."""
    a = vectors.select("page_ord").join(meta.select("page_ord"), "page_ord", "left_anti").select("page_ord", F.lit("no metadata").alias("problem"))
    b = meta.select("page_ord").join(vectors.select("page_ord"), "page_ord", "left_anti").select("page_ord", F.lit("no vector").alias("problem"))
    return a.unionByName(b)


def page_vectors(patches: DataFrame) -> DataFrame:
    """(page_ord, unit_vec): pooled and normalised once, so queries don't pool again. Raises for null, NaN or ragged-length vectors."""
    checked = patches.withColumn("vec", F.when(is_sound(F.col("vec")), F.col("vec")).otherwise(F.raise_error(F.lit("a patch is null or holds null, NaN or infinity")).cast("array<float>")))
    return mean_pool(checked, "page_ord").select("page_ord", unit(F.col("vec")).alias("unit_vec"))


def _write(patches: DataFrame, meta: DataFrame, path: str, name: str, documents: DataFrame | None = None) -> int:
    """Writes the tables of one commit; returns its pages. Nothing of it is part of the store before a manifest names it. documents: source, total_pages; those of meta by default."""
    spark = patches.sparkSession
    write_table(meta, f"{path}/page_meta/commit={name}")
    meta = spark.read.parquet(f"{path}/page_meta/commit={name}")
    write_table(patches, f"{path}/patches/commit={name}")
    patches = spark.read.parquet(f"{path}/patches/commit={name}")
    if bad := alignment(patches.select("page_ord").distinct(), meta).take(1):
        raise ValueError(f"page {bad[0]['page_ord']}: {bad[0]['problem']}")
    write_table(page_vectors(patches), f"{path}/page_vectors/commit={name}")
    if documents is None:
        documents = meta.groupBy("source").agg(F.count("*").alias("total_pages"))
    write_table(documents.select("source", F.col("total_pages").cast("long").alias("total_pages"), F.lit(name).alias("added")), f"{path}/documents/commit={name}")
    write_table(commit_summary(patches, meta), f"{path}/summaries/commit={name}")
    return meta.count()


def _now(spark: SparkSession, path: str) -> Manifest:
    return manifest.read(spark, path) or Manifest()


def _documents(spark: SparkSession, path: str, now: Manifest) -> DataFrame | None:
    """(source, total_pages, added) of the documents that a version holds, those without pages too."""
    return live(spark, path, "documents", now) if now.adds else None


def _publish(spark: SparkSession, path: str, now: Manifest, note: str, **changes) -> int:
    made = changed(now, version=now.version + 1, note=note, **changes)
    manifest.publish(spark, path, made)
    return made.version


def next_ordinal(meta: DataFrame) -> int:
    """The ordinal after the greatest of meta, 0 if it has no rows."""
    last = meta.agg(F.max("page_ord")).first()[0]
    return 0 if last is None else last + 1


def store(patches: DataFrame, meta: DataFrame, path: str) -> int:
    """Writes a store anew: patches, page_meta and page_vectors. Returns its version; older ones can be read until vacuum.

    Raises if the two tables don't align or there are no pages; the version before stays the newest then.
    """
    spark, now, name = patches.sparkSession, _now(patches.sparkSession, path), manifest.new_name()
    if not _write(patches, meta, path, name):
        raise ValueError("there are no pages to store")
    return _publish(spark, path, now, "store", adds=(name,), deletes=(), next=next_ordinal(spark.read.parquet(f"{path}/page_meta/commit={name}")))


def append(patches: DataFrame, documents: DataFrame, path: str) -> int:
    """Adds documents that the store doesn't hold yet; patches: source, page, patch, vec. Returns the number of pages added.

    Safe to run again after a stop at any point; beside another writer one of the two raises Conflict.
    """
    spark = patches.sparkSession
    now = _now(spark, path)
    if now.version < 0:
        raise FileNotFoundError(path)
    old = _documents(spark, path, now)
    new = documents if old is None else documents.join(old.select("source").distinct(), "source", "left_anti")
    return _add(patches, new, path, now, "append")


def _add(patches: DataFrame, documents: DataFrame, path: str, now: Manifest, note: str, deletes: tuple[str, ...] | None = None) -> int:
    """One version with documents' pages added, and deletes instead of the tombstones so far."""
    spark, name = patches.sparkSession, manifest.new_name()
    meta = page_meta(documents, start=now.next)
    added = _write(patches.join(meta.select("source", "page", "page_ord"), ["source", "page"]).select("page_ord", "patch", "vec"), meta, path, name, documents.select("source", "total_pages"))
    if added or deletes is not None:
        _publish(spark, path, now, note, adds=(*now.adds, name), deletes=now.deletes if deletes is None else deletes, next=now.next + added)
    return added


def _tombstones(spark: SparkSession, path: str, now: Manifest, sources: DataFrame) -> tuple[str, int]:
    """Writes tombstones for sources' pages, and for those of them that have none; their name and number."""
    name = manifest.new_name()
    wanted = _documents(spark, path, now).join(sources.select("source").distinct(), "source", "left_semi")
    rows = wanted.join(live(spark, path, "page_meta", now).select("source", "page", "page_ord"), "source", "left")
    write_table(rows.select("page_ord", "source", "page", "added"), f"{path}/tombstones/commit={name}")
    return name, spark.read.parquet(f"{path}/tombstones/commit={name}").count()


def delete(spark: SparkSession, path: str, sources: DataFrame | Sequence[str]) -> int:
    """Takes documents out of the newest version by tombstones that readers merge; data stay until compact and vacuum. Returns the number of pages and of documents without any."""
    now = _now(spark, path)
    if now.version < 0:
        raise FileNotFoundError(path)
    sources = sources if isinstance(sources, DataFrame) else spark.createDataFrame([(s,) for s in sources], "source string")
    name, n = _tombstones(spark, path, now, sources) if now.adds else ("", 0)
    if n:
        _publish(spark, path, now, "delete", deletes=(*now.deletes, name))
    return n


def replace(patches: DataFrame, documents: DataFrame, path: str) -> int:
    """Puts new pages of documents in the place of what the store holds of them, in one version. They come last in order. Returns the number of pages added."""
    spark = patches.sparkSession
    now = _now(spark, path)
    if now.version < 0:
        raise FileNotFoundError(path)
    name, n = _tombstones(spark, path, now, documents) if now.adds else ("", 0)
    return _add(patches, documents, path, now, "replace", (*now.deletes, name) if n else now.deletes)


def compact(spark: SparkSession, path: str) -> int:
    """Writes the live rows of all commits as one, without tombstones; ordinals stay. Returns the version."""
    now, name = _now(spark, path), manifest.new_name()
    if not now.adds:
        raise FileNotFoundError(path)
    for table in ("page_meta", "patches", "page_vectors"):
        rows = live(spark, path, table, now)
        write_table(rows.repartitionByRange("page_ord").sortWithinPartitions("page_ord"), f"{path}/{table}/commit={name}")
    documents = live(spark, path, "documents", now)
    images = [n for n in now.adds if manifest.has(spark, path, "images", n)]
    if images:
        kept = live(spark, path, "images", changed(now, adds=tuple(images)))
        write_table(kept.withColumn("added", F.lit(name)), f"{path}/images/commit={name}")
    write_table(documents.withColumn("added", F.lit(name)), f"{path}/documents/commit={name}")
    written = lambda table: spark.read.parquet(f"{path}/{table}/commit={name}")
    write_table(commit_summary(written("patches"), written("page_meta")), f"{path}/summaries/commit={name}")
    return _publish(spark, path, now, "compact", adds=(name,), deletes=())


@dataclass(frozen=True)
class Ingested:
    """What an ingest added: documents with pages, pages, image files written, names that weren't found, and the number of documents without a page (the store's table `documents` names them)."""

    documents: int
    pages: int
    images: int
    missing: list[str]
    empty: int = 0


def ingest_documents(
    spark: SparkSession, folder: str, path: str, renderer: Callable[[bytes, int], Iterable[bytes]], encoder: Encoder, names: Sequence[str] | None = None, dpi: int = 150,
    image_folder: str | None = None, commit_every: int = 0,
) -> Ingested:
    """Documents of folder (those named, in that order, or all by name) to a store: rendered once, encoded, pooled, committed.

    Adds to a store that is there; documents that it holds are passed over, those without pages too. commit_every: after how many documents a version is published, so that a long ingest that stops goes on
    from there; 0 publishes once. Page images go to the store's table `images`, and to files of image_folder if that is given. Missing names are reported; no
    document at all, or no page at all in a new store, raises, as does an image name that another document of the store has.
    """
    available = list_documents(spark, folder)
    if names is None:
        there, missing = available.withColumn("doc_ord", F.monotonically_increasing_id()), []
    else:
        there, gone = requested(spark, names, available)
        missing = [r["name"] for r in gone.collect()]
    listed = f"{path}/documents/commit={manifest.new_name()}"
    write_table(there.select("doc_ord", F.col("name").alias("source")), listed)
    wanted = spark.read.parquet(listed)
    if wanted.isEmpty():
        raise ValueError(f"{folder} holds none of the documents" if names is not None else f"{folder} holds no documents")
    old = _documents(spark, path, _now(spark, path))
    if old is not None:
        wanted = wanted.join(old.select("source").distinct(), "source", "left_anti")
    parts = [wanted]
    if commit_every:
        places = numbered(wanted.withColumn("__all", F.lit(0)), "__all", "doc_ord", "place").select("doc_ord", "source", "place")
        write_table(places, f"{listed}-places")
        places = spark.read.parquet(f"{listed}-places")
        parts = [places.where(F.floor((F.col("place") - 1) / commit_every) == i).drop("place") for i in range(-(-places.count() // commit_every))]
    done, waiting = Ingested(0, 0, 0, missing), ()
    for part in parts:
        some, waiting = _ingest(spark, folder, path, renderer, encoder, part, dpi, image_folder, waiting)
        done = Ingested(done.documents + some.documents, done.pages + some.pages, done.images + some.images, missing, done.empty + some.empty)
    if _now(spark, path).next == 0:
        raise ValueError("there are no pages to store")
    return done


def _ingest(spark: SparkSession, folder: str, path: str, renderer: Callable, encoder: Encoder, wanted: DataFrame, dpi: int, image_folder: str | None, waiting: tuple[str, ...]) -> tuple[Ingested, tuple[str, ...]]:
    """waiting: commits of documents without pages, to be published with the first that has one. Returns what is waiting then, too."""
    now, name = _now(spark, path), manifest.new_name()
    if wanted.isEmpty():
        return Ingested(0, 0, 0, []), waiting
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(file_name(F.col("path")).alias("name"), "content")
    rendered = render(files.join(wanted.select(F.col("source").alias("name")), "name", "left_semi"), renderer, dpi)
    write_table(rendered.withColumn("image_path", image_path("page_images", F.col("source"), F.col("page"))).withColumn("added", F.lit(name)), f"{path}/images/commit={name}")
    images = spark.read.parquet(f"{path}/images/commit={name}")
    named = images.select("image_path", "source")
    if now.adds:
        named = named.unionByName(live(spark, path, "page_meta", now).select("image_path", "source"))
    if twice := named.groupBy("image_path").agg(F.count("*").alias("n"), F.min("source").alias("a"), F.max("source").alias("b")).where("n > 1").take(1):
        raise ValueError(f"{twice[0]['a']} and {twice[0]['b']} have the same image names")
    counts = images.groupBy("source").agg(F.count("*").alias("total_pages"))
    documents = wanted.join(counts, "source", "left").select("doc_ord", "source", F.coalesce("total_pages", F.lit(0)).alias("total_pages"))
    facts = documents.agg(F.count_if(F.col("total_pages") > 0).alias("full"), F.count_if(F.col("total_pages") == 0).alias("empty")).first()
    meta = page_meta(documents, start=now.next)
    patches = encoder.encode_images(images.select("source", "page", "image")).join(meta.select("source", "page", "page_ord"), ["source", "page"]).select("page_ord", "patch", "vec")
    added = _write(patches, meta, path, name, documents)
    waiting = (*waiting, name)
    if added or now.version >= 0:
        _publish(spark, path, now, "ingest", adds=(*now.adds, *waiting), next=now.next + added)
        waiting = ()
    return Ingested(facts["full"], added, write_images(images, image_folder) if image_folder and added else 0, [], facts["empty"]), waiting
