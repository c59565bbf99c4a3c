"""Scans: stored tables, the metadata array, file listings, page images, rendered documents."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioscan import schema
from folioscan.functions.names import file_name, mebibytes
from folioscan.sources import manifest
from folioscan.sources.files import read_file


#: Bytes of page images that a task holds before it passes them on.
PAGES_BYTES = 8 << 20


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers open it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there, on any file system that Spark reads."""
    system, found = file_system(spark, path)
    return system.exists(found)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, found = file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(found)] if system.exists(found) else []


def read_store(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a store, of its newest version or an older one: live commits without what tombstones take; or the plain table of a store written by other means."""
    found = manifest.read(spark, store, version)
    if found is None:
        if any(n.startswith("commit=") for n in _names(spark, f"{store}/{table}")):
            raise FileNotFoundError(f"{store}/versions")
        return spark.read.parquet(f"{store}/{table}")
    if not found.adds:
        raise FileNotFoundError(f"{store}/{table}")
    return live(spark, store, table, found)


def live(spark: SparkSession, store: str, table: str, found: manifest.Manifest) -> DataFrame:
    rows = spark.read.parquet(*[f"{store}/{table}/commit={n}" for n in found.adds])
    if not found.deletes or table == "summaries":
        return rows
    dead = spark.read.parquet(*[f"{store}/tombstones/commit={n}" for n in found.deletes])
    if table == "documents":
        return rows.join(dead.select("source", "added").distinct(), ["source", "added"], "left_anti")
    key = ["source", "page", "added"] if table == "images" else ["page_ord"]
    return rows.join(dead.where("page_ord is not null").select(*key), key, "left_anti")


def require(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raises FileNotFoundError for the first path that is missing."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(page_ord, source, page, total_pages) of a JSON array, where page_ord is the place in it, or of a folder of exported JSON lines."""
    system, found = file_system(spark, path)
    if system.getFileStatus(found).isDirectory():
        return spark.read.schema("page_ord long, source string, page int, total_pages int").json(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", schema.METADATA_JSON)).alias("page_ord", "m")).select(F.col("page_ord").cast("long").alias("page_ord"), "m.source", "m.page", "m.total_pages")


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name, path, size) of the files of one folder, by name; contents aren't read. Files of no bytes are among them, which Spark's reader leaves out."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(file_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"))
    system, found = file_system(spark, folder)
    bare = [(s.getPath().getName(), s.getPath().toString(), 0) for s in system.listStatus(found) if s.isFile() and not s.getLen() and fnmatch.fnmatchcase(s.getPath().getName(), pattern)]
    if bare:
        files = files.unionByName(spark.createDataFrame(bare, files.schema))
    return files.orderBy("name")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, "*.pdf")


def count_images(spark: SparkSession, folder: str) -> int:
    return list_files(spark, folder, "*.png").count()


def requested(spark: SparkSession, names: Sequence[str], available: DataFrame, allow_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents that are there with their doc_ord, names that are missing), in the order given."""
    if not allow_duplicates and len(set(names)) < len(names):
        raise ValueError("a document is named twice")
    asked = spark.createDataFrame(list(enumerate(names)), "doc_ord long, name string")
    return asked.join(available, "name").orderBy("doc_ord"), asked.join(available, "name", "left_anti").orderBy("doc_ord")


def inventory(spark: SparkSession, folder: str, names: Sequence[str], count_pages: Callable[[bytes], int]) -> DataFrame:
    """(name, found, pages, megabytes) of given documents; count_pages is the renderer's page count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "pages": [count_pages(c) for c in b["content"]], "size": b["length"]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(file_name(F.col("path")).alias("name"), "content", "length")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    sized = files.join(asked, "name", "left_semi").mapInPandas(count, "name string, pages int, size long")
    return asked.join(sized, "name", "left").select("name", F.col("size").isNotNull().alias("found"), "pages", mebibytes(F.col("size")).alias("megabytes"))


def page_images(spark: SparkSession, folder: str, prefix: str = "page_images") -> DataFrame:
    """(image_path, content) of stored page images; image_path as in page_meta, below prefix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(F.concat(F.lit(prefix.rstrip("/") + "/"), file_name(F.col("path"))).alias("image_path"), "content")


def open_images(rows: DataFrame, folder: str) -> DataFrame:
    """rows with image: the content of the file of folder that image_path names, null where there is none. Only files that rows name are opened."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["image"] = [None if p is None else read_file(folder, p.rsplit("/", 1)[-1]) for p in b["image_path"]]
            yield b

    return rows.mapInPandas(load, StructType([*rows.schema.fields, StructField("image", BinaryType())]))


def render(documents: DataFrame, renderer: Callable[[bytes, int], Iterable[bytes]], dpi: int = 150) -> DataFrame:
    """(source, page, image): one row per page, in order. documents: name, content; renderer(content, dpi) gives a document's page images, one after the other if it is a generator:
    some MB of them are held at once, whatever the document's length."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                held, size, first = [], 0, 1
                for image in renderer(content, dpi):
                    held.append(image)
                    size += len(image)
                    if size > PAGES_BYTES:
                        yield pd.DataFrame({"source": name, "page": range(first, first + len(held)), "image": held})
                        held, size, first = [], 0, first + len(held)
                if held:
                    yield pd.DataFrame({"source": name, "page": range(first, first + len(held)), "image": held})

    return documents.select("name", "content").mapInPandas(pages, "source string, page int, image binary")
