"""Writers of the engine's tables, and the summary of what was written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.names import file_name
from folioscan.sources.files import write_file
from folioscan.sources import manifest
from folioscan.sources.readers import live, read_store


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def export_metadata(meta: DataFrame, path: str) -> None:
    """JSON lines beside the Parquet table, which stays authoritative; `read_metadata` reads them back."""
    meta.select("page_ord", "source", "page", "total_pages").write.mode("overwrite").json(path)


def write_images(pages: DataFrame, folder: str) -> int:
    """Writes image (bytes) of each row to the file of folder that image_path names. Returns the number of files; writing again replaces them."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, image in zip(b["name"], b["image"], strict=True):
                write_file(folder, name, image)
            yield b[["name"]]

    return pages.select(file_name(F.col("image_path")).alias("name"), "image").where("name is not null and image is not null").mapInPandas(put, "name string").count()


def summary(patches: DataFrame, element_bytes: int = 4) -> DataFrame:
    """One row: pages, patches of a page at most, dimensions, megabytes of the embeddings."""
    facts = patches.agg(F.countDistinct("page_ord").alias("pages"), (F.max("patch") + 1).cast("long").alias("patches"), F.max(F.size("vec")).cast("long").alias("dim"), F.sum(F.size("vec").cast("long")).alias("n"))
    return facts.select("pages", "patches", "dim", (F.col("n") * element_bytes / F.lit(1e6)).alias("megabytes"))


def commit_summary(patches: DataFrame, meta: DataFrame) -> DataFrame:
    """One row that merges with those of other commits: what summary() and alignment need, and a sketch of the sources."""
    facts = patches.agg(F.countDistinct("page_ord").alias("pages"), F.max("patch").cast("long").alias("last_patch"), F.min(F.size("vec")).cast("long").alias("least_dim"), F.max(F.size("vec")).cast("long").alias("dim"), F.sum(F.size("vec").cast("long")).alias("n"))
    return facts.crossJoin(meta.agg(F.min("page_ord").alias("first"), F.max("page_ord").alias("last"), F.hll_sketch_agg("source").alias("sources")))  # one row each


def store_summary(spark: SparkSession, store: str, element_bytes: int = 4, version: int | None = None) -> DataFrame:
    """summary() of a store with the approximate number of its sources. Merged from the commits' rows, so that no patch is read; a store with tombstones is read anew for all but the sources,
    which then count those that were deleted, too."""
    found = manifest.read(spark, store, version)
    merged = read_store(spark, store, "summaries", version).agg(
        F.sum("pages").alias("pages"), (F.max("last_patch") + 1).alias("patches"), F.max("dim").alias("dim"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("sources"))
    if found.deletes:
        return summary(live(spark, store, "patches", found), element_bytes).crossJoin(merged.select("sources"))  # one row each
    return merged.select("pages", "patches", "dim", (F.col("n") * element_bytes / F.lit(1e6)).alias("megabytes"), "sources")
