"""The corpus pipeline: four stages over documents, each on all that the one before kept.

Language identification drops what it rejects; of each group of near duplicates one document stays; strings that repeat anywhere in what is left are cut from
the texts; and the rest is packed into sequences. Each stage's result is a written table, so lost executors cost one stage at most.

Nulls: a document with a null text has no language and goes in the first stage; null ids, languages, sources and counts are kept as they are. Columns besides those of
documents are dropped. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import language_id, minhash_dedup, packing, suffix_dedup
from folioscan.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified. The model learns from the labelled documents themselves."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.predict(docs.select(*COLUMNS), model, COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the least id.

    Of rows that share an id and a set of shingles one stays. Documents without id stay, one of each set of shingles, where no document with id has it.
    """
    docs = docs.select(*COLUMNS)
    groups = minhash_dedup.minhash_components(docs, k=5, percent=80, fingerprint=True)
    kept = groups.where("kept")
    twice = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty() and docs.where("doc_id is null").isEmpty():
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    single = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").join(twice, "doc_id", "left_anti").select(*COLUMNS)
    several = minhash_dedup.with_fingerprints(docs.join(twice, "doc_id", "left_semi").select(*COLUMNS))
    several = several.join(kept.select("doc_id", "fp").distinct().withColumnRenamed("doc_id", "id").withColumnRenamed("fp", "own"), (F.col("doc_id") == F.col("id")) & F.col("fp").eqNullSafe(F.col("own")), "left_semi")
    without = minhash_dedup.with_fingerprints(docs.where("doc_id is null"))
    without = without.join(groups.where("doc_id is not null and fp is not null").select("fp").distinct(), "fp", "left_anti").select(*COLUMNS, "fp")
    both = several.select(*COLUMNS, "fp").unionByName(without)
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = both.where("fp is not null").groupBy("doc_id", "fp").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[f"row.{c}" for c in rest])
    return single.unionByName(one.select(*COLUMNS)).unionByName(both.where("fp is null").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of over 50 words that occur elsewhere, too."""
    cut = suffix_dedup.remove_repeats(docs, length=400, keep=["doc_id", "lang", "source"], n_words=51)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", pack),
]

#: Neither learned languages nor packing can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name)
            # What the stage has read isn't needed again.
            scratch.keep(docs)
    return docs
