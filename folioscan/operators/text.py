"""Text operators: tokens, the hashing encoder, keyword scores, rank fusion, chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

DIM = 64
#: Tokens whose hashes a task keeps.
KNOWN = 200_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, tokens) to (key, size, t, tf)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            size = pc.list_value_length(part.column(1)).to_numpy()
            rows = pa.table({"i": pc.list_parent_indices(part.column(1)).cast(pa.int64()), "t": pc.list_flatten(part.column(1))}).group_by(["i", "t"]).aggregate([([], "count_all")])
            bare = np.flatnonzero(size == 0)
            i = np.concatenate([rows["i"].to_numpy(), bare])
            t = pa.concat_arrays([rows["t"].combine_chunks(), pa.nulls(len(bare), rows["t"].type)]) if len(rows) else pa.nulls(len(bare), pa.string())
            tf = np.concatenate([rows["count_all"].to_numpy(), np.ones(len(bare), np.int64)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(size[i].astype(np.int32)), t.cast(pa.string()), pa.array(tf)], names=[part.schema.names[0], "size", "t", "tf"])


def _counts_and_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_counts() and a row without t for every text that has tokens too."""
    for batch in batches:
        yield from _counts(iter([batch]))
        size = pc.list_value_length(batch.column(1))
        some = pc.greater(size, 0)
        key, size = batch.column(0).filter(some), size.filter(some)
        yield pa.RecordBatch.from_arrays([key, size, pa.nulls(len(key), pa.string()), pa.array(np.ones(len(key), np.int64))], names=[batch.schema.names[0], "size", "t", "tf"])


def counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, t, tf): how often each token occurs in a text of size tokens; a text without tokens is one row without t. Texts are counted where they are read."""
    found = rows.select(key, tokens(F.col(text)).alias("ts"))
    return found.mapInArrow(_counts, StructType([found.schema[0], StructField("size", IntegerType()), StructField("t", StringType()), StructField("tf", LongType())]))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, tokens) to (key, unit_vec)."""
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            coded = pc.list_flatten(part.column(1)).dictionary_encode()
            if len(known) > KNOWN:
                known.clear()
            words = coded.dictionary.to_pylist()
            for t in words:
                if t not in known:
                    h = hashlib.md5(t.encode()).digest()
                    known[t] = (int.from_bytes(h[:4], "big") >> 4) % DIM * 2 + ((h[3] & 15) < 8)
            code = np.array([known[t] for t in words], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
            doc = pc.list_parent_indices(part.column(1)).to_numpy()
            sums = np.bincount(doc * (2 * DIM) + code, minlength=part.num_rows * 2 * DIM).reshape(part.num_rows, DIM, 2)
            v = (sums[:, :, 1] - sums[:, :, 0]).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1))
            v /= np.where(norm > 0, norm, 1.0)[:, None]
            offsets = pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[part.schema.names[0], "unit_vec"])


def encode(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit_vec) of every row: signed counts of hashed tokens, the offline encoder. A text without tokens gives the zero vector. Nothing is shuffled."""
    found = rows.select(key, tokens(F.col(text)).alias("ts"))
    return found.mapInArrow(_encoded, StructType([found.schema[0], StructField("unit_vec", ArrayType(DoubleType()))]))


def counted_for(rows: DataFrame, key: str, text: str, queries: DataFrame, query_text: str) -> DataFrame:
    """counted() without the tokens that no query has, but with a row for each text: one without t, which gives its size."""
    found = rows.select(key, tokens(F.col(text)).alias("ts"))
    counts = found.mapInArrow(_counts_and_sizes, StructType([found.schema[0], StructField("size", IntegerType()), StructField("t", StringType()), StructField("tf", LongType())]))
    return counts.join(asked_terms(queries, query_text).select("t", F.lit(True).alias("asked")).distinct(), "t", "left").where("asked or t is null").select(key, "size", "t", "tf")


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def impact(tf, size, mean, k1: float = 1.2, b: float = 0.75):
    """A token's share of BM25 before its idf, of columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def facts(counts: DataFrame, key: str) -> DataFrame:
    """One row: docs, mean size."""
    each = counts.groupBy(key).agg(F.first("size").alias("size"))
    return each.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))


def asked_terms(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("t"))


def keyword_scores(counts: DataFrame, queries: DataFrame, key: str, query_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score): BM25 of every counted document that shares a token with the query."""
    asked = asked_terms(queries, query_text)
    tf = counts.join(asked.select("t").distinct(), "t", "left_semi")
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    rows = tf.join(asked.join(df, "t"), "t").crossJoin(F.broadcast(facts(counts, key)))  # facts is one row
    part = idf(F.col("docs"), F.col("df")) * impact(F.col("tf"), F.col("size"), F.col("mean"), k1, b)
    return rows.groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))


def ranked(scores: DataFrame, key: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def fuse(first: DataFrame, second: DataFrame, key: str, constant: int = 60) -> DataFrame:
    """(query_id, key, score): reciprocal rank fusion of two rankings."""
    a = first.select("query_id", key, F.col("rank").alias("ra"))
    c = second.select("query_id", key, F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(r)), F.lit(0.0))
    return a.join(c, ["query_id", key], "full").select("query_id", key, (part("ra") + part("rb")).alias("score"))


def chunks(rows: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """(key, chunk, n_words, chunk_text): overlapping windows of words; the last may be short."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - size) / F.lit(step)) + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("w", i * step + 1, size))
    found = rows.select(key, words.alias("w")).where(F.size("w") > 0).select(key, F.posexplode(parts).alias("chunk", "p"))
    return found.select(key, "chunk", F.size("p").alias("n_words"), F.array_join("p", " ").alias("chunk_text"))
