"""The retrieval engine over a store: queries to hits to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.encoders import AnswerGenerator, CitationGenerator, Encoder
from folioscan.functions.names import prompt
from folioscan.functions.vectors import unit
from folioscan.operators import search
from folioscan.sources.readers import open_images, read_store, require


class RetrievalEngine:
    """Lazy: tables are read when queries need them, of the store's newest version or the one given. Validates that page_vectors, page_meta and, if given, the image folder are there."""

    def __init__(self, spark: SparkSession, store: str, encoder: Encoder | None = None, generator: AnswerGenerator | None = None, images: str | None = None, version: int | None = None):
        self.spark, self.store, self.encoder, self.generator, self.images = spark, store, encoder, generator, images
        require(spark, [f"{store}/page_vectors", f"{store}/page_meta", *([images] if images else [])])
        self.vectors = read_store(spark, store, "page_vectors", version)
        self.metadata = read_store(spark, store, "page_meta", version)

    @property
    def page_count(self) -> int:
        return self.vectors.count()

    @property
    def embedding_dim(self) -> int:
        row = self.vectors.agg(F.min(F.size("unit_vec")).alias("low"), F.max(F.size("unit_vec")).alias("high")).first()
        if row["low"] != row["high"]:
            raise ValueError("pages of different dimension")
        return row["low"]

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        if self.encoder is None or not self.encoder.is_available():
            raise RuntimeError("a text query needs an encoder")
        return self.encoder.encode_queries(queries)

    def retrieve(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """Hits of queries (query_id, and query or vec). A query's text wins over its vector; a zero vector scores 0 with every page."""
        if k <= 0:
            raise ValueError("k has to be positive")
        names = set(queries.columns)
        if "query" in names:
            asked = self.encode_queries(queries.where("query is not null").select("query_id", "query"))
            if "vec" in names:
                asked = asked.unionByName(queries.where("query is null and vec is not null").select("query_id", unit(F.col("vec")).alias("unit_vec")))
        elif "vec" in names:
            asked = queries.select("query_id", unit(F.col("vec")).alias("unit_vec"))
        else:
            raise ValueError("queries need a query or a vec column")
        return search.with_metadata(search.top_k(self.vectors, asked, k), self.metadata)

    def retrieve_one(self, query: str | None = None, query_embedding: list[float] | None = None, top_k: int = 3) -> list[dict]:
        """The hits of one query as dicts, best first."""
        if query is None and query_embedding is None:
            raise ValueError("give a query or an embedding")
        row = (0, query) if query is not None else (0, [float(x) for x in query_embedding])
        queries = self.spark.createDataFrame([row], "query_id long, query string" if query is not None else "query_id long, vec array<double>")
        fields = ["source", "page", "total_pages", "image_path", "similarity"]
        return [{f: r[f] for f in fields} for r in self.retrieve(queries, top_k).orderBy("rank").collect()]

    def answer(self, queries: DataFrame, k: int = 3, available: DataFrame | None = None) -> DataFrame:
        """(query_id, answer, status, error, n_images). The generator gets a hit's image, from the engine's folder of images or from available
        (image_path, and content if it has that); hits without one don't reach it. With neither, hits count as there and have no image."""
        generator = self.generator or CitationGenerator()
        hits = self.retrieve(queries, k)
        nothing = F.lit(None).cast("binary")
        if available is not None:
            content = F.col("content") if "content" in available.columns else nothing
            hits = hits.join(available.select("image_path", content.alias("image")).dropDuplicates(["image_path"]), "image_path")
        elif self.images:
            hits = open_images(hits, self.images).where("image is not null")
        else:
            hits = hits.withColumn("image", nothing)
        pages = F.array_sort(F.collect_list(F.struct("rank", "source", "page", "image")))
        grouped = hits.groupBy("query_id").agg(pages.alias("pages"))
        text = F.col("query") if "query" in queries.columns else F.lit("")
        listed = F.array_join(F.transform("pages", lambda p: F.concat(p["source"], F.lit(" p. "), p["page"].cast("string"))), ", ")
        asked = queries.select("query_id", F.coalesce(text, F.lit("")).alias("q")).join(grouped, "query_id", "left")
        asked = asked.select("query_id", prompt(F.col("q"), F.size("pages"), F.coalesce(listed, F.lit(""))).alias("prompt"), "pages")

        def run(batches):
            import pandas as pd

            for b in batches:
                rows = []
                for query_id, request, pages in zip(b["query_id"], b["prompt"], b["pages"], strict=True):
                    pages = [] if pages is None else [dict(p) if isinstance(p, dict) else p.asDict() for p in pages]
                    if not pages:
                        rows.append((query_id, None, "no_images", None, 0))
                        continue
                    try:
                        rows.append((query_id, generator.generate(request, pages), "ok", None, len(pages)))
                    except Exception as e:  # noqa: BLE001  a failed call is a row of the result
                        rows.append((query_id, None, "error", str(e), len(pages)))
                yield pd.DataFrame(rows, columns=["query_id", "answer", "status", "error", "n_images"])

        return asked.mapInPandas(run, "query_id long, answer string, status string, error string, n_images int")


def create_engine(spark: SparkSession, store: str, encoder: Encoder | None = None, generator: AnswerGenerator | None = None, images: str | None = None) -> RetrievalEngine:
    return RetrievalEngine(spark, store, encoder, generator, images)
