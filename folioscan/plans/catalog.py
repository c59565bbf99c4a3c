"""The registered queries of the engine on the driver's tables, and their SQL.

Stand-ins: pages are the rows of embeddings; a page of several patches is ten vectors in a row; metadata comes from documents, whose
source gives the document name. Queries by vector are the vectors whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import names
from folioscan.functions.vectors import l2_norm, mean_long, unit
from folioscan.operators import search, text, timejoin
from folioscan.operators.codes import CodeIndex
from folioscan.operators.ivf import IvfIndex
from folioscan.operators.keyword_index import KeywordIndex
from folioscan.operators.multivector import MultiVectorIndex
from folioscan.operators.ordinals import numbered
from folioscan import ingest
from folioscan.scratch import Scratch
from folioscan.sources import sinks


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _patches(spark, d):
    return _read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("page_ord"), (F.col("vec_id") % 10).cast("int").alias("patch"), F.col("embedding").alias("vec"))


def _pages(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("page_ord"), unit(F.col("embedding")).alias("unit_vec"))


def _asked(spark, d):
    return _read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("unit_vec"))


def _named(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("page_ord"), F.concat(F.lit("Src "), F.substring("source", 4, 1000), F.lit(".pdf")).alias("source"))


def _totals(spark, d):
    return _named(spark, d).groupBy("source").agg(F.count("*").cast("int").alias("total_pages"))


def _meta(spark, d):
    rows = numbered(_named(spark, d), "source", "page_ord", "page").join(_totals(spark, d), "source")
    return rows.select("page_ord", "source", "page", "total_pages", names.image_path("page_images", F.col("source"), F.col("page")).alias("image_path"))


def _documents(spark, d):
    rows = _totals(spark, d).withColumn("n", F.regexp_extract("source", r"\d+", 0).cast("long"))
    return rows.select(F.col("n").alias("doc_ord"), "source", F.col("total_pages").cast("long").alias("total_pages"))


def v1_mean_pool(spark, d):
    return mean_long(_patches(spark, d), "page_ord").select("page_ord", "dim", F.round("mean", 6).alias("mean"))


def v4_dims(spark, d):
    return _read(spark, d, "embeddings").agg(F.min(F.size("embedding")).cast("long").alias("min_dim"), F.max(F.size("embedding")).cast("long").alias("max_dim"))


def v5_unit_norm(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"), F.round(l2_norm(unit(F.col("embedding"))), 6).alias("unit_norm"))


def v8_inner_product(spark, d):
    return search.scores(_pages(spark, d), _asked(spark, d)).select("query_id", "page_ord", F.round("similarity", 6).alias("similarity"))


def v9_topk_single(spark, d):
    return search.top_k(_pages(spark, d), _asked(spark, d).where("query_id = 0"), 3).select("query_id", "rank", "page_ord", F.round("similarity", 6).alias("similarity"))


def v9_topk_batch(spark, d):
    return search.top_k(_pages(spark, d), _asked(spark, d), 3).select("query_id", "rank", "page_ord", F.round("similarity", 6).alias("similarity"))


def v10_page_count(spark, d):
    return _read(spark, d, "embeddings").agg(F.count("*").alias("pages"))


def v11_pages_per_doc(spark, d):
    return _named(spark, d).groupBy("source").agg(F.count("*").alias("pages"))


def v12_running_total(spark, d):
    return ingest.document_offsets(_documents(spark, d)).select("doc_ord", "source", "total_pages", "running_total")


def v14_shape(spark, d):
    return sinks.summary(_patches(spark, d)).select("pages", "patches", "dim")


def k4_summary(spark, d):
    return sinks.summary(_patches(spark, d)).select("pages", "patches", "dim", F.round("megabytes", 6).alias("megabytes"))


def p1_p2_page_metadata(spark, d):
    return _meta(spark, d).select("page_ord", "source", "page", "total_pages")


def p4_image_path(spark, d):
    return _meta(spark, d).select("page_ord", "image_path")


def p6_writer_name_mismatch(spark, d):
    rows = _meta(spark, d).select("page_ord", names.image_name(F.col("source"), F.col("page")).alias("read_as"), names.writer_image_name(F.col("source"), F.col("page")).alias("written_as"), names.notebook_image_name(F.col("source"), F.col("page")).alias("notebook_as"))
    return rows.where("read_as <> written_as")


def p13_prompt(spark, d):
    return _read(spark, d, "benchmark").select("item_id", names.prompt(F.col("text"), F.lit(3), F.lit("none")).alias("prompt"))


def p15_batches(spark, d):
    return _named(spark, d).groupBy(names.batch_of(F.col("page_ord"), 2).alias("batch")).agg(F.count("*").alias("pages"))


def j1_hits_with_metadata(spark, d):
    hits = search.with_metadata(search.top_k(_pages(spark, d), _asked(spark, d), 3), _meta(spark, d))
    return hits.withColumn("similarity", F.round("similarity", 6))


def j2_alignment_check(spark, d):
    return ingest.alignment(_read(spark, d, "embeddings").select(F.col("vec_id").alias("page_ord")), _named(spark, d))


def j4_hits_with_images(spark, d):
    available = _read(spark, d, "labels").select(F.col("doc_id").alias("page_ord"))
    hits = search.top_k(_pages(spark, d), _asked(spark, d), 3)
    return hits.join(available, "page_ord", "left_semi").select("query_id", "rank", "page_ord")


def j4_images_by_path(spark, d):
    """Hits whose image is stored, by path: the stored images are those of the pages that labels names."""
    meta = _meta(spark, d)
    stored = meta.join(_read(spark, d, "labels").select(F.col("doc_id").alias("page_ord")), "page_ord", "left_semi").select("image_path")
    hits = search.with_metadata(search.top_k(_pages(spark, d), _asked(spark, d), 3), meta)
    return hits.join(stored, "image_path", "left_semi").select("query_id", "rank", "page_ord", "image_path")


def j5_missing_docs(spark, d):
    return _named(spark, d).select("source").distinct().join(_read(spark, d, "nation").select(F.concat(F.lit("Src "), F.col("n_nationkey"), F.lit(".pdf")).alias("source")), "source", "left_anti").unionByName(
        _read(spark, d, "nation").select(F.concat(F.lit("Src "), F.col("n_nationkey"), F.lit(".pdf")).alias("source")).join(_named(spark, d), "source", "left_anti")
    )


def k5_display_rows(spark, d):
    hits = j1_hits_with_metadata(spark, d)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("source"), F.lit(" page "), F.col("page").cast("string"), F.lit("/"), F.col("total_pages").cast("string"), F.lit(" "), names.shown(F.col("similarity"), 4))
    return hits.select("query_id", "rank", line.alias("line"))


def u1_corpus_ordinals(spark, d):
    return ingest.page_meta(_documents(spark, d)).select("page_ord", "source", "page", "total_pages")


def u3_append_equals_rebuild(spark, d):
    """Ordinals of a corpus whose second half is appended to its first."""
    docs = _documents(spark, d)
    first = ingest.page_meta(docs.where("doc_ord < 10"))
    return first.unionByName(ingest.page_meta(docs.where("doc_ord >= 10"), start=ingest.next_ordinal(first))).select("page_ord", "source", "page")


def m2_text_query_topk(spark, d):
    pages = text.encode(_read(spark, d, "documents").select(F.col("doc_id").alias("page_ord"), "text"), "page_ord", "text")
    asked = text.encode(_read(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text"), "query_id", "text")
    return search.top_k(pages, asked, 3).select("query_id", "rank", "page_ord", F.round("similarity", 6).alias("similarity"))


def _tokens(spark, d):
    """The ten vectors from each query on are its tokens."""
    return _read(spark, d, "embeddings").where("vec_id % 100 < 10").select((F.floor(F.col("vec_id") / 100) * 100).alias("query_id"), (F.col("vec_id") % 10).cast("int").alias("token"), F.col("embedding").alias("vec"))


def r1_maxsim(spark, d):
    return search.max_sim(_patches(spark, d), _tokens(spark, d)).select("query_id", "page_ord", F.round("score", 6).alias("score"))


def r3_rerank(spark, d):
    """The 20 pages of greatest pooled similarity, ordered anew by late interaction."""
    pooled = ingest.page_vectors(_patches(spark, d))
    asked = ingest.page_vectors(_tokens(spark, d).select(F.col("query_id").alias("page_ord"), "vec")).withColumnRenamed("page_ord", "query_id")
    first = search.top_k(pooled, asked, 20)
    again = search.rescore(_patches(spark, d), _tokens(spark, d), first)
    return search.best(again, 3, "score").select("query_id", "rank", "page_ord", F.round("score", 6).alias("score"))


def r4_hybrid_rrf(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("page_ord"), "text")
    asked = _read(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    counts = Scratch(spark, "counts").table(text.counted_for(docs, "page_ord", "text", asked, "text"), "counts")
    words = text.ranked(text.keyword_scores(counts, asked, "page_ord", "text"), "page_ord", "score", 20)
    dense = search.top_k(text.encode(docs, "page_ord", "text"), text.encode(asked, "query_id", "text"), 20)
    return text.ranked(text.fuse(dense, words, "page_ord"), "page_ord", "score", 10).select("query_id", "rank", "page_ord", F.round("score", 9).alias("score"))


def r2_multivector_topk(spark, d):
    """The 10 pages of greatest late interaction for each query, through inverted lists of coded patches."""
    index = MultiVectorIndex.build(_patches(spark, d), Scratch(spark, "r2").path("index"))
    return index.search(_tokens(spark, d), 10).select("query_id", "rank", "page_ord", F.round("score", 6).alias("score"))


def ann_ivf_topk(spark, d):
    """The store of cells with all of them probed, which is exact; fewer probes are measured in tests."""
    index = IvfIndex.build(_pages(spark, d), Scratch(spark, "ivf").path("index"))
    return index.search(_asked(spark, d), 10, probes=4096).select("query_id", "rank", "page_ord", F.round("similarity", 6).alias("similarity"))


def pq_topk(spark, d):
    """Codes first, exact vectors of the candidates second."""
    index = CodeIndex.build(_pages(spark, d), Scratch(spark, "pq").path("index"))
    return index.search(_asked(spark, d), 10).select("query_id", "rank", "page_ord", F.round("similarity", 6).alias("similarity"))


def r4_keyword_topk(spark, d):
    """BM25's 20 best documents of each benchmark item, from the stored inverted index."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("page_ord"), "text")
    index = KeywordIndex.build(docs, Scratch(spark, "keywords").path("index"))
    return index.search(_read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 20)


def asof_sales_changes(spark, d):
    """Each sale with the last change of its client up to then."""
    sales = _read(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    changes = _read(spark, d, "client_changes").select("client_id", "valid_at", "change_id", "segment")
    return timejoin.as_of(sales, changes, "client_id", "sold_at", "valid_at", ["change_id", "segment"], "change_id", 6 * 3600 * 1_000_000).select("sale_id", "client_id", "change_id", "segment")


def overlap_sales_changes(spark, d):
    """Sales on their way (from sale to arrival) while their client's data were changed, an hour being given to each change."""
    sales = _read(spark, d, "sales").select("client_id", "sale_id", "sold_at", "arrived_at")
    changes = _read(spark, d, "client_changes").select("client_id", "change_id", "valid_at", (F.col("valid_at") + F.expr("interval 1 hour")).alias("until"))
    return timejoin.overlapping(sales, changes, "client_id", ("sold_at", "arrived_at"), ("valid_at", "until")).select("left.sale_id", "right.change_id")


def r5_chunks(spark, d):
    return text.chunks(_read(spark, d, "documents"), "doc_id", "text", 200, 150).select("doc_id", "chunk", "n_words", F.md5("chunk_text").alias("chunk_md5"))


_U = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_PAGES = f"pages_ AS (SELECT vec_id AS page_ord, {_U} AS u FROM embeddings), asked AS (SELECT page_ord AS query_id, u AS q FROM pages_ WHERE page_ord % 100 = 0)"
_SCORED = f"WITH {_PAGES}, s AS (SELECT query_id, page_ord, list_inner_product(u, q) AS s FROM pages_, asked), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_ord) AS r FROM s)"
_NAMED = "named AS (SELECT doc_id AS page_ord, 'Src ' || substr(source, 4) || '.pdf' AS source FROM documents)"
_META = f"{_NAMED}, meta AS (SELECT page_ord, source, CAST(row_number() OVER (PARTITION BY source ORDER BY page_ord) AS INTEGER) AS page, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS total_pages FROM named)"
_NAME = "lower(replace(replace(source, '.pdf', ''), ' ', '_')) || '__page_' || printf('%04d', page) || '.png'"
_DOCS = f"{_NAMED}, docs AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS doc_ord, source, count(*) AS total_pages FROM named GROUP BY source)"
_ORD = f"WITH {_DOCS}, off AS (SELECT *, sum(total_pages) OVER (ORDER BY doc_ord) - total_pages AS o FROM docs), ords AS (SELECT CAST(o + p - 1 AS BIGINT) AS page_ord, source, CAST(p AS INTEGER) AS page, CAST(total_pages AS INTEGER) AS total_pages FROM (SELECT *, unnest(range(1, total_pages + 1)) AS p FROM off))"
_PATCH = "patches AS (SELECT CAST(vec_id // 10 AS BIGINT) AS page_ord, CAST(vec_id % 10 AS INTEGER) AS patch, embedding::DOUBLE[] AS vec FROM embeddings), toks AS (SELECT CAST(vec_id // 100 * 100 AS BIGINT) AS query_id, vec_id % 10 AS token, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 < 10)"
_MAXSIM = f"{_PATCH}, ms AS (SELECT query_id, page_ord, token, max(list_inner_product(vec, q)) AS m FROM patches, toks GROUP BY ALL), late AS (SELECT query_id, page_ord, sum(m) AS score FROM ms GROUP BY ALL)"


def _pooled(table: str, key: str, vec: str) -> str:
    return f"(SELECT {key} AS k, list(m ORDER BY i) AS v FROM (SELECT {key}, i, avg({vec}[i]) AS m FROM {table}, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)"


def _encoded(name: str, table: str, key: str) -> str:
    """The hashing encoder in SQL: name(k, u)."""
    return f"""{name}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {table})
, {name}_c AS (SELECT k, CAST(('0x' || substr(md5(t), 1, 7))::BIGINT % 64 AS INTEGER) AS dim, sum(CASE WHEN ('0x' || substr(md5(t), 8, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS n FROM {name}_t GROUP BY ALL)
, {name}_v AS (SELECT {key} AS k, list(coalesce(n, 0.0) ORDER BY i) AS v FROM {table} CROSS JOIN range(0, 64) r(i) LEFT JOIN {name}_c c ON c.k = {key} AND c.dim = i GROUP BY 1)
, {name} AS (SELECT k, CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS u FROM {name}_v)"""


_ITEMS = "items AS (SELECT item_id AS qid, text FROM benchmark)"
_ASKED = "items AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id % 100 = 0)"
_TEXT = f"WITH {_ASKED}, {_encoded('dv', 'documents', 'doc_id')}, {_encoded('qv', 'items', 'qid')}, s AS (SELECT qv.k AS query_id, dv.k AS page_ord, list_inner_product(dv.u, qv.u) AS s FROM dv, qv), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_ord) AS r FROM s)"
_KEYWORDS = """sz AS (SELECT doc_id AS page_ord, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS size FROM documents)
, fact AS (SELECT count(*) AS docs, avg(size) AS mean FROM sz)
, tf AS (SELECT k AS page_ord, t, count(*) AS tf FROM dv_t WHERE t IN (SELECT t FROM qv_t) GROUP BY ALL)
, df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)
, kw AS (SELECT q.k AS query_id, tf.page_ord, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score
  FROM (SELECT DISTINCT k, t FROM qv_t) q JOIN tf USING (t) JOIN df USING (t) JOIN sz USING (page_ord), fact GROUP BY ALL)
, kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_ord) AS r FROM kw)"""
_PROMPT = "'You answer questions about document pages.' || chr(10) || 'Question: ' || text || chr(10) || 'Pages attached: 3 (none)' || chr(10) || 'Use these pages only. Name the page behind each statement. If they do not hold the answer, say so. Be brief.'"

SQL: dict[str, str] = {
    "v1_mean_pool": "SELECT CAST(vec_id // 10 AS BIGINT) AS page_ord, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL",
    "v4_dims": "SELECT min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings",
    "v5_unit_norm": f"SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(sqrt(list_inner_product(u, u)), 6) AS unit_norm FROM (SELECT *, {_U} AS u FROM embeddings)",
    "v8_inner_product": f"{_SCORED} SELECT query_id, page_ord, round(s, 6) AS similarity FROM s",
    "v9_topk_single": f"{_SCORED} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(s, 6) AS similarity FROM top WHERE r <= 3 AND query_id = 0",
    "v9_topk_batch": f"{_SCORED} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(s, 6) AS similarity FROM top WHERE r <= 3",
    "v10_page_count": "SELECT count(*) AS pages FROM embeddings",
    "v11_pages_per_doc": f"WITH {_NAMED} SELECT source, count(*) AS pages FROM named GROUP BY 1",
    "v12_running_total": f"WITH {_DOCS} SELECT doc_ord, source, total_pages, CAST(sum(total_pages) OVER (ORDER BY doc_ord) AS BIGINT) AS running_total FROM docs",
    "v14_shape": f"WITH {_PATCH} SELECT count(DISTINCT page_ord) AS pages, CAST(max(patch) + 1 AS BIGINT) AS patches, max(len(vec)) AS dim FROM patches",
    "k4_summary": f"WITH {_PATCH} SELECT count(DISTINCT page_ord) AS pages, CAST(max(patch) + 1 AS BIGINT) AS patches, max(len(vec)) AS dim, round(CAST(sum(len(vec)) AS BIGINT) * 4 / 1e6::DOUBLE, 6) AS megabytes FROM patches",
    "p1_p2_page_metadata": f"WITH {_META} SELECT * FROM meta",
    "p4_image_path": f"WITH {_META} SELECT page_ord, 'page_images/' || {_NAME} AS image_path FROM meta",
    "p6_writer_name_mismatch": f"WITH {_META}, n AS (SELECT page_ord, {_NAME} AS read_as, regexp_replace(source, '\\.[^.]*$', '') || '__page_' || printf('%04d', page) || '.png' AS written_as, replace(source, '.pdf', '') || '__page_' || printf('%04d', page) || '.png' AS notebook_as FROM meta) SELECT * FROM n WHERE read_as <> written_as",
    "p13_prompt": f"SELECT item_id, {_PROMPT} AS prompt FROM benchmark",
    "p15_batches": "SELECT CAST(doc_id // 2 AS BIGINT) AS batch, count(*) AS pages FROM documents GROUP BY 1",
    "j1_hits_with_metadata": f"{_SCORED}, {_META} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, source, page, total_pages, 'page_images/' || {_NAME} AS image_path, round(s, 6) AS similarity FROM top JOIN meta USING (page_ord) WHERE r <= 3",
    "j2_alignment_check": "SELECT vec_id AS page_ord, 'no metadata' AS problem FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'no vector' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "j4_hits_with_images": f"{_SCORED} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord FROM top WHERE r <= 3 AND page_ord IN (SELECT doc_id FROM labels)",
    "j4_images_by_path": f"{_SCORED}, {_META}, paths AS (SELECT page_ord, 'page_images/' || {_NAME} AS image_path FROM meta) SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, image_path FROM top JOIN paths USING (page_ord) WHERE r <= 3 AND image_path IN (SELECT image_path FROM paths SEMI JOIN labels ON page_ord = doc_id)",
    "j5_missing_docs": f"WITH {_NAMED}, a AS (SELECT DISTINCT source FROM named), b AS (SELECT 'Src ' || n_nationkey || '.pdf' AS source FROM nation) SELECT source FROM a WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT source FROM b WHERE source NOT IN (SELECT source FROM a)",
    "k5_display_rows": f"{_SCORED}, {_META} SELECT query_id, CAST(r AS INTEGER) AS rank, r || '. ' || source || ' page ' || page || '/' || total_pages || ' ' || printf('%.4f', round(s, 6)) AS line FROM top JOIN meta USING (page_ord) WHERE r <= 3",
    "u1_corpus_ordinals": f"{_ORD} SELECT * FROM ords",
    "u3_append_equals_rebuild": f"{_ORD} SELECT page_ord, source, page FROM ords",
    "m2_text_query_topk": f"{_TEXT} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(s, 6) AS similarity FROM top WHERE r <= 3",
    "r1_maxsim": f"WITH {_MAXSIM} SELECT query_id, page_ord, round(score, 6) AS score FROM late",
    "r3_rerank": f"WITH {_MAXSIM}, p AS {_pooled('patches', 'page_ord', 'vec')}, t AS {_pooled('toks', 'query_id', 'q')}, s AS (SELECT t.k AS query_id, p.k AS page_ord, list_cosine_similarity(p.v, t.v) AS s FROM p, t), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_ord) AS r FROM s), g AS (SELECT query_id, page_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_ord) AS rank FROM f JOIN late USING (query_id, page_ord) WHERE r <= 20) SELECT query_id, CAST(rank AS INTEGER) AS rank, page_ord, round(score, 6) AS score FROM g WHERE rank <= 3",
    "r4_hybrid_rrf": f"""{_TEXT}
, {_KEYWORDS}
, fused AS (SELECT query_id, page_ord, coalesce(1 / (60 + a.r)::DOUBLE, 0) + coalesce(1 / (60 + b.r)::DOUBLE, 0) AS score FROM (SELECT * FROM top WHERE r <= 20) a FULL JOIN (SELECT * FROM kr WHERE r <= 20) b USING (query_id, page_ord))
, fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_ord) AS r FROM fused)
SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(score, 9) AS score FROM fr WHERE r <= 10""",
    "r2_multivector_topk": f"WITH {_MAXSIM}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_ord) AS r FROM late) SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(score, 6) AS score FROM top WHERE r <= 10",
    "ann_ivf_topk": f"{_SCORED} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(s, 6) AS similarity FROM top WHERE r <= 10",
    "pq_topk": f"{_SCORED} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, round(s, 6) AS similarity FROM top WHERE r <= 10",
    "r4_keyword_topk": f"{_TEXT.replace(_ASKED, _ITEMS)}, {_KEYWORDS} SELECT query_id, CAST(r AS INTEGER) AS rank, page_ord, score FROM kr WHERE r <= 20",
    "asof_sales_changes": "WITH c AS (SELECT client_id, valid_at, max(change_id) AS change_id, arg_max(segment, change_id) AS segment FROM (SELECT client_id, valid_at, change_id, struct_pack(s := segment) AS segment FROM client_changes) GROUP BY ALL) SELECT s.sale_id, s.client_id, c.change_id, c.segment.s AS segment FROM sales s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at",
    "overlap_sales_changes": "SELECT sale_id, change_id FROM sales s JOIN client_changes c ON s.client_id = c.client_id AND sold_at <= arrived_at AND sold_at <= valid_at + INTERVAL 1 HOUR AND valid_at <= arrived_at",
    "r5_chunks": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 200) / 150.0) AS BIGINT) + 1))) AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(w[chunk * 150 + 1 : chunk * 150 + 200]) AS INTEGER) AS n_words, md5(array_to_string(w[chunk * 150 + 1 : chunk * 150 + 200], ' ')) AS chunk_md5 FROM c",
}

QUERIES = {name: globals()[name] for name in SQL}
