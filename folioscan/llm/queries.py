"""The thin queries over the driver's tables and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from folioscan.llm import clustered_layout, conversation_repair, embedding_dedup, exact_dedup, language_id, license_scan, minhash_dedup, packing, sentencepiece_codec, suffix_dedup, token_counts, topk_search, url_filter
from folioscan.llm.common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The rules of op1_url_filter, fixed by its contract.
URL_RULES = [
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=400, digest=True)


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.range_links(_read(spark, sf_dir, "embeddings"), least=0.9)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"), license_scan.NOTICES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' token streams as blocks, scans them, and puts the ids back beside the counts."""
    import public_tokenizers

    # The vocabulary ends at 50256, which the text of the end marker itself gives.
    end_id = 50257
    stream = token_counts.token_stream(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id)
    blocks = Scratch(spark, "tokens").table(stream, "blocks")
    counts = token_counts.count_tokens(blocks, end_id)
    named = blocks.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("doc_index"), "doc_id")
    return counts.join(named, ["file", "doc_index"]).select("doc_id", "file", "doc_index", "start", "n_tokens")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 365).cast("long")
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    dims = [("source", F.col("source"), 0, True), ("lang", F.col("lang"), 0, True), ("length", length, 2), ("date", date, 2)]
    found = clustered_layout.layout(_read(spark, sf_dir, "documents"), [clustered_layout.Dimension(*d) for d in dims])
    return found.with_queries().select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_components(_read(spark, sf_dir, "documents"), k=2)


#: Links (a, b) with their least reachable id, as the tail of a query that defines vertices(id) and links(a, b).
_REACH = """
, sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links)
, reach(id, r) AS (SELECT id, id FROM vertices UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
, low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
"""

_OP2 = (
    """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
, vertices AS (SELECT vec_id AS id FROM embeddings)
, links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.9)
"""
    + _REACH
    + """
, n AS (SELECT a AS id, count(*) AS n FROM sym GROUP BY 1)
SELECT low.id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, low.id = component_id AS kept FROM low LEFT JOIN n USING (id)
"""
)

_OP3 = (
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
, sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words)
, vertices AS (SELECT doc_id AS id FROM sets)
, items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets)
, shared AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c
  FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2)
, links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c))
"""
    + _REACH
    + """
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low ON low.id = doc_id
"""
)

_OP1 = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages)
, rest AS (SELECT page_id, p > 0 AS found, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS r FROM parts)
, split AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest)
, rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
, hits AS (
  SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM split LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE k = 1
"""

_OP4 = """
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents)
, starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS p, h FROM docs WHERE length(h) >= 800)
, hashed AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM starts)
, twice AS (SELECT m FROM hashed GROUP BY m HAVING count(*) > 1)
, hits AS (SELECT doc_id, p FROM hashed SEMI JOIN twice USING (m))
, runs AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM hits)
, numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM runs)
, spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY 1, 2)
, cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS ends, [0] || list(b ORDER BY a) AS begins FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1),
    lambda i: substr(h, 2 * begins[i] + 1, 2 * (coalesce(ends[i], length(h) // 2) - begins[i]))), ''))) END AS kept_sha256
FROM docs d LEFT JOIN cuts USING (doc_id)
"""

def _licenses_sql(k: int = 5, percent: int = 80) -> str:
    """Every window of every text against every template, by the shingles that both hold."""
    rows = []
    for t in license_scan.NOTICES:
        words = license_scan.template_words(t.text)
        size, step = license_scan.window(len(words))
        grams = sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        rows += [f"('{t.name}', '{g}', {len(grams)}, {size}, {step})" for g in grams]
    return f"""
WITH t(template, gram, n, size, step) AS (VALUES {", ".join(rows)})
, w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents)
, g AS (SELECT doc_id, unnest(range(1, len(words) - {k - 2})) AS i, words FROM w WHERE len(words) >= {k})
, hits AS (SELECT doc_id, template, gram, n, size, step, i - 1 AS p FROM g JOIN t ON array_to_string(words[i : i + {k - 1}], ' ') = gram)
, windows AS (SELECT *, unnest(range(0, p + 1, step)) AS start FROM hits)
, held AS (SELECT doc_id, template, n, start, count(DISTINCT gram) AS c FROM windows WHERE p + {k} <= start + size GROUP BY ALL)
, best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY c DESC, start) AS r FROM held WHERE c * 100 >= n * {percent})
SELECT doc_id, template, CAST(start AS BIGINT) AS start_word, CAST(c AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles FROM best WHERE r = 1
"""


_OP6 = _licenses_sql()

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
, s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

#: crc32 of the column `s`, a byte at a time.
_CRC32 = """xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda acc, b:
  xor(acc >> 8, list_reduce(range(0, 8)::BIGINT[], lambda n, j: CASE WHEN n & 1 = 1 THEN xor(n >> 1, 3988292384) ELSE n >> 1 END, xor(acc, b) & 255)), 4294967295::BIGINT), 4294967295)"""

_OP11 = f"""
WITH vals AS (SELECT doc_id, encode(source) AS v0, encode(lang) AS v1, CASE WHEN text IS NULL THEN -1 ELSE strlen(text) END AS v2, {_CRC32} % 365 AS v3
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents))
, c AS (SELECT doc_id, {", ".join(f"16 * (rank() OVER (ORDER BY v{i} NULLS FIRST) - 1) // count(*) OVER () AS c{i}" for i in range(4))} FROM vals)
, zs AS (SELECT *, {" + ".join(f"((c{i} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in range(4) for i in range(4))} AS z FROM c)
, p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM zs)
, f AS (SELECT *, position // 1000 AS file FROM p)
, bounds AS (SELECT file, {", ".join(f"min(c{i}) AS a{i}, max(c{i}) AS b{i}" for i in range(4))} FROM f GROUP BY file)
, cells AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM f)
, held AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM f)
, touched AS (SELECT z, count(*) AS files_touched FROM cells q JOIN bounds ON q.c0 BETWEEN a0 AND b0 AND q.c1 BETWEEN a1 AND b1 AND q.c2 - 2 <= b2 AND q.c2 + 2 >= a2 AND q.c3 - 2 <= b3 AND q.c3 + 2 >= a3 GROUP BY z)
, matching AS (SELECT z, count(DISTINCT file) AS files_matching FROM cells q JOIN held h ON q.c0 = h.c0 AND q.c1 = h.c1 AND abs(q.c2 - h.c2) <= 2 AND abs(q.c3 - h.c3) <= 2 GROUP BY z)
SELECT doc_id, CAST(z AS BIGINT) AS z, CAST(position AS BIGINT) AS position, CAST(file AS BIGINT) AS file, files_touched, files_matching,
  concat_ws(',', {", ".join(f"a{i}, b{i}" for i in range(4))}) AS file_bounds
FROM f JOIN bounds USING (file) JOIN touched USING (z) JOIN matching USING (z)
"""

_OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256 FROM t WINDOW same AS (PARTITION BY text)
"""

_OP13 = f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations)
, kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32} % 20 AS k FROM keyed)
, hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE k <> 0)
, ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ending FROM hurt)
, r AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT right(ending, 1) IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered)
, counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND NOT before || initial IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
, ins(st, nx, e, cost, roles) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']),
    (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:']))
, edits(e, initial, st, nx, cost) AS (VALUES ('D', '*', 0, 0, 3), ('D', '*', 1, 1, 3), ('D', '*', 2, 2, 3), ('D', '*', 3, 3, 3), ('R', '*', 0, 2, 2), ('R', '*', 1, 2, 2), ('R', '*', 2, 3, 2), ('R', '*', 3, 2, 2),
    ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0))
, paths(conv_id, i, st, cost, audit, rows) AS (
    SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
    SELECT conv_id, i, nx, cost, audit, rows FROM (
      SELECT p.conv_id, r.i, d.nx, p.cost + n.cost + d.cost + CASE WHEN d.e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, p.audit || n.e || d.e AS audit,
        p.rows || n.roles || CASE d.e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE d.nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END AS rows,
        row_number() OVER (PARTITION BY p.conv_id, d.nx ORDER BY p.cost + n.cost + d.cost + CASE WHEN d.e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, p.audit || n.e || d.e) AS k
      FROM paths p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN ins n ON n.st = p.st JOIN edits d ON d.st = n.nx AND (d.initial = '*' OR d.initial = r.initial)
        AND (d.e = 'D' OR NOT fault IN ('blank', 'duplicate'))) WHERE k = 1)
, size AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id)
, done AS (SELECT p.conv_id, p.cost + n.cost AS cost, p.audit || n.e AS audit, p.rows || n.roles AS rows, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.cost, p.audit || n.e) AS k
    FROM paths p JOIN size z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.n = p.i JOIN ins n ON n.st = p.st AND n.nx IN (0, 3))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(d.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id AND d.k = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_embedding": op2_embedding,
    "op3_minhash": op3_minhash,
    "op4_suffix": op4_suffix,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_licenses": op6_licenses,
    "op7_token_counts": op7_token_counts,
    "op8_topk": op8_topk,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_layout": op11_layout,
    "op12_exact": op12_exact,
    "op13_repair": op13_repair,
}
SQL: dict[str, str] = {"op1_url_filter": _OP1, "op2_embedding": _OP2, "op3_minhash": _OP3, "op4_suffix": _OP4, "op6_licenses": _OP6, "op8_topk": _OP8, "op11_layout": _OP11, "op12_exact": _OP12, "op13_repair": _OP13}
