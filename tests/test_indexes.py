"""Search over blocks of queries, cells, codes, inverted lists: each against exact search, with what it reads."""

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioscan.functions.vectors import unit
from folioscan.operators import codes, keyword_index, multivector, search, text
from folioscan.operators.codes import CodeIndex
from folioscan.operators.ivf import IvfIndex
from folioscan.operators.keyword_index import KeywordIndex
from folioscan.operators.multivector import MultiVectorIndex


def _vectors(spark, n, dim=16, seed=1, spread=None):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    if spread is not None:
        v = r.normal(size=(12, dim))[r.integers(0, 12, n)] + spread * v
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5:9] = v[5]  # equal vectors, so ties
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "page_ord long, unit_vec array<double>").repartition(4)


def _queries(spark, v, ids):
    return spark.createDataFrame([(int(i), v[i].tolist()) for i in ids], "query_id long, unit_vec array<double>")


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def _plain(v, ids, k):
    out = []
    for i in ids:
        s = np.round(v @ v[i], 12)
        out += [(int(i), r, int(p), round(float(s[p]), 9)) for r, p in enumerate(sorted(range(len(v)), key=lambda p: (-s[p], p))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 9, 1 << 11, 16 << 20])
def test_blocks_of_queries_meet_all_pages_in_one_scan(spark, monkeypatch, tmp_path, size):
    """A few queries a block (512 bytes are four) or all at once: the same rows, and pages are read once."""
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    v, pages = _vectors(spark, 300)
    pages.write.parquet(str(tmp_path / "p"))
    found = search.top_k(spark.read.parquet(str(tmp_path / "p")), _queries(spark, v, range(40)), 4)
    assert _rows(found) == _plain(v, range(40), 4)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 1
    assert _rows(search.top_k(pages, _queries(spark, v, range(3)), 4)) == _plain(v, range(3), 4)


def test_one_block_of_queries_keeps_ties(spark):
    pages = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500, 0, -1)], "page_ord long, unit_vec array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(9)], "query_id long, unit_vec array<double>")
    assert {r["page_ord"] for r in search.top_k(pages, asked, 5).collect()} == {1, 2, 3, 4, 5}


def test_rescore_equals_max_sim(spark):
    r = np.random.default_rng(4)
    patches = spark.createDataFrame([(p, r.normal(size=3).tolist()) for p in range(20) for _ in range(p % 4 + 1)], "page_ord long, vec array<double>").repartition(3)
    tokens = spark.createDataFrame([(q, t, r.normal(size=3).tolist()) for q in range(5) for t in range(q + 1)], "query_id long, token int, vec array<double>")
    wanted = spark.createDataFrame([(q, p) for q in range(5) for p in range(q, 20, 3)] + [(99, 1), (0, 999)], "query_id long, page_ord long")
    want = search.max_sim(patches, tokens).join(wanted, ["query_id", "page_ord"], "left_semi").select("query_id", "page_ord", "score")
    assert _rows(search.rescore(patches, tokens, wanted)) == _rows(want)


@pytest.mark.parametrize("size", [1 << 8, 16 << 20])
def test_late_interaction_shuffles_patches_only(spark, monkeypatch, size):
    """Pages longer than a kernel's chunk, pages of one patch, a token of two rows, queries in one block or several; one exchange, so products aren't shuffled."""
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    r = np.random.default_rng(5)
    v, owner = r.normal(size=(1500, 3)), np.where(np.arange(1500) < 700, 7, r.integers(0, 400, 1500))
    patches = spark.createDataFrame([(int(p), x.tolist()) for p, x in zip(owner, v, strict=True)], "page_ord long, vec array<double>").repartition(3)
    q = [(i, t, r.normal(size=3)) for i in range(9) for t in range(i % 4 + 1)] + [(3, 1, r.normal(size=3))]
    tokens = spark.createDataFrame([(i, t, x.tolist()) for i, t, x in q], "query_id long, token int, vec array<double>")
    want = []
    for i in range(9):
        for p in np.unique(owner):
            best = {}
            for t, x in [(t, x) for j, t, x in q if j == i]:
                best[t] = max(best.get(t, -np.inf), float((v[owner == p] @ x).max()))
            want.append((i, int(p), sum(best.values())))
    found = search.max_sim(patches, tokens)
    got = sorted(map(tuple, found.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan[plan.rindex("MapInArrow") :].count("Exchange") and "Exchange" not in plan[: plan.rindex("MapInArrow")]


def test_cells_are_partitions_that_probes_prune(spark, tmp_path):
    v, pages = _vectors(spark, 1500, spread=0.6)
    index, ids = IvfIndex.build(pages, str(tmp_path / "ivf"), cells=30), range(0, 1500, 30)
    asked = _queries(spark, v, ids)
    assert _rows(index.search(asked, 10, probes=30)) == _plain(v, ids, 10)
    stored = spark.read.parquet(str(tmp_path / "ivf" / "vectors"))
    assert stored.where("home").count() == 1500 and stored.count() > 1500  # copies near boundaries
    probes = index.calibrate(10, 0.9, 100)
    assert probes < 30
    exact = {(r[0], r[2]) for r in _plain(v, ids, 10)}
    got = {(r["query_id"], r["page_ord"]) for r in index.search(asked, 10, probes).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    read = index.probed(_queries(spark, v, [0]), probes)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60] and len(read.inputFiles()) >= 1
    assert read.select("cell").distinct().count() <= probes and read.count() < 1500


def test_unclustered_vectors_reach_recall_too(spark, tmp_path):
    d = "/root/testdata/sf0.001/embeddings.parquet"
    pages = spark.read.parquet(d).select(F.col("vec_id").alias("page_ord"), unit(F.col("embedding")).alias("unit_vec"))
    index = IvfIndex.build(pages, str(tmp_path / "ivf"))
    probes = index.calibrate(10, 0.9, 64)
    asked = pages.where("page_ord % 100 = 0").withColumnRenamed("page_ord", "query_id")
    assert index.recall(asked, 10, probes) >= 0.8 and index.recall(asked, 10, 4096) == 1.0


@pytest.mark.parametrize("size", [1 << 9, 16 << 20])
def test_codes_give_exact_results_from_few_vectors(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    v, pages = _vectors(spark, 2000)
    index, ids = CodeIndex.build(pages, str(tmp_path / "pq")), [0, 5, 7, 700]
    asked = _queries(spark, v, [*ids, *range(800, 804)])
    assert _rows(index.search(asked, 10)) == _plain(v, [*ids, *range(800, 804)], 10)
    assert index.candidates(_queries(spark, v, ids), 10).count() < 0.15 * 4 * 2000
    code = spark.read.parquet(str(tmp_path / "pq" / "codes")).first()["code"]
    assert len(code) * 8 <= 16 * 4  # bytes of a code against those of 16 floats
    few = index.search(_queries(spark, v, [0]), 3000)
    assert few.count() == 2000


def test_codebook_bounds_hold():
    r = np.random.default_rng(2)
    v, q = r.normal(size=(400, 8)), r.normal(size=(5, 8))
    book = codes.Codebook([codes.clusters.k_means(v[:, i : i + 2], 16, 5) for i in range(0, 8, 2)])
    made, err = book.encode(v)
    room = np.linalg.norm(q, axis=1)[:, None] * err
    assert (np.abs(book.scores(book.tables(q), made) - q @ v.T) <= room + 1e-9).all()


@pytest.mark.parametrize(("spread", "probes"), [(0.05, 1), (0.05, 3), (1.0, 1)])
def test_inverted_lists_give_exact_late_interaction(spark, tmp_path, spread, probes):
    v, _ = _vectors(spark, 900, spread=spread)
    patches = spark.createDataFrame([(i // 6 - (i % 7 == 0 and i > 6), x.tolist()) for i, x in enumerate(v)], "page_ord long, vec array<float>").repartition(4)
    tokens = spark.createDataFrame([(q, t, v[(q * 37 + t) % 900].tolist()) for q in range(6) for t in range(4)], "query_id long, token int, vec array<float>")
    index = MultiVectorIndex.build(patches, str(tmp_path / "mv"), cells=16)
    want = _rows(search.best(search.max_sim(patches, tokens), 10, "score"))
    got = _rows(index.search(tokens, 10, probes))
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    kept = index.candidates(tokens, 10)
    pages = patches.select("page_ord").distinct().count()
    assert kept.count() < 0.3 * 6 * pages


def test_late_interaction_in_blocks_of_tokens(spark, tmp_path, monkeypatch):
    """Blocks of two queries, products of few rows: the same pages."""
    monkeypatch.setattr(multivector, "TOKEN_BYTES", 1024)
    monkeypatch.setattr(multivector, "PATCHES_AT_ONCE", 7)
    monkeypatch.setattr(multivector, "TOKENS_AT_ONCE", 5)
    v, _ = _vectors(spark, 300, spread=1.0)
    patches = spark.createDataFrame([(i // 6, x.tolist()) for i, x in enumerate(v)], "page_ord long, vec array<float>")
    tokens = spark.createDataFrame([(q, t, v[(q * 37 + t) % 300].tolist()) for q in range(5) for t in range(4)], "query_id long, token int, vec array<float>")
    index = MultiVectorIndex.build(patches, str(tmp_path / "mv"), cells=8)
    assert len(list(index._blocks(tokens, 1))) > 1
    want = _rows(search.best(search.max_sim(patches, tokens), 10, "score"))
    assert [r[:3] for r in _rows(index.search(tokens, 10, 1))] == [r[:3] for r in want]


def test_tasks_get_no_table_of_tokens_by_lists():
    r = np.random.default_rng(1)
    rows = [(i // 10, i % 10, x) for i, x in enumerate(r.normal(size=(2000, 8)))]
    tokens = multivector._Tokens(rows, r.normal(size=(1500, 8)), np.full(1500, 0.1), 2)
    assert len(pickle.dumps(tokens)) < 6 * tokens.matrix.nbytes  # 128,000; the table would be 3,000,000
    assert all(len(tokens.asked[c]) for c in tokens.asked) and max(tokens.asked) < 1500


def test_inverted_lists_of_the_given_vectors_read_few_pages(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    patches = d.select(F.floor(F.col("vec_id") / 10).alias("page_ord"), F.col("embedding").alias("vec"))
    tokens = d.where("vec_id % 100 < 10").select((F.floor(F.col("vec_id") / 100) * 100).alias("query_id"), (F.col("vec_id") % 10).cast("int").alias("token"), F.col("embedding").alias("vec"))
    index = MultiVectorIndex.build(patches, str(tmp_path / "mv"))
    kept = index.candidates(tokens, 10)
    assert kept.count() <= 0.4 * 5 * 50  # 10 of 50 pages for each of 5 queries at least


def test_keyword_index_skips_postings(spark, tmp_path):
    rows = [(i, " ".join(["common"] * (i % 5 + 1) + [f"w{i % 97 if i < 600 else i // 30}", "Filler"] * (1 + i % 3) + ["w7"] * (i % 500 == 7) * 9)) for i in range(3000)] + [(5000, None), (5001, ""), (5002, "!?")]
    docs = spark.createDataFrame(rows, "page_ord long, text string").repartition(4)
    asked = spark.createDataFrame([(0, "common w5"), (1, "W7, w8!"), (2, "absent"), (3, None), (4, "filler")], "query_id long, text string")
    index = KeywordIndex.build(docs, str(tmp_path / "k"))
    counts = text.counted(docs, "page_ord", "text")
    want = text.ranked(text.keyword_scores(counts, asked, "page_ord", "text"), "page_ord", "score", 10).select("query_id", "rank", "page_ord", "score")
    assert _rows(index.search(asked, 10)) == _rows(want)
    # a rare word decides, so zones that only hold the frequent one aren't read
    assert _rows(index.search(asked, 3)) == [r for r in _rows(want) if r[1] <= 3]
    assert index.share_read(asked.where("query_id = 0"), 3) < 0.5
    assert index.search(asked.where("query_id > 1 and query_id < 4"), 10).count() == 0
    with pytest.raises(ValueError):
        index.search(asked, 0)


def test_keyword_index_deals_texts_not_postings(spark, tmp_path, monkeypatch):
    """Texts in no order, zones over several batches, negative keys: blocks are as counted one by one, and rows that are dealt out are texts."""
    rows = [(i - 40, f"a b{i % 3} " * (i % 4) + "c" * (i % 7 == 0)) for i in range(1300)]
    docs = spark.createDataFrame(rows, "page_ord long, text string").repartition(5)
    dealt, plain = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *a: dealt.append(self.columns) or plain(self, *a))
    index = KeywordIndex.build(docs, str(tmp_path / "k"), zone=16)
    assert dealt == [["page_ord", "text"]]
    want = {}
    for page, body in rows:
        words = body.split()
        for t in sorted(set(words)):
            want.setdefault((t, page // 16), []).append((page % 16, words.count(t), len(words)))
    got = {(r["t"], r["zone"]): ([tuple(p) for p in r["postings"]], r["n"], r["most"]) for r in index.blocks().collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == len(v[0]) for v in got.values())
    mean = sum(len(b.split()) for _, b in rows) / len(rows)
    assert all(abs(most - max(text.impact(tf, size, mean) for _, tf, size in posted)) < 1e-9 for posted, _, most in got.values())


def test_keyword_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None)], "page_ord long, text string")
    index = KeywordIndex.build(docs, str(tmp_path / "k"))
    assert index.search(spark.createDataFrame([(0, "a")], "query_id long, text string"), 3).count() == 0


def test_keyword_index_takes_queries_in_blocks(spark, tmp_path, monkeypatch):
    """Many queries in blocks, zones that don't travel, rows of one id, an id that is null and equal texts: scores as counted one by one."""
    monkeypatch.setattr(keyword_index, "PAIRS", 9)
    monkeypatch.setattr(keyword_index, "QUERIES", 4)
    monkeypatch.setattr(keyword_index, "ZONES", 0)
    rows = [(i - 40, f"a b{i % 3} " * (i % 4) + f"c{i % 50} " * (i % 7 == 0) + "d" * (i % 2)) for i in range(900)]
    docs = spark.createDataFrame(rows, "page_ord long, text string").repartition(5)
    texts = [(q, f"A b{q % 4} c{q % 60} absent") for q in range(11)] + [(None, "a c7"), (20, "b1"), (20, "b1 d"), (21, None)]
    index = KeywordIndex.build(docs, str(tmp_path / "k"), zone=16)
    asked = spark.createDataFrame(texts, "query_id long, text string")
    assert len(list(index._asked(asked, "text"))) > 1
    one_by_one = spark.createDataFrame([(-1 if q is None else q, body) for q, body in texts if body != "b1"], "query_id long, text string")
    want = text.ranked(text.keyword_scores(text.counted(docs, "page_ord", "text"), one_by_one, "page_ord", "text"), "page_ord", "score", 8)
    got = index.search(asked, 8).collect()
    assert sorted((-1 if q is None else q, *rest) for q, *rest in got) == _rows(want.select("query_id", "rank", "page_ord", "score"))
    assert len(got) == 13 * 8


@pytest.mark.parametrize(("cells", "size"), [(1 << 21, 1000), (300, 7), (1, 1)])
def test_keyword_scores_of_zones_over_batches(monkeypatch, cells, size):
    monkeypatch.setattr(keyword_index, "CELLS", cells)
    r = np.random.default_rng(3)
    asked = keyword_index._Asked([Row(query_id=q, t=f"t{t}", idf=1.0 + t / 8, bucket=t) for q in range(6) for t in range(q, 20, q + 1)], LongType())
    rows, scores = [], {}
    for zone in [-1, 0, 4, 5, 6, 9]:
        for t in r.permutation(list(asked.words))[: 3 * zone + 4]:
            posted = [(int(at), int(r.integers(1, 5)), 9) for at in np.flatnonzero(r.random(4) < 0.6)] or [(2, 1, 9)]
            share = [text.impact(tf, n, 8.0) for _, tf, n in posted]
            rows.append((asked.words[t], zone, max(share), *map(list, zip(*posted, strict=True))))
            for q in range(6):
                for at, own in zip(posted, share, strict=True):
                    if int(t[1:]) in range(q, 20, q + 1):
                        scores[q, zone * 4 + at[0]] = scores.get((q, zone * 4 + at[0]), 0) + own * (1 + int(t[1:]) / 8)
    kinds = [pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.int32())] * 3]
    whole = pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "zone", "most", "at", "tf", "size"])
    found = pa.Table.from_batches(keyword_index._best(asked, 3, 4, 8.0, np.full(6, -np.inf), asked.ids)(iter(whole.to_batches(size)))).to_pylist()
    want = [sorted(((q, p, round(s, 9)) for (q, p), s in scores.items() if q == n), key=lambda x: (-x[2], x[1]))[:3] for n in range(6)]
    assert sorted((x["query_id"], x["page_ord"], x["score"]) for x in found) == sorted(x for some in want for x in some)
    most = pa.Table.from_batches(keyword_index._bounds(asked)(iter(whole.select(["word", "zone", "most"]).to_batches(size)))).to_pylist()
    bound = {(x["query"], x["zone"]): x["most"] for x in most}
    assert len(bound) == len(most) and all(s <= bound[q, p // 4] + 1e-9 for (q, p), s in scores.items())


def test_texts_are_encoded_where_they_are_read(spark, monkeypatch):
    """No exchange, hashes that are forgotten in between, null and empty texts; of counted tokens only those asked for are held, and every text's size."""
    monkeypatch.setattr(text, "KNOWN", 3)
    rows = [(i, f"Alpha beta beta w{i % 9} Ñandú 7 " * (i % 3)) for i in range(700)] + [(900, None), (901, "!?")]
    docs = spark.createDataFrame(rows, "page_ord long, text string").repartition(3)
    found = text.encode(docs, "page_ord", "text")
    assert "Exchange" not in text.encode(spark.createDataFrame(rows, "page_ord long, text string"), "page_ord", "text")._jdf.queryExecution().executedPlan().toString()
    got = {r["page_ord"]: np.array(r["unit_vec"]) for r in found.collect()}
    assert sorted(got) == sorted(p for p, _ in rows)
    for page, body in rows:
        v = np.zeros(64)
        for t in re.findall(r"\w+", (body or "").lower()):
            h = hashlib.md5(t.encode()).hexdigest()
            v[int(h[:7], 16) % 64] += 1 if int(h[7], 16) < 8 else -1
        assert np.allclose(got[page], v / (np.linalg.norm(v) or 1), atol=1e-12)
    asked = spark.createDataFrame([(0, "beta w4 w4"), (1, None), (2, "BETA nothing")], "query_id long, text string")
    some, every = text.counted_for(docs, "page_ord", "text", asked, "text"), text.counted(docs, "page_ord", "text")
    assert {r["t"] for r in some.select("t").distinct().collect()} == {"beta", "w4", None} and some.where("t is null").count() == 702
    assert _rows(text.keyword_scores(some, asked, "page_ord", "text")) == _rows(text.keyword_scores(every, asked, "page_ord", "text"))
    assert text.facts(some, "page_ord").first() == text.facts(every, "page_ord").first()
