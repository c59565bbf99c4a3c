"""Each stage of the pipeline on what the one before kept, against plain versions."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import near_duplicates, repeats
from pyspark.sql import functions as F

from folioscan.llm import byte_bpe, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 %%", None, None, 5), (9003, "", "fr", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    language, near, cut, packed = kept
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"] for r in language} == set(source)
    groups = near_duplicates([(r["doc_id"], r["text"]) for r in language], 5)[1]
    assert {r["doc_id"] for r in near} == set(groups.values())
    rows = sorted((r["doc_id"], r["text"]) for r in near)
    want = repeats([t for _, t in rows], 400, 51)
    assert {r["doc_id"]: r["text"] for r in cut} == {i: w[2].decode("utf-8", "ignore") for (i, _), w in zip(rows, want, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    bpe = byte_bpe.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(bpe.encode(r["text"])) // 4 + 1 for r in cut}
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == sizes


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).agg(F.count("*")).first()[0] == 0


def test_passages_of_over_50_words_go_however_short(spark):
    """Shared passages of 51 words and some 280 bytes, of 51 words of one letter, and one of 50 words, which stays."""
    r = random.Random(51)
    own = lambda: [f"{r.choice('bcdfg')}{r.randrange(10**6):06d}" for _ in range(60)]
    shared = [f"w{r.randrange(1000):03d}{'é' * (i % 3 == 0)}" for i in range(51)]
    letters = [r.choice("abcdefghij") for _ in range(51)]
    less = [f"v{r.randrange(1000):03d}" for _ in range(50)]
    assert 250 < len(" ".join(shared).encode()) < 300
    texts, want = [], []
    for i, passage in enumerate((shared, shared, letters, letters, less, less)):
        before, after = own(), own()
        texts.append(" ".join(before) + " " + ("\n" if i % 2 else " ").join(passage) + " " + " ".join(after))
        want.append(" ".join(before) + "  " + " ".join(after) if passage is not less else texts[-1])
    texts += ["x " * 40, None, ""]
    want += ["x " * 40, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeats(spark, docs, DATA).collect()}
    assert got == dict(enumerate(want))


def test_passages_equal_brute_force(spark):
    rows = sorted((x["doc_id"], x["text"]) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    for i, t in rows:
        begins, ends, _ = suffix_dedup.words(np.frombuffer(t.encode(), dtype=np.uint8))
        assert [t.encode()[a:b] for a, b in zip(begins, ends, strict=True)] == t.encode().split()
    want = {i: w[2].decode("utf-8", "ignore") for (i, _), w in zip(rows, repeats([t for _, t in rows], 400, 51), strict=True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (512, 8):
        assert {x["doc_id"]: x["kept_text"] for x in suffix_dedup.remove_repeats(docs, length=400, n_words=51, group=group).collect()} == want


def test_repeated_rows_leave_one(spark):
    """Copies of over 400 bytes that share an id, or have none, through both stages."""
    r = random.Random(5)
    a, b, c, d = (" ".join(f"{x}{r.randrange(10**6):06d}" for _ in range(80)) for x in "abcd")
    rows = [(1, a), (1, a), (2, b), (2, c), (2, c.upper()), (None, d), (None, d), (None, b), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert near.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (2, b), (2, min(c, c.upper())), (3, ""), (None, d), (None, None)]
    for out in (near, corpus_pipeline.repeats(spark, near, DATA)):
        assert sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr) == sorted(want, key=repr)
