"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import components, near_duplicates, repeats, sha
from pyspark.sql import functions as F

from folioscan.llm import byte_bpe, embedding_dedup, language_id, license_scan, minhash_dedup, packing, sentencepiece_codec, suffix_dedup, textcodes, token_counts, topk_search, url_filter
from folioscan.llm.common import mix64

LONG = " ".join(f"w{i % 7919}" for i in range(300_000))
EDGE = [None, "", " \n\t ", "One", "one", "Été à la\u00a0plage", "x" * 5000, "日本語 😀 text", LONG]


def _docs(spark, texts, start=0):
    """Rows with clashing extra columns."""
    schema = "doc_id long, text string, lang string, component_id string, kept string, score string, host string, key string, id string"
    return spark.createDataFrame([(start + i, t, None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)], schema)


def _prose(seed, n, words=120):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 4 and out:
            w = out[r.randrange(len(out))].split(" ")
            for _ in range(r.randrange(0, 12)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"t{r.randrange(400)}" for _ in range(words)))
    return out


# 1


URLS = [None, "", "no-scheme.com/en/", "http://Example.COM/en/1", "http://www.example.com/en/", "https://a.www.example.com/en/x?y#z", "http://example.com", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "ftp://net/fr/", "http://example.com?q=/en/", "http://a.com/b://c.net/es/", "http://a.com:80/", "x://\n/en/"]


def _judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))] if path[:1] == "/" else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [100, 0])
def test_url_filter(spark, inline):
    from folioscan.llm.queries import URL_RULES

    rules = [*URL_RULES, url_filter.UrlRule("---", "/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, rules, inline=inline).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [_judge(u, rules) for u in [*URLS, *URLS]]
    assert url_filter.filter_urls(pages.limit(0), rules, inline=inline).count() == 0
    assert url_filter.filter_urls(pages, [], inline=inline).where("verdict <> 'allow'").count() == 0


def test_url_filter_is_native(spark):
    from folioscan.llm.queries import URL_RULES

    pages = spark.createDataFrame([(1, "a")], "page_id long, url string")
    plan = url_filter.filter_urls(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# 2


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, component_id string, key string")


def test_range_links(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = r.normal(size=6)
        rows += [(len(rows) + j, [float(x) for x in np.float32(base + r.normal(size=6) * 0.25)]) for j in range(5)]
    n = len(rows)
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 6), (n + 5, [float("nan")] + [1.0] * 5), (n + 6, [None] + [1.0] * 5), (n + 7, [1.0, 0.0]), (n + 8, [2.0, 0.0]), (n + 9, [float("inf")] * 6)]
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    want = components([i for i, _ in rows], links)
    count = {i: sum(i in p for p in links) for i, _ in rows}
    for sizes in ({}, {"cell": 40, "block": 16, "wide": 50}):
        got = embedding_dedup.range_links(_vectors(spark, [*rows, (None, rows[0][1])]), 0.9, **sizes).collect()
        assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == want
        assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None} == count
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
        assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)]
    assert embedding_dedup.range_links(_vectors(spark, []), 0.9).count() == 0


def test_vectors_go_where_partners_can_be():
    """Grids follow what a cell receives: apart from their home, vectors of far clusters aren't sent anywhere; batches are bounded."""
    import pyarrow as pa

    r = np.random.default_rng(4)
    centres = np.eye(16)
    m = np.repeat(centres, 200, axis=0) + r.normal(size=(3200, 16)) * 0.01
    pivots, theta = {16: (0, centres)}, float(np.arccos(0.9)) + 1e-9
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3200)), pa.array([x.tobytes() for x in m]), pa.array(np.ones(3200, np.int64))], names=["id", "vector", "weight"])
    placed = next(embedding_dedup._place(pivots)(iter([rows])))
    homes, angles = np.asarray(placed.column(3)), np.asarray(placed.column(4))
    radius = {c: float(angles[homes == c].max()) + 1e-9 for c in range(16)}
    got = next(embedding_dedup._received(pivots, radius, theta)(iter([placed.select(["vector", "cell", "angle"])])))
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == dict.fromkeys(range(16), 200)
    for high, wide, most in ((1, 1, 4 << 20), (2, 3, 128 * 50)):
        embedding_dedup.OUT_BYTES, before = most, embedding_dedup.OUT_BYTES
        try:
            sent = list(embedding_dedup._replicate(pivots, radius, dict.fromkeys(radius, (high, wide)), theta)(iter([placed])))
        finally:
            embedding_dedup.OUT_BYTES = before
        assert sum(b.num_rows for b in sent) == 3200 * (high + wide) and max(b.num_rows for b in sent) <= most // 128 + 1024
        table = pa.Table.from_batches(sent).to_pandas()
        pairs = table[table.home].merge(table[~table.home], on=["cell", "h", "w"])
        assert len(pairs) == 16 * 200 * 200 and not pairs.duplicated(["id_x", "id_y"]).any()


# 3


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, k):
    texts = [*EDGE, *_prose(3, 160), *["same text here now and then"] * 9]
    docs = _docs(spark, texts).unionByName(_docs(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")))
    got = minhash_dedup.minhash_components(docs, k=k).collect()
    sizes, want = near_duplicates(list(enumerate(texts)), k)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == sizes
    assert len(got) == len(texts) + 1
    assert minhash_dedup.minhash_components(docs.limit(0), k=k).count() == 0


def test_minhash_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "MEMBERS", 4)
    monkeypatch.setattr(minhash_dedup, "HOME_BYTES", 1000)
    monkeypatch.setattr(minhash_dedup, "PAIRS_A_GROUP", 3)
    texts = _prose(5, 120, 60)
    got = minhash_dedup.minhash_components(_docs(spark, texts), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_duplicates(list(enumerate(texts)), 2)[1]


def test_minhash_tells_self_similar_words_apart(spark):
    """Thue-Morse words and their complements, whose polynomial hashes modulo 2**64 are equal, and documents of two such words."""
    word = "a"
    texts = []
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 512:
            other = word.translate(str.maketrans("ab", "ba"))
            texts += [word, other, f"{word} {other}", f"{other} {word}", f"{word} {word}", word]
    got = minhash_dedup.minhash_components(_docs(spark, texts), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_duplicates(list(enumerate(texts)), 2)[1]
    cut = suffix_dedup.remove_repeats(_docs(spark, [x * 2 for x in texts]), length=400, digest=True).orderBy("doc_id").collect()
    assert [r["kept_sha256"] for r in cut] == [sha(w[2]) for w in repeats([x * 2 for x in texts], 400)]


def test_minhash_ids_with_several_texts(spark):
    r = random.Random(6)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, c), (12, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"]) for x in minhash_dedup.minhash_components(docs, k=2).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 11)}


def test_hot_vertices(spark, monkeypatch):
    from folioscan.llm import common, components as cc

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    r = random.Random(12)
    links = [(0, i) for i in range(1, 900)] + [(1000 + i // 3, 2000 + i) for i in range(900)] + [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(700)] + [(4, 4)]
    scratch = common.Scratch(spark, "test")
    got = {x["id"]: x["component_id"] for x in cc.connected_components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    want = components({x for p in links for x in p}, links)
    assert got == {i: want[i] for i in got} and {i for i, c in want.items() if i != c} <= set(got)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    for shared in (400, 320, 100, 3):
        b = np.unique(np.concatenate([a[:shared], r.integers(0, 2**63, 400 - shared).astype(np.uint64)]))
        x, y = minhash_dedup.sketch([a, b], 2048)
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - j) < 0.06
    assert (minhash_dedup.sketch([a[:1]], 64) < np.iinfo(np.uint64).max).all()


# 4


@pytest.mark.parametrize("group", [512, 2])
def test_repeats(spark, group):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [word(90) for _ in range(4)]
    texts = [None, "", "short", "z" * 300, passages[0]]
    for i in range(40):
        texts.append(word(r.randrange(0, 120)) + passages[r.randrange(4)][r.randrange(0, 20) :] + word(r.randrange(0, 120)) + (passages[r.randrange(4)] if i % 3 else ""))
    texts += [texts[9], texts[9], word(3000)]
    got = suffix_dedup.remove_repeats(_docs(spark, texts), length=64, digest=True, group=group).orderBy("doc_id").collect()
    want = repeats(texts, 64)
    assert [(r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == [(a, b, sha(c)) for a, b, c in want]
    kept = suffix_dedup.remove_repeats(_docs(spark, texts), length=64, group=group).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in kept] == [None if t is None else w[2].decode("utf-8", "ignore") for t, w in zip(texts, want, strict=True)]
    odd = _docs(spark, texts).select(F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.floor(F.col("doc_id") / 2)).alias("doc_id"), F.col("doc_id").alias("row"), "text")
    moved = suffix_dedup.remove_repeats(odd, length=64, keep=["row"], group=group).orderBy("row").collect()
    assert [r["kept_text"] for r in moved] == [r["kept_text"] for r in kept]
    assert suffix_dedup.remove_repeats(_docs(spark, texts).limit(0), length=64).count() == 0


def test_long_texts_are_sampled_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    r = random.Random(14)
    texts = ["".join(r.choice("ab ") for _ in range(3000)) for _ in range(3)]
    texts += [texts[0][700:1900] + texts[1][:90], "ab" * 1500, texts[2][:499], texts[2][:501]]
    got = suffix_dedup.remove_repeats(_docs(spark, texts), length=64, digest=True).orderBy("doc_id").collect()
    assert [r["kept_sha256"] for r in got] == [sha(w[2]) for w in repeats(texts, 64)]


def test_intervals():
    text = b"mississippi"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(text[a:], text[b:], strict=False)) if x != y), min(len(text) - a, len(text) - b))
    lcp = np.array([common(a, b) for a, b in zip(order, order[1:], strict=False)])
    found = {(n, tuple(sorted(order[a:b]))) for n, a, b in suffix_dedup.intervals(lcp) if n}
    assert found == {(1, (1, 4, 7, 10)), (4, (1, 4)), (1, (8, 9)), (1, (2, 3, 5, 6)), (3, (2, 5)), (2, (3, 6))}


# 5


def test_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    texts = [*EDGE[:-1], LONG[:20000], "  two  spaces ", "a\n\nb", "tab\tx"]
    docs = _docs(spark, [*texts, *texts])
    got = sentencepiece_codec.encode(docs, path, check=True).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [None if t is None else library.encode(t) for t in [*texts, *texts]]
    assert all(r["restored"] for r in got if r["ids"] is not None)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [*texts, *texts]
    assert sentencepiece_codec.encode(docs.limit(0), path).count() == 0


def _unigram(path, bytes_, own=()):
    """A unigram model written by hand: scores are multiples of 1/8, so that sums are exact and ties frequent."""
    from sentencepiece import sentencepiece_model_pb2

    r = random.Random(5)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.trainer_spec.model_type = 1
    spec.trainer_spec.byte_fallback = bytes_
    spec.normalizer_spec.name = "identity"
    letters = "abcdé日"
    strings = {"▁", *letters, *(m + "".join(r.choices(letters, k=r.randint(1, 5))) for m in ("", "▁") for _ in range(150))}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_ else []
    pieces += [(s, -r.randint(8, 40) / 8, 1) for s in sorted(strings - set(own))] + [(s, 0.0, 4) for s in own]
    for piece, score, kind in pieces:
        spec.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(spec.SerializeToString())
    return str(path)


@pytest.mark.parametrize("bytes_", [False, True])
@pytest.mark.parametrize("own", [(), ("cab", "▁dad")])
def test_sentencepiece_unigram(spark, tmp_path, bytes_, own):
    """Shared-prefix Viterbi against the library: ties, unknown letters in runs and at a text's start, a long text, a user's own pieces."""
    from sentencepiece import SentencePieceProcessor

    path = _unigram(tmp_path / "unigram.model", bytes_, own)
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("aabbccdé日xy", k=r.randint(1, 12))) for _ in range(r.randint(1, 40))) for _ in range(300)]
    texts += [None, "", "   ", "x", "xxyx xx a", "a" * 30_000, "abcd" * 6000 + " x " * 3000, "cab dad cabdad", texts[0], "a  b\n c"]
    docs = _docs(spark, texts)
    library = SentencePieceProcessor(model_file=path)
    got = [r["ids"] for r in sentencepiece_codec.encode(docs, path).orderBy("doc_id").collect()]
    want = [None if t is None else library.encode(t) for t in texts]
    assert got == want
    back = [r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).orderBy("doc_id").collect()]
    assert back == [None if x is None else library.decode(x) for x in want]


# 6


def test_licenses(spark):
    gpl = license_scan.NOTICES[2].text
    filler = " ".join(f"f{i}" for i in range(97))
    texts = [*EDGE, f"{filler}\n{gpl} {filler}", gpl.upper(), gpl.replace("version", "revision"), f"{gpl} x {gpl}", "licensed under nothing", "Released under the MIT License"]
    n = len(EDGE)
    got = {(r["doc_id"], r["template"]): (r["start_word"], r["n_shared"], r["n_shingles"]) for r in license_scan.scan_licenses(_docs(spark, texts), license_scan.NOTICES).collect()}
    assert set(got) == {(n, "GPL-3.0"), (n + 1, "GPL-3.0"), (n + 3, "GPL-3.0"), (n + 5, "MIT")}
    assert all(shared == of for _, shared, of in got.values()) and 90 <= got[n, "GPL-3.0"][0] <= 97
    assert license_scan.scan_licenses(_docs(spark, []), license_scan.NOTICES).count() == 0
    assert license_scan.scan_licenses(_docs(spark, texts), []).count() == 0
    plan = license_scan.scan_licenses(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), license_scan.NOTICES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        license_scan.scan_licenses(_docs(spark, texts), [license_scan.LicenseTemplate("a", "too short")])


def test_licenses_in_segments_and_passes(spark):
    """Long templates, null and repeated ids; small segments and passes of one template find what one pass over whole texts does."""
    r = random.Random(6)
    long_ = [license_scan.LicenseTemplate(f"long{i}", " ".join(f"w{r.randrange(900)}" for _ in range(n))) for i, n in enumerate((300, 300, 700))]
    templates = [*license_scan.NOTICES[2:4], *long_]
    filler = lambda n: " ".join(f"f{r.randrange(10**6)}" for _ in range(n))
    near = long_[2].text.split(" ")
    for i in r.sample(range(700), 10):
        near[i] = "changed"
    texts = [f"{filler(r.randrange(400))} {r.choice(templates).text} {filler(r.randrange(400))} {r.choice(templates).text}" for _ in range(40)] + [" ".join(near), " ".join(long_[1].text.split(" ")[:150]), *EDGE]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, long_[0].text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, license_scan.scan_licenses(docs, templates).collect()))
    assert whole == sorted(map(str, license_scan.scan_licenses(docs, templates, most=1, segment=37).collect()))
    got = {(x["doc_id"], x["template"]) for x in license_scan.scan_licenses(docs, templates).collect()}
    words = lambda t: " " + " ".join(license_scan.template_words(t or "")) + " "
    planted = {(i, x.name) for i, t in rows for x in templates if words(x.text) in words(t)}
    assert planted | {(40, "long2")} <= got and (41, "long1") not in got
    assert len(list(license_scan.passes({t.name: license_scan.template_words(t.text) for t in templates}, 5, 80, 1e-6, 1, 16))) == len(templates)


# 7


def test_token_counts(spark, tmp_path):
    end = 9
    r = random.Random(7)
    files = {f"f{i}": [r.choice([1, 2, 300, 9, 2304]) for _ in range(r.randrange(0, 400))] for i in range(5)}
    files |= {"none": [], "only": [9, 9, 9], "open": [1, 2, 3]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    want = []
    for name, ids in files.items():
        start, index = 0, 0
        for i, x in enumerate([*ids, None]):
            if x == end or (x is None and i > start):
                want.append((name, index, start, i - start, x == end))
                start, index = i + 1, index + 1
    for size in (1, 7, 64):
        blocks = token_counts.read_token_files(spark, str(tmp_path), 2, size)
        got = token_counts.count_tokens(blocks.withColumn("file", F.element_at(F.split("file", "/"), -1)), end)
        assert sorted((r["file"], r["doc_index"], r["start"], r["n_tokens"], r["ended"]) for r in got.collect()) == sorted(want)
    assert token_counts.count_tokens(spark.createDataFrame([], "file string, block long, data binary"), end).count() == 0


def test_byte_bpe_equals_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe.ByteBpe(path)
    r = random.Random(8)
    texts = [t for t in EDGE[1:-1]] + [LONG[:3000], "a<|endoftext|>b", "it's we'll", " lead", "trail ", "a\n", "\n a", "x \n y\n\nz", "tab\t tab"]
    texts += ["".join(r.choice("ab 1,é\n'\u3000") for _ in range(30)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# 8


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=5))]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (350, [1.0, 2.0]), (351, [1.0, 1.0]), (400, None), (450, []), (500, [float("nan")] * 5), (None, rows[0][1]), (550, [0.0] * 5), (401, [None, 1.0, 1.0, 1.0, 1.0])]
    good = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    for size in (8192, 2):
        got = topk_search.top_k(_vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, query_slice=size).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk_search.top_k(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


# 9


def test_language(spark):
    r = random.Random(9)
    speech = {"aa": "the house and water of stone", "bb": "über straße nicht wäre schön", "cc": "ñandú señor corazón está allí"}
    rows = [(i, " ".join(r.choice(speech[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(r.choice(list(speech)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 %% 34", None), (1003, "the stone", None), (1003, "the stone", None), (None, "nicht wäre", None)]
    docs = spark.createDataFrame([(*x, "x", "x") for x in rows], "doc_id long, text string, lang string, score string, rejected string")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    got = language_id.predict(docs, model, ["doc_id", "lang", "score"]).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    """A language of which all rows but a few share one id and text, null ids, and more languages than are learned."""
    rows = [(1, "the house of stone", "aa")] * 500 + [(i, f"the house number {i}", "aa") for i in range(2, 40)] + [(None, f"über straße {i}", "bb") for i in range(300)]
    rows += [(i, "lone words", f"x{i}") for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = language_id.training_rows(docs, F.lit(True), 20, 5, "doc_id", "text", "lang").collect()
    by = {}
    for r in picked:
        by.setdefault(r["lang"], []).append(r["text"])
    assert {k: len(v) for k, v in by.items() if k in ("aa", "bb")} == {"aa": 20, "bb": 20} and len(by) == 5
    assert by["aa"].count("the house of stone") <= 1


def test_words_that_cancel_in_one_state_differ(spark):
    """Words whose second lane makes up for their first one in a chain of mixed lanes, and longer words with such a pair of lanes anywhere."""
    pair = ["aaaaaaaabbbbbbbb", "&h5mnr%s(d_w#yj&"]
    rest = " and more words that nobody shares with anyone else at all"
    texts = [f"{pair[i]}{tail}" for tail in ("", " only") for i in (0, 1)] + [" ".join([pair[i]] * 30) + rest * i for i in (0, 1)]
    got = minhash_dedup.minhash_components(_docs(spark, texts), k=2).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(len(texts)))
    r = np.random.default_rng(5)
    for n in (16, 24, 40, 248):
        for at in range(0, n - 8, 8):
            x = r.integers(0, 1 << 63, n // 8, dtype=np.uint64)
            y = x.copy()
            y[at // 8] ^= np.uint64(0x0102)
            states = []
            for w in (x, y):
                h = mix64(mix64(np.array([n], dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ w[:1])
                for lane in w[1 : at // 8 + 1]:
                    h = mix64(h ^ lane)
                states.append(h[0])
            y[at // 8 + 1] ^= states[0] ^ states[1]
            buf = np.frombuffer(x.tobytes() + y.tobytes(), dtype=np.uint8)
            codes = textcodes.hashes(buf, np.array([0, n]), np.array([n, 2 * n]))
            assert codes[0] != codes[1]


def test_language_learns_every_label(spark):
    """More labels than were once learned, each with words of its own; a sample bounded by bytes."""
    r = random.Random(3)
    own = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(70)]
    rows = [(i, " ".join(r.choices(own[i % 70], k=20)), f"l{i % 70:02d}") for i in range(70 * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 8 != 0, centroids=2)
    assert sorted(set(model.langs)) == sorted({x[2] for x in rows})
    assert all(model.predict(text)[0] == lang for i, text, lang in rows if i % 8 == 0)
    sizes = docs.groupBy("lang").agg(F.min(F.length("text")).alias("n")).collect()
    picked = language_id.training_rows(docs, F.lit(True), 20, None, "doc_id", "text", "lang", sample_bytes=min(x["n"] for x in sizes))
    assert picked.count() == 70


def test_language_equals_nearest_centroid(spark):
    """Predictions against dense vectors and a plain loop over the model's centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    idf = np.full(language_id.DIM, model.unseen)
    idf[model.seen] = model.idf
    centroids = np.zeros((len(model.langs), language_id.DIM))
    centroids[:, model.seen] = model.centroids.T
    for r in docs.where("doc_id % 2 = 1").limit(60).collect():
        n = language_id.counts(r["text"])
        if n is None:
            continue
        x = np.log1p(n) * idf
        cosines = [float(c @ x) / float(np.sqrt(x @ x)) for c in centroids]
        lang, score, _ = model.predict(r["text"])
        assert abs(score - max(cosines)) < 1e-5 and lang == min(model.langs[i] for i, c in enumerate(cosines) if c > max(cosines) - 1e-6)


def test_language_counts_whole_text():
    text = "été 12 the " * 40_000
    whole = language_id.counts(text)
    assert len(text) > language_id.PIECE
    plain = " " + language_id._OTHER.sub(" ", text.lower()) + " "
    assert abs(int(whole.sum()) - sum(len(plain) - n + 1 for n in (1, 2, 3, 4))) < 100


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    r = random.Random(4)
    cyrillic, chinese, latin = "абвгдежзийклмнопрстуфхцчшщъыьэюя ", "".join(map(chr, range(0x4E00, 0x5E00))), "abcdefghijklmnopqrstuvwxyz "
    for letters, sizes in ((cyrillic, (10, 30, 300, 2000, 20000)), (chinese, (10, 30, 300, 2000, 20000)), (latin, (30, 300, 2000, 20000)), (latin.upper() + latin + "0123456789+/", (100, 2000, 20000))):
        assert all(model.predict("".join(r.choices(letters, k=n)))[2] for n in sizes for _ in range(5))
    held = [x for x in docs.where("doc_id % 10 = 1 and lang is not null").select("text", "lang").collect() if language_id.counts(x["text"]) is not None]
    found = [model.predict(x["text"]) for x in held]
    assert sum(f[2] for f in found) <= len(held) / 1000
    for size in (16, 32, 128, 512):
        short = [language_id.grams(p) and model.predict(p)[2] for x in held for p in language_id._parts(x["text"]) if len(p) == size]
        assert np.mean([s for s in short if s is not None] or [0]) <= 0.02


# 10


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*EDGE, *_prose(10, 60, 300), "same", "same"]
    docs = _docs(spark, texts).repartition(2)
    ids = {i: np.concatenate([np.frombuffer(byte_bpe.loaded(path).encode(t), dtype="<u4"), np.array([1], dtype="<u4")]) for i, t in enumerate(texts)}
    for size in (2048, 64):
        rows = packing.pack_documents(docs, path, size=size, group=16).collect()
        at, seen = {}, {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] > 0
            at[r["sequence_id"]] = r["offset"] + r["length"]
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
            own = ids[r["doc_id"]]
            assert r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
            seen[r["doc_id"]] = r["start"] + r["length"]
        assert seen == {i: len(x) for i, x in ids.items()}
        assert max(at.values()) <= size and not [n for n in at.values() if n & (n - 1)]
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, path, size=1000)


def test_cheapest_sequence_comes_first():
    bins, left = packing.pack([90, 60, 50, 10, 40, 50], 100, 1.0, 0.01)
    assert [sum(n for _, _, n in b) for b in bins] == [100, 100, 100] and not left
    assert any((0, 0, 90) in b for b in bins)


def test_token_query_against_the_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioscan.llm import queries, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "<|endoftext|>", "a <|endoftext|> b", "word " * 30_000, "été naïve\n\n", "x", "x", "again"]
    rows = [(None if i == 5 else min(i, 7), t, "extra", b"clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, file string, data binary").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(path)
    want = sorted((-1 if r[0] is None else r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = queries.op7_token_counts(spark, str(tmp_path)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, data binary")
    for block_tokens in (1, 3, 64):
        stream = token_counts.token_stream(docs.where("doc_id is distinct from 4").coalesce(1), path, 50257, block_tokens=block_tokens).collect()
        named = [d for r in sorted(stream, key=lambda r: r["block"]) for d in r["ids"]]
        assert len(named) == len(rows) - 1 and all(len(r["data"]) <= 2 * block_tokens for r in stream)
        ids = np.frombuffer(b"".join(bytes(r["data"]) for r in sorted(stream, key=lambda r: r["block"])), dtype="<u2")
        sizes = np.diff(np.concatenate(([-1], np.flatnonzero(ids == 50257)))) - 1
        assert sorted(zip((-1 if d is None else d for d in named), sizes.tolist(), strict=True)) == [w for w in want if w[0] != 4]


def test_token_files_of_any_size(spark, tmp_path):
    from folioscan.llm import token_counts

    rng = np.random.default_rng(5)
    for i, n in enumerate((0, 1, 10, 997, 1000)):
        (tmp_path / f"f {i}.bin").write_bytes(rng.integers(0, 50, n).astype("<u2").tobytes())
    read = lambda **k: sorted((r["file"], r["block"], bytes(r["data"])) for r in token_counts.read_token_files(spark, str(tmp_path), block_tokens=10, **k).collect())
    assert read() == read(whole=0, blocks_at_once=7) == read(whole=50, blocks_at_once=1)
    assert len(read()) == 0 + 1 + 1 + 100 + 100
