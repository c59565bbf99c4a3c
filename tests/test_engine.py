"""The engine's edge cases: names, vectors, top-k bounds, alignment, ingest, answers."""

import pytest
from pyspark.sql import functions as F

from folioscan import RetrievalEngine, encoders, ingest
from folioscan.encoders import HashingTextEncoder, generator, generators, text_pages
from folioscan.functions import names
from folioscan.functions.vectors import dot, mean_pool, unit
from folioscan.operators import ordinals, search
from folioscan.sources import manifest, readers, sinks


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_ord long, unit_vec array<double>")


def _ask(spark, rows):
    return spark.createDataFrame(rows, "query_id long, unit_vec array<double>")


def test_image_names(spark):
    rows = spark.createDataFrame([("Big Plan.pdf", 7), ("a.pdf.pdf", 12345), ("X.PDF", 1)], "s string, p int")
    got = [r[0] for r in rows.select(names.image_name(F.col("s"), F.col("p"))).collect()]
    assert got == ["big_plan__page_0007.png", "a__page_12345.png", "x.pdf__page_0001.png"]


def test_zero_vector_stays_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<double>, v array<double>").select(unit(F.col("z")), unit(F.col("v"))).first()
    assert row[0] == [0.0, 0.0] and row[1] == [0.6, 0.8]


def test_dot_rejects_other_lengths(spark):
    with pytest.raises(Exception, match="different length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(dot(F.col("a"), F.col("b"))).collect()


def test_ragged_pages_pool(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 0.0]), (2, [3.0, 2.0])], "page_ord long, vec array<float>")
    assert {r["page_ord"]: r["vec"] for r in mean_pool(rows, "page_ord").collect()} == {1: [1.0, 2.0], 2: [2.0, 1.0]}


@pytest.mark.parametrize("n_queries", [1, 9])
def test_ties_and_bounds(spark, n_queries):
    pages = _pages(spark, [(i, [1.0, 0.0]) for i in (5, 3, 4)])
    asked = _ask(spark, [(q, [1.0, 0.0]) for q in range(n_queries)])
    got = [r["page_ord"] for r in search.top_k(pages, asked, 2).where("query_id = 0").orderBy("rank").collect()]
    assert got == [3, 4]
    assert search.top_k(pages, asked, 10).count() == 3 * n_queries
    for k in (0, -1):
        with pytest.raises(ValueError):
            search.top_k(pages, asked, k)


def test_kernels_agree_whatever_the_partitions(spark):
    d = "/root/testdata/sf0.001/embeddings.parquet"
    pages = spark.read.parquet(d).select(F.col("vec_id").alias("page_ord"), unit(F.col("embedding")).alias("unit_vec"))
    asked = pages.where("page_ord < 12").select(F.col("page_ord").alias("query_id"), "unit_vec")
    many = search.top_k(pages.repartition(5), asked, 4).orderBy("query_id", "rank").collect()
    few = search.top_k(pages, asked.where("query_id < 3"), 4).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in many if r["query_id"] < 3] == [tuple(r)[:3] for r in few]
    assert all(abs(r["similarity"] - 1) < 1e-6 for r in many if r["rank"] == 1)
    assert all(-1.000001 <= r["similarity"] <= 1.000001 for r in many)


def test_ordinals_across_runs(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(100)], "k string, i long")
    got = ordinals.numbered(rows, "k", "i", "n", width=7).orderBy("i").collect()
    seen = {"a": 0, "b": 0}
    for r in got:
        seen[r["k"]] += 1
        assert r["n"] == seen[r["k"]]
    total = ordinals.running_sum(rows, "i", "i", "s", width=7).orderBy("i").collect()
    assert [r["s"] for r in total] == [sum(range(i + 1)) for i in range(100)]


def _store(spark, path):
    docs = spark.createDataFrame([(0, "A 1.pdf", 2), (1, "b.pdf", 1)], "doc_ord long, source string, total_pages long")
    meta = ingest.page_meta(docs)
    patches = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (1, 1, [0.0, 3.0]), (2, 0, [1.0, 1.0])], "page_ord long, patch int, vec array<float>")
    ingest.store(patches, meta, path)
    return RetrievalEngine(spark, path, HashingTextEncoder())


def test_store_retrieve_answer_append(spark, tmp_path):
    path = str(tmp_path / "s")
    engine = _store(spark, path)
    assert engine.page_count == 3 and engine.embedding_dim == 2
    hits = engine.retrieve_one(query_embedding=[1, 0], top_k=2)
    assert [(h["source"], h["page"]) for h in hits] == [("A 1.pdf", 1), ("b.pdf", 1)]
    assert hits[0]["image_path"] == "page_images/a_1__page_0001.png" and abs(hits[0]["similarity"] - 1) < 1e-9
    assert engine.retrieve_one(query_embedding=[0, 0])[0]["similarity"] == 0.0
    with pytest.raises(ValueError):
        engine.retrieve_one()
    with pytest.raises(RuntimeError):
        RetrievalEngine(spark, path).retrieve_one("text")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    row = engine.answer(asked, 2).first()
    assert row["status"] == "ok" and "A 1.pdf page 1" in row["answer"] and row["n_images"] == 2
    none = spark.createDataFrame([], "image_path string")
    assert engine.answer(asked, 2, none).first()["status"] == "no_images"
    new = spark.createDataFrame([(0, "c.pdf", 1), (1, "b.pdf", 1)], "doc_ord long, source string, total_pages long")
    patches = spark.createDataFrame([("c.pdf", 1, 0, [2.0, 0.0])], "source string, page int, patch int, vec array<float>")
    assert ingest.append(patches, new, path) == 1
    again = RetrievalEngine(spark, path)
    assert again.page_count == 4 and again.metadata.where("source = 'c.pdf'").first()["page_ord"] == 3


def test_failing_generator_is_a_row(spark, tmp_path):
    engine = _store(spark, str(tmp_path / "s"))

    class Failing:
        def generate(self, prompt, pages):
            raise OSError("down")

    engine.generator = Failing()
    row = engine.answer(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")).first()
    assert row["status"] == "error" and row["error"] == "down"
    assert generators() == ["citations"] and generator("citations").healthcheck()


def test_misaligned_and_unsound_input(spark, tmp_path):
    meta = ingest.page_meta(spark.createDataFrame([(0, "a.pdf", 3)], "doc_ord long, source string, total_pages long"))
    patches = spark.createDataFrame([(i, 0, [1.0]) for i in range(2)], "page_ord long, patch int, vec array<float>")
    with pytest.raises(ValueError, match="no vector"):
        ingest.store(patches, meta, str(tmp_path / "s"))
    bad = spark.createDataFrame([(0, 0, [float("nan")])], "page_ord long, patch int, vec array<float>")
    with pytest.raises(Exception, match="NaN"):
        ingest.page_vectors(bad).collect()
    with pytest.raises(FileNotFoundError):
        RetrievalEngine(spark, str(tmp_path / "none"))


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"source": "b.pdf", "page": 1, "total_pages": 2}, {"source": "a.pdf", "page": 2, "total_pages": 2}]')
    assert [(r["page_ord"], r["source"]) for r in readers.read_metadata(spark, str(tmp_path / "m.json")).orderBy("page_ord").collect()] == [(0, "b.pdf"), (1, "a.pdf")]
    for n in ("b.pdf", "a.pdf", "c.PDF", "x.png"):
        (tmp_path / n).write_bytes(b"pp")
    folder = str(tmp_path)
    assert [r["name"] for r in readers.list_documents(spark, folder).collect()] == ["a.pdf", "b.pdf"]
    assert readers.count_images(spark, folder) == 1 and readers.page_images(spark, folder).count() == 1
    there, missing = readers.requested(spark, ["b.pdf", "zz.pdf", "a.pdf"], readers.list_documents(spark, folder))
    assert [r["name"] for r in there.collect()] == ["b.pdf", "a.pdf"] and [r["name"] for r in missing.collect()] == ["zz.pdf"]
    with pytest.raises(ValueError):
        readers.requested(spark, ["a.pdf", "a.pdf"], there)
    rows = {r["name"]: r for r in readers.inventory(spark, folder, ["a.pdf", "zz.pdf"], len).collect()}
    assert rows["a.pdf"]["pages"] == 2 and not rows["zz.pdf"]["found"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "a.pdf").load(folder).select(F.lit("a.pdf").alias("name"), "content")
    pages = readers.render(files, lambda content, dpi: [content, content[:1]]).orderBy("page").collect()
    assert [(r["page"], bytes(r["image"])) for r in pages] == [(1, b"pp"), (2, b"p")]


def test_streaming_ingest(spark, tmp_path):
    from folioscan.streaming.ingest import watch_patches

    patches = spark.createDataFrame([(0, 0, [3.0, 4.0]), (1, 0, [1.0, 0.0])], "page_ord long, patch int, vec array<float>")
    patches.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch_patches(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = {r["page_ord"]: r["unit_vec"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(rows) == 2 and abs(rows[0][0] - 0.6) < 1e-6


def test_cli(spark, tmp_path, capsys):
    import cli

    assert cli.main([], spark) == 1
    assert cli.main(["hello", "--data-dir", str(tmp_path / "none")], spark) == 1


@pytest.mark.parametrize(("size", "n"), [(64, 30), (16 << 20, 4101)])
def test_max_sim_takes_any_number_of_tokens(spark, monkeypatch, size, n):
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    patches = spark.createDataFrame([(p, [float(p), float(-i)]) for p in range(3) for i in range(4)], "page_ord long, vec array<float>").repartition(3)
    tokens = spark.createDataFrame([(q // 10, q % 10, [1.0, float(q % 3 - 1)]) for q in range(n)], "query_id long, token int, vec array<float>")
    want = {}
    for q in range(n):
        for p in range(3):
            want[q // 10, p] = want.get((q // 10, p), 0.0) + max(p - i * (q % 3 - 1) for i in range(4))
    rows = search.max_sim(patches, tokens).collect()
    assert {(r["query_id"], r["page_ord"]): r["score"] for r in rows} == want and len(rows) == len(want)
    assert search.max_sim(patches, tokens.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "n"), [(64, 30), (16 << 20, 4101)])
def test_scores_take_any_number_of_queries(spark, monkeypatch, size, n):
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    pages = _pages(spark, [(p, [float(p), 1.0]) for p in range(3)]).repartition(2)
    asked = _ask(spark, [(q, [1.0, float(q)]) for q in range(n)])
    got = {(r[0], r[1]): r[2] for r in search.scores(pages, asked).collect()}
    assert got == {(q, p): float(p + q) for q in range(n) for p in range(3)}
    assert search.scores(pages, asked.limit(0)).count() == 0


DOCS = {"A 1.pdf": b"apples and pears\n\nfruit in autumn\frivers and lakes", "b.pdf": b"stars over mountains", "c.pdf": b"copper wires"}


def _folder(tmp_path, names=tuple(DOCS)):
    folder = tmp_path / "docs"
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_bytes(DOCS[n])
    return str(folder)


def test_documents_to_answers(spark, tmp_path):
    class Attached:
        def generate(self, prompt, pages):
            return "|".join(bytes(p["image"]).decode() for p in pages)

    folder, path, images = _folder(tmp_path, ["A 1.pdf", "b.pdf"]), str(tmp_path / "s"), str(tmp_path / "s" / "page_images")
    encoder = HashingTextEncoder()
    done = ingest.ingest_documents(spark, folder, path, text_pages, encoder, image_folder=images)
    assert (done.documents, done.pages, done.images, done.missing) == (2, 3, 3, [])
    assert sorted(p.name for p in (tmp_path / "s" / "page_images").glob("*.png")) == ["a_1__page_0001.png", "a_1__page_0002.png", "b__page_0001.png"]
    engine = RetrievalEngine(spark, path, encoder, Attached(), images)
    assert [tuple(r) for r in engine.metadata.orderBy("page_ord").select("page_ord", "source", "page", "total_pages").collect()] == [(0, "A 1.pdf", 1, 2), (1, "A 1.pdf", 2, 2), (2, "b.pdf", 1, 1)]
    asked = spark.createDataFrame([(7, "rivers and lakes")], "query_id long, query string")
    row = engine.answer(asked, 1).first()
    assert row["status"] == "ok" and row["answer"] == "rivers and lakes" and row["n_images"] == 1
    assert RetrievalEngine(spark, path, encoder, Attached()).answer(asked, 1, readers.page_images(spark, images)).first()["answer"] == "rivers and lakes"
    (tmp_path / "s" / "page_images" / "a_1__page_0002.png").unlink()
    row = engine.answer(asked, 2).first()
    assert row["n_images"] == 1 and "rivers" not in row["answer"]
    assert engine.answer(asked, 1).first()["status"] == "no_images"
    _folder(tmp_path)
    done = ingest.ingest_documents(spark, folder, path, text_pages, encoder, names=["c.pdf", "none.pdf", "b.pdf"])
    assert (done.documents, done.pages, done.images, done.missing) == (1, 1, 0, ["none.pdf"])
    assert RetrievalEngine(spark, path, encoder).retrieve_one("copper wires")[0]["source"] == "c.pdf"
    assert ingest.ingest_documents(spark, folder, path, text_pages, encoder).pages == 0


def test_nothing_to_ingest(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    with pytest.raises(ValueError, match="no documents"):
        ingest.ingest_documents(spark, str(tmp_path / "docs"), str(tmp_path / "s"), text_pages, HashingTextEncoder())
    folder = _folder(tmp_path)
    with pytest.raises(ValueError, match="none of"):
        ingest.ingest_documents(spark, folder, str(tmp_path / "s"), text_pages, HashingTextEncoder(), names=["x.pdf"])
    with pytest.raises(ValueError, match="no pages"):
        ingest.ingest_documents(spark, folder, str(tmp_path / "s"), lambda content, dpi: [], HashingTextEncoder())
    with pytest.raises(FileNotFoundError):
        RetrievalEngine(spark, str(tmp_path / "s"))
    (tmp_path / "docs" / "a_1.pdf").write_bytes(b"x")
    with pytest.raises(ValueError, match="same image names"):
        ingest.ingest_documents(spark, folder, str(tmp_path / "s"), text_pages, HashingTextEncoder())


def test_store_anew_and_export(spark, tmp_path):
    path = str(tmp_path / "s")
    _store(spark, path)
    assert _store(spark, path).page_count == 3 and manifest.versions(spark, path) == [0, 1]
    sinks.export_metadata(readers.read_store(spark, path, "page_meta"), str(tmp_path / "meta"))
    back = readers.read_metadata(spark, str(tmp_path / "meta")).orderBy("page_ord").collect()
    assert [tuple(r) for r in back] == [(0, "A 1.pdf", 1, 2), (1, "A 1.pdf", 2, 2), (2, "b.pdf", 1, 1)]
    with pytest.raises(ValueError, match="no pages"):
        ingest.store(spark.createDataFrame([], "page_ord long, patch int, vec array<float>"), readers.read_store(spark, path, "page_meta").limit(0), path)
    assert RetrievalEngine(spark, path).page_count == 3


def test_plug_ins_and_keys(monkeypatch):
    with pytest.raises(ValueError, match="no encoder"):
        encoders.encoder("none")
    assert isinstance(encoders.encoder("folioscan.encoders:HashingTextEncoder"), HashingTextEncoder)
    assert encoders.renderer("text")(b"a\fb", 150) == [b"a", b"b"]
    hosted = encoders.HostedGenerator(lambda prompt, pages, key: f"{prompt} {len(pages)} {key}", "A_KEY_OF_A_TEST")
    with pytest.raises(RuntimeError, match="A_KEY_OF_A_TEST"):
        hosted.generate("p", [])
    monkeypatch.setenv("A_KEY_OF_A_TEST", "k")
    assert hosted.generate("p", []) == "p 0 k"


def test_cli_from_documents_to_an_answer(spark, tmp_path, capsys):
    import cli

    store = str(tmp_path / "s")
    assert cli.main(["ingest", "--docs-dir", _folder(tmp_path), "--output-dir", store, "--pdfs", "b.pdf", "zz.pdf", "A 1.pdf"], spark) == 0
    out = capsys.readouterr().out
    assert "zz.pdf" in out and "2 documents, 3 pages, 3 image files" in out
    assert cli.main(["stars over mountains", "--data-dir", store, "--images-dir", f"{store}/page_images", "-k", "1"], spark) == 0
    assert "b.pdf page 1" in capsys.readouterr().out
    assert cli.main(["-q", "stars", "--data-dir", store, "--retrieve-only"], spark) == 0
    assert capsys.readouterr().out.startswith("1. b.pdf page 1/1")
    assert cli.main(["stars", "--data-dir", store, "--encoder", "none"], spark) == 1
    (tmp_path / "empty").mkdir()
    assert cli.main(["ingest", "--docs-dir", str(tmp_path / "empty"), "--output-dir", store], spark) == 1


def test_numbers_are_shown_as_printf_shows_them(spark):
    """0.48595 lies below its decimal as a double and 0.00005 above; 0.03125 is a tie, which goes to the even digit."""
    values = [0.48595, 0.47445, 0.00005, 0.03125, 0.09375, 0.99995, -0.48655, -0.0, -0.00001, 12345.67885, 1.0]
    found = spark.createDataFrame([(x,) for x in values], "x double").select("x", names.shown(F.col("x"), 4)).collect()
    assert [r[1] for r in found] == ["%.4f" % r[0] for r in found]
