"""A store's versions: what is read after a stop anywhere, deletes, replacements, compaction, older versions, two writers."""

import pytest

from folioscan import RetrievalEngine, ingest
from folioscan.encoders import HashingTextEncoder, text_pages
from folioscan.sources import manifest, readers, sinks

STEPS = ["page_meta", "patches", "page_vectors", "documents", "summaries", "versions"]


def _documents(spark, *rows):
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rows)], "doc_ord long, source string, total_pages long")


def _patches(spark, *rows):
    return spark.createDataFrame([(n, p, k, [float(p), float(k + 1)]) for n, pages in rows for p in range(1, pages + 1) for k in range(2)], "source string, page int, patch int, vec array<float>")


def _store(spark, path, *rows):
    rows = rows or (("a.pdf", 2), ("b.pdf", 1))
    meta = ingest.page_meta(_documents(spark, *rows))
    return ingest.store(_patches(spark, *rows).join(meta, ["source", "page"]).select("page_ord", "patch", "vec"), meta, path)


def _held(spark, path, version=None):
    """{source: pages}; checks that all tables agree."""
    engine = RetrievalEngine(spark, path, version=version)
    meta = engine.metadata.select("page_ord", "source", "page").collect()
    ordinals = sorted(r["page_ord"] for r in meta)
    assert ordinals == sorted(set(ordinals)) == sorted(r[0] for r in engine.vectors.select("page_ord").collect())
    assert set(ordinals) == {r[0] for r in readers.read_store(spark, path, "patches", version).select("page_ord").collect()}
    out = {}
    for r in meta:
        out.setdefault(r["source"], []).append(r["page"])
    return {k: sorted(v) for k, v in sorted(out.items())}


BEFORE = {"a.pdf": [1, 2], "b.pdf": [1]}
WRITES = {
    "store": (lambda s, p: _store(s, p, ("c.pdf", 2)), {"c.pdf": [1, 2]}),
    "append": (lambda s, p: ingest.append(_patches(s, ("c.pdf", 1)), _documents(s, ("c.pdf", 1), ("b.pdf", 9)), p), {**BEFORE, "c.pdf": [1]}),
    "delete": (lambda s, p: ingest.delete(s, p, ["a.pdf", "no.pdf"]), {"b.pdf": [1]}),
    "replace": (lambda s, p: ingest.replace(_patches(s, ("a.pdf", 3)), _documents(s, ("a.pdf", 3)), p), {"a.pdf": [1, 2, 3], "b.pdf": [1]}),
    "compact": (lambda s, p: ingest.compact(s, p), BEFORE),
}


@pytest.mark.parametrize("name", sorted(WRITES))
def test_a_stop_anywhere_leaves_one_version(spark, tmp_path, monkeypatch, name):
    path = str(tmp_path / "s")
    _store(spark, path)
    write, after = WRITES[name]
    real, publish = ingest.write_table, manifest.publish
    steps = ["tombstones", "versions"] if name == "delete" else ["tombstones", *STEPS] if name == "replace" else STEPS
    for stop in steps:
        with monkeypatch.context() as m:

            def failing(df, to, stop=stop):
                real(df, to)
                if f"/{stop}/" in to:
                    raise OSError("stopped")

            def unpublished(*args):
                raise OSError("stopped")

            m.setattr(ingest, "write_table", failing)
            m.setattr(manifest, "publish", unpublished if stop == "versions" else publish)
            with pytest.raises(OSError, match="stopped"):
                write(spark, path)
        assert _held(spark, path) == BEFORE
    write(spark, path)
    assert _held(spark, path) == after and _held(spark, path, 0) == BEFORE
    manifest.vacuum(spark, path)
    assert _held(spark, path) == after
    with pytest.raises(FileNotFoundError, match="version 0"):
        readers.read_store(spark, path, "page_meta", 0)


def test_deleted_documents_come_back_with_new_ordinals(spark, tmp_path):
    path = str(tmp_path / "s")
    _store(spark, path)
    assert ingest.delete(spark, path, ["b.pdf"]) == 1 and ingest.delete(spark, path, ["b.pdf"]) == 0
    assert ingest.append(_patches(spark, ("b.pdf", 2)), _documents(spark, ("b.pdf", 2)), path) == 2
    assert _held(spark, path) == {"a.pdf": [1, 2], "b.pdf": [1, 2]}
    assert sorted(r[0] for r in RetrievalEngine(spark, path).metadata.where("source = 'b.pdf'").select("page_ord").collect()) == [3, 4]
    ingest.delete(spark, path, ["a.pdf"])
    ingest.compact(spark, path)
    assert manifest.read(spark, path).deletes == () and _held(spark, path) == {"b.pdf": [1, 2]}
    assert ingest.append(_patches(spark, ("a.pdf", 1)), _documents(spark, ("a.pdf", 1)), path) == 1
    assert _held(spark, path) == {"a.pdf": [1], "b.pdf": [1, 2]} and manifest.read(spark, path).next == 6
    ingest.delete(spark, path, ["a.pdf", "b.pdf"])
    assert RetrievalEngine(spark, path).page_count == 0


def test_of_two_writers_one_publishes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    _store(spark, path)
    seen = manifest.read(spark, path)
    ingest.append(_patches(spark, ("c.pdf", 1)), _documents(spark, ("c.pdf", 1)), path)
    monkeypatch.setattr(ingest, "_now", lambda *a: seen)
    with pytest.raises(manifest.Conflict):
        ingest.append(_patches(spark, ("d.pdf", 1)), _documents(spark, ("d.pdf", 1)), path)
    monkeypatch.undo()
    assert _held(spark, path) == {**BEFORE, "c.pdf": [1]}
    assert not [p for p in (tmp_path / "s" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_summary_merges_commits_without_reading_patches(spark, tmp_path):
    path = str(tmp_path / "s")
    _store(spark, path)
    ingest.append(_patches(spark, *[(f"d{i}.pdf", 1) for i in range(300)]), _documents(spark, *[(f"d{i}.pdf", 1) for i in range(300)]), path)
    merged = sinks.store_summary(spark, path)
    assert "/patches/" not in merged._jdf.queryExecution().executedPlan().toString() and not any("/patches/" in f for f in merged.inputFiles())
    exact = sinks.summary(readers.read_store(spark, path, "patches")).first()
    row = merged.first()
    assert tuple(row)[:4] == tuple(exact) and abs(row["sources"] - 302) <= 0.1 * 302
    ingest.delete(spark, path, ["a.pdf"])
    assert sinks.store_summary(spark, path).first()["pages"] == 301


DOCS = {"Report.pdf": b"stars over mountains", "empty.pdf": b"", "blank.pdf": b"none", "b.pdf": b"apples\fpears", "c.pdf": b"copper wires"}


def _folder(tmp_path, **more):
    folder = tmp_path / "docs"
    folder.mkdir(exist_ok=True)
    for n, content in {**DOCS, **more}.items():
        (folder / n).write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("every", [0, 1, 2])
def test_documents_without_pages_are_told_and_not_rendered_again(spark, tmp_path, every):
    folder, path, log = _folder(tmp_path), str(tmp_path / "s"), tmp_path / "rendered"

    def renderer(content, dpi):
        with log.open("ab") as f:
            f.write(b"x")
        return [] if content == b"none" else text_pages(content, dpi)

    names = ["empty.pdf", "blank.pdf", "b.pdf", "c.pdf", "Report.pdf"]
    done = ingest.ingest_documents(spark, folder, path, renderer, HashingTextEncoder(), names=names, commit_every=every)
    assert (done.documents, done.pages, done.empty) == (3, 4, 2)
    assert [r["source"] for r in readers.read_store(spark, path, "documents").where("total_pages = 0").orderBy("source").collect()] == ["blank.pdf", "empty.pdf"]
    assert [r["source"] for r in readers.read_store(spark, path, "page_meta").orderBy("page_ord").collect()] == ["b.pdf", "b.pdf", "c.pdf", "Report.pdf"]
    n = len(log.read_bytes())
    assert n == 4 and ingest.ingest_documents(spark, folder, path, renderer, HashingTextEncoder()).pages == 0 and len(log.read_bytes()) == n
    ingest.delete(spark, path, ["empty.pdf", "b.pdf"])
    assert ingest.ingest_documents(spark, folder, path, renderer, HashingTextEncoder()).documents == 1
    assert readers.read_store(spark, path, "images").count() == 4


def test_stopped_ingest_goes_on_after_the_last_commit(spark, tmp_path, monkeypatch):
    folder, path, seen = _folder(tmp_path), str(tmp_path / "s"), tmp_path / "seen"
    down = tmp_path / "down"
    down.write_bytes(b"")

    def renderer(content, dpi):
        if down.exists() and content.startswith(b"copper"):
            raise OSError("stopped")
        with seen.open("ab") as f:
            f.write(content[:1])
        return text_pages(content, dpi)

    with pytest.raises(Exception, match="stopped"):
        ingest.ingest_documents(spark, folder, path, renderer, HashingTextEncoder(), commit_every=1)
    assert set(_held(spark, path)) == {"Report.pdf", "b.pdf", "blank.pdf"}
    down.unlink()
    before = seen.read_bytes()
    assert ingest.ingest_documents(spark, folder, path, renderer, HashingTextEncoder(), commit_every=1).pages == 1
    assert seen.read_bytes() == before + b"c" and set(_held(spark, path)) == {"Report.pdf", "b.pdf", "blank.pdf", "c.pdf"}


def test_image_names_are_unlike_those_of_the_store(spark, tmp_path):
    folder, path = _folder(tmp_path), str(tmp_path / "s")
    ingest.ingest_documents(spark, folder, path, text_pages, HashingTextEncoder(), names=["Report.pdf"])
    _folder(tmp_path, **{"report.pdf": b"other"})
    with pytest.raises(ValueError, match="Report.pdf and report.pdf have the same image names"):
        ingest.ingest_documents(spark, folder, path, text_pages, HashingTextEncoder(), names=["report.pdf"])
    assert _held(spark, path) == {"Report.pdf": [1]}
    assert ingest.delete(spark, path, ["Report.pdf"]) == 1
    assert ingest.ingest_documents(spark, folder, path, text_pages, HashingTextEncoder(), names=["report.pdf"]).pages == 1


def test_pages_of_a_long_document_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(readers, "PAGES_BYTES", 1000)
    held = []

    def renderer(content, dpi):
        for i in range(500):
            held.append(i)
            yield b"%04d" % i

    documents = spark.createDataFrame([("a.pdf", b"x")], "name string, content binary")
    rows = readers.render(documents, renderer).orderBy("page").collect()
    assert [(r["page"], bytes(r["image"])) for r in rows] == [(i + 1, b"%04d" % i) for i in range(500)]
    assert readers.render(documents, lambda c, d: iter(())).count() == 0
