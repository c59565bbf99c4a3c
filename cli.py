"""Command line: ask a store, or `ingest` documents into one."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Ask a page store. With `ingest` as the first word: put documents into one.")
    p.add_argument("text", nargs="?", help="the question")
    p.add_argument("--query", "-q")
    p.add_argument("--top-k", "-k", type=int, default=3)
    p.add_argument("--model", "-m", default="citations", help="the generator: a known name, or module:factory")
    p.add_argument("--encoder", "-e", default="hashing", help="the encoder: a known name, or module:factory")
    p.add_argument("--data-dir", default="./data")
    p.add_argument("--images-dir", help="the folder of page images that the generator gets")
    p.add_argument("--retrieve-only", action="store_true")
    return p


def ingest_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cli.py ingest", description="Renders, encodes and stores the pages of documents.")
    p.add_argument("--docs-dir", required=True)
    p.add_argument("--output-dir", default="./data")
    p.add_argument("--pdfs", nargs="+", help="names of documents, in the order of their pages; all by name if not given")
    p.add_argument("--batch-size", type=int, default=2)
    p.add_argument("--dpi", type=int, default=150)
    p.add_argument("--commit-every", type=int, default=0, help="publish a version after so many documents; 0: once")
    p.add_argument("--no-images", action="store_true", help="write no files of page images")
    p.add_argument("--encoder", "-e", default="hashing", help="the encoder: a known name, or module:factory")
    p.add_argument("--renderer", default="text", help="the renderer: a known name, or module:factory")
    return p


def ingest(args: list[str], spark=None) -> int:
    options = ingest_parser().parse_args(args)
    from folioscan import encoders
    from folioscan.ingest import ingest_documents
    from folioscan.sources.sinks import store_summary

    spark = spark or _session()
    try:
        encoder = encoders.encoder(options.encoder, encoders.EncoderConfig(batch_size=options.batch_size))
        images = None if options.no_images else f"{options.output_dir}/page_images"
        done = ingest_documents(spark, options.docs_dir, options.output_dir, encoders.renderer(options.renderer), encoder, options.pdfs, options.dpi, images, options.commit_every)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    for name in done.missing:
        print(f"not found, passed over: {name}")
    if done.empty:
        print(f"without pages: {done.empty} documents")
    row = store_summary(spark, options.output_dir).first()
    print(f"added: {done.documents} documents, {done.pages} pages, {done.images} image files")
    print(f"store {options.output_dir}: {row['pages']} pages, {row['patches']} patches a page at most, {row['dim']} dimensions, {row['megabytes']:.1f} MB")
    return 0


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("folioscan").getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    args = sys.argv[1:] if args is None else args
    if args[:1] == ["ingest"]:
        return ingest(args[1:], spark)
    options = parser().parse_args(args)
    question = options.text or options.query
    if not question:
        parser().print_help()
        return 1
    from folioscan import RetrievalEngine
    from folioscan.encoders import encoder, generator

    spark = spark or _session()
    try:
        engine = RetrievalEngine(spark, options.data_dir, encoder(options.encoder), generator(options.model), options.images_dir)
        if options.retrieve_only:
            for i, h in enumerate(engine.retrieve_one(question, top_k=options.top_k), 1):
                print(f"{i}. {h['source']} page {h['page']}/{h['total_pages']} similarity {h['similarity']:.4f} {h['image_path']}")
            return 0
        row = engine.answer(spark.createDataFrame([(0, question)], "query_id long, query string"), options.top_k).first()
        print("ANSWER\n" + (row["answer"] or f"({row['status']}: {row['error'] or 'no page image found'})"))
        return 0
    except FileNotFoundError as e:
        print(f"The store lacks {e}. Ingest documents first.", file=sys.stderr)
    except ValueError as e:
        print(e, file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
