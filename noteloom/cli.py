"""Command line: init, build, search, serve."""
from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime, timezone

from noteloom import api, config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="noteloom")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="write a configuration file")
    init.add_argument("-f", "--force", action="store_true")
    build = sub.add_parser("build", help="build the index from notes")
    build.add_argument("-i", "--input", action="append", default=[])
    build.add_argument("-o", "--output", default=None)
    build.add_argument("--with-embeddings", action="store_true", help="embed documents by the configured service")
    build.add_argument("--skip-embeddings", action="store_true", help="keywords only, whatever else is asked for")
    build.add_argument("--incremental", action="store_true")
    build.add_argument("--force", action="store_true")
    search = sub.add_parser("search", help="search the index")
    search.add_argument("query")
    search.add_argument("-i", "--index-dir")
    search.add_argument("-t", "--top-k", type=int)
    search.add_argument("-m", "--mode", choices=config.MODES)
    search.add_argument("--tag")
    search.add_argument("-e", "--extraction")
    serve = sub.add_parser("serve", help="serve the tools by the Model Context Protocol on standard input and output")
    serve.add_argument("-i", "--index-dir")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("noteloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def init(force: bool) -> str:
    path = config.default_config_path()
    if path.exists() and not force:
        raise FileExistsError(f"{path} exists; use --force to replace it")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(config.AppConfig().to_toml())
    return str(path)


def build(spark, inputs: list[str], root: str, incremental: bool = False, force: bool = False, embedder=None, model: str | None = None, analyser=None):
    """A build from note files, folders of them, or JSON lines on standard input."""
    from noteloom.functions.tokens import cjk_tokens
    from noteloom.plans import build as plan
    from noteloom.sources import changelog, files, jsonl

    now = datetime.now(timezone.utc).isoformat()
    if inputs == ["-"]:
        docs = jsonl.load_string(spark, sys.stdin.read())
    else:
        paths = [p for x in inputs for p in files.markdown_files(str(config.resolve(x)))]
        docs = changelog.numbered(changelog.parse(files.read_files(spark, paths)))
    return plan.incremental_build(spark, docs, root, now, embedder, model, force=force or not incremental, analyser=analyser or cjk_tokens)


def main(argv: list[str] | None = None, analyser=None) -> int:
    """Runs a command. A program with a morphological analyser passes it in."""
    args = parser().parse_args(argv)
    if args.command == "init":
        print(init(args.force))
        return 0
    if args.verbose:
        logging.basicConfig(level=logging.INFO)
    from noteloom.functions.tokens import cjk_tokens
    from noteloom.plans.searcher import Searcher

    settings = config.effective().validate()
    spark = _session()
    service = api.embedding_service(settings)
    if args.command == "build":
        if args.with_embeddings and not args.skip_embeddings and service is None:
            print("embeddings need an API key and a service address", file=sys.stderr)
            return 1
        wanted = service if args.with_embeddings and not args.skip_embeddings else None
        built = build(spark, args.input, str(config.resolve(args.output or settings.index_dir)), args.incremental, args.force, wanted and wanted.embed, wanted and wanted.model, analyser)
        print(f"{built.mode}: {built.folder}" + (f" {built.counts}" if built.counts else ""))
        return 0
    searcher = Searcher.open(spark, str(config.resolve(args.index_dir or settings.index_dir)), service and service.embed_query, analyser or cjk_tokens)
    if args.command == "search":
        print(api.render_memos(searcher, args.query, config=settings, top_k=args.top_k or settings.default_top_k, mode=args.mode, tag_filter=args.tag, extraction_mode=args.extraction))
        return 0
    from noteloom.server import Server

    for line in Server(searcher, settings).serve(sys.stdin):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
