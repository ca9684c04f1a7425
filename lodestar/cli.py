"""Command line: import, list, delete, download, package, analyze, calculate-pagerank, embed, reindex, search, serve.

python -m lodestar.cli --data DIR COMMAND ...; exit code 0 on success, 1 on failure. Models are stand-ins unless a module
with make_embedder, make_reranker and make_summariser is given with --models."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import models, storage, tools
from .operators import graph
from .operators.lexical import LexicalIndex
from .plans import corpus
from .plans.search import HybridSearch
from .sources import catalog, files


def _models(name: str | None):
    if not name:
        return models.hashing_embedder, models.overlap_reranker, models.first_line_summariser
    m = importlib.import_module(name)
    return m.make_embedder, m.make_reranker, m.make_summariser


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    p.add_argument("--data", default="data", help="data directory")
    p.add_argument("--models", help="module with model factories")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("import", help="take the source files out of a release archive")
    x.add_argument("archive")
    x.add_argument("--version")
    x = sub.add_parser("list", help="versions and their state")
    x.add_argument("--json", action="store_true")
    x = sub.add_parser("delete", help="remove a version")
    x.add_argument("version")
    x.add_argument("--force", action="store_true")
    x = sub.add_parser("download", help="fetch a version's indexes; --releases is a JSON list of releases with assets")
    x.add_argument("version")
    x.add_argument("--releases", required=True)
    x = sub.add_parser("package", help="pack what may be published of a version")
    x.add_argument("version")
    for name, text in (("analyze", "extract file records and calls"), ("calculate-pagerank", "rank the files"), ("embed", "build all indexes"), ("reindex", "rebuild the lexical index"), ("search", "answer a query"), ("serve", "answer queries from standard input")):
        x = sub.add_parser(name, help=text)
        x.add_argument("--version", required=True)
        if name == "analyze":
            x.add_argument("--max-files", type=int)
        if name == "calculate-pagerank":
            x.add_argument("--damping-factor", type=float, default=0.85)
            x.add_argument("--max-iterations", type=int, default=100)
            x.add_argument("--convergence-threshold", type=float, default=1e-6)
        if name in ("search", "serve"):
            x.add_argument("--mode", default="hybrid", choices=("hybrid", "semantic", "lexical"))
            x.add_argument("--max-results", type=int, default=10)
        if name == "search":
            x.add_argument("query")
    return p


def _ranked(spark: SparkSession, paths: catalog.Paths, **kw):
    info, edges = corpus.analyse(spark, paths.source)
    return corpus.rank(info, edges, **kw)


def engine(spark: SparkSession, paths: catalog.Paths, names: str | None) -> HybridSearch:
    index = LexicalIndex.read(spark, paths.lexical)
    if index is None:
        raise ValueError("no lexical index; run embed or reindex first")
    docs = spark.read.parquet(paths.contents)
    ranks = docs.select(F.col("path").alias("relative_path"), F.lit(None).cast("string").alias("file_path"), "pagerank_score")
    embedder, reranker, _ = _models(names)
    status = next(s for s in catalog.versions(paths.base.split("/versions/")[0]) if s.extract_path == paths.base)
    vectors = spark.read.parquet(paths.vectors) if status.has_vectors else None
    lower = lambda c: F.transform(corpus.text.basic_tokens(c), F.lower)
    return HybridSearch(docs, index, vectors, ranks, embedder, reranker, tokens=lower)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = lambda: spark or SparkSession.builder.appName("lodestar").getOrCreate()
    try:
        if args.command == "import":
            version = args.version or files.archive_version(args.archive)
            paths = catalog.Paths.of(args.data, version)
            n = files.extract_archive(session(), args.archive, paths.source)
            print(f"{version}: {n} files")
        elif args.command == "list":
            found = catalog.versions(args.data)
            print(json.dumps([asdict(s) for s in found], indent=2) if args.json else "\n".join(f"{s.version}\t{'ready' if s.is_ready else 'not ready'}\t{s.file_count} files\t{s.created}" for s in found))
        elif args.command == "delete":
            sure = args.force or input(f"delete {args.version}? [y/N] ").lower() == "y"
            return 0 if catalog.delete_version(args.data, args.version, sure) else 1
        elif args.command == "download":
            with open(args.releases, encoding="utf-8") as f:
                found = catalog.download(json.load(f), args.version, args.data)
            print(f"{found.version}: {'ready' if found.is_ready else 'not ready'}")
        elif args.command == "package":
            print(json.dumps(catalog.package(args.data, args.version)))
        else:
            s, paths = session(), catalog.Paths.of(args.data, args.version)
            embedder, _, summariser = _models(args.models)
            if args.command == "analyze":
                info, _ = corpus.analyse(s, paths.source, paths, args.max_files)
                print(f"{info.count()} files")
                for r in graph.top_by_calls(info).collect():
                    print(f"{r['file_name']}\t{r['calls']} calls")
            elif args.command == "calculate-pagerank":
                ranked = _ranked(s, paths, damping=args.damping_factor, iterations=args.max_iterations, tolerance=args.convergence_threshold)
                files.write_ranked(ranked.drop("content_hash"), paths.ranked)
                if os.path.isdir(paths.contents):  # what searches show follows the new ranks
                    files.write_contents(files.source_tree(s, paths.source), ranked, paths.contents)
                for r in ranked.orderBy("pagerank_rank").limit(10).collect():
                    print(f"{r['pagerank_rank']:3d}. {r['file_name']} {r['pagerank_score']:.6f}")
            elif args.command == "embed":
                print(corpus.build(s, paths.source, paths, embedder, summariser).first().asDict())
            elif args.command == "reindex":
                tree, ranked = files.source_tree(s, paths.source), _ranked(s, paths)
                corpus.lexical_index(tree, ranked).write(paths.lexical)
                files.write_contents(tree, ranked, paths.contents)
            else:
                lazy = tools.LazyEngine(lambda: engine(s, paths, args.models), 10.0 if args.command == "serve" else None)
                for q in [args.query] if args.command == "search" else map(str.strip, sys.stdin):
                    print(tools.search_codebase(lazy.get(), q, search_mode=args.mode, max_results=args.max_results), flush=True)
                lazy.close()
            if spark is None:  # the session is this command's own, and so are its scratch tables
                storage.release(s)
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
