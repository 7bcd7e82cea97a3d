"""Command line: python -m glossa --config KB.toml --dir FOLDER put|get|search|info|context|dump|graph|serve|version ..."""

from __future__ import annotations

import argparse
import json
import sys

from .engine import Engine, pretty_concept, pretty_entry, pretty_info
from .operators.resolve import steps

VERSION = "0.2"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossa", description=__doc__)
    p.add_argument("--config", help="knowledge base configuration (TOML)")
    p.add_argument("--dir", default="glossa-data", help="folder of the index and of stored documents")
    p.add_argument("--no-cache", action="store_true", help="neither read nor write the knowledge base's cache")
    p.add_argument("--json", action="store_true", help="print JSON")
    sub = p.add_subparsers(dest="command", required=True)
    put = sub.add_parser("put", help="index files, or all files of folders")
    put.add_argument("paths", nargs="+")
    put.add_argument("-l", "--local", action="store_true", help="leave the files where they are; else a copy of each is stored")
    put.add_argument("-k", "--ks", default="", help="error limits for approximate matching, between commas")
    put.add_argument("-r", "--resolver", action="append", default=[], help="thematic, ruled or simple; may be given again")
    put.add_argument("-m", "--memory-size", type=int, default=10)
    put.add_argument("-t", "--threshold", type=float, default=0.5)
    get = sub.add_parser("get", help="entries that a query finds")
    get.add_argument("query")
    get.add_argument("-n", "--max", type=int, default=0)
    get.add_argument("-s", "--skip", type=int, default=0)
    search = sub.add_parser("search", help="concepts by url, label or a part of them")
    search.add_argument("q")
    search.add_argument("-p", "--predicates", action="store_true", help="concepts with an edge of such a predicate")
    for name in ("info", "dump", "graph"):
        sub.add_parser(name).add_argument("url")
    context = sub.add_parser("context", help="bytes around a place of a document")
    context.add_argument("url")
    for x in ("begin", "end", "n"):
        context.add_argument(x, type=int)
    serve = sub.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    sub.add_parser("version")
    return p


def run(engine: Engine, a: argparse.Namespace) -> tuple[object, list[str]]:
    """The answer, and its lines for reading."""
    if a.command == "put":
        settings = {"errors": sorted(int(k) for k in a.ks.split(",") if k), "resolvers": steps(a.resolver, a.memory_size, a.threshold)}
        found = []
        for path in a.paths:
            if a.local:
                found += engine.put_files(path, **settings)
            else:
                from .sources import documents

                for r in documents.files(engine.spark, path).toLocalIterator():  # one file at a time
                    found += engine.put_text(r.path, r.text, **settings)
        return found, [pretty_entry(e) for e in found]
    if a.command == "get":
        found = engine.get(a.query, a.max, a.skip)
        return found, [pretty_entry(e) for e in found]
    if a.command == "search":
        found = engine.predicates(a.q) if a.predicates else engine.search(a.q)
        return found, [pretty_concept(c) for c in found]
    if a.command == "info":
        found = engine.info(a.url)
        return found, [pretty_info(found)]
    if a.command == "dump":
        found = engine.dump(a.url)
        return found, [found["Content"]]
    if a.command == "graph":
        found = engine.graph(a.url)
        return found, [found]
    found = engine.context(a.url, a.begin, a.end, a.n)
    return found, [f"{found['Before']}[{found['Match']}]{found['After']}"]


def main(words: list[str] | None = None) -> int:
    a = arguments().parse_args(words)
    if a.command == "version":
        print(VERSION)
        return 0
    if not a.config:
        print("--config is missing", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("glossa").getOrCreate()
    engine = Engine(spark, a.config, a.dir, not a.no_cache)
    if a.command == "serve":
        from .server import serve

        serve(engine, a.host, a.port).serve_forever()
        return 0
    answer, lines = run(engine, a)
    print(json.dumps(answer, ensure_ascii=False) if a.json else "\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
