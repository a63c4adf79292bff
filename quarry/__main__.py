"""The command line: python -m quarry init, index, update, query, status, config, serve, ingest."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quarry import config as settings
from quarry.app import FORMATS, WEIGHTS, Index, Options, count
from quarry.operators.search import check_weights
from quarry.server import Server

FILE = Path(".quarry/config.toml")


def _weights(text: str) -> list[float]:
    return check_weights([float(w) for w in text.split(",")], len(WEIGHTS))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quarry")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="make an empty index and its settings")
    sub.add_parser("index", help="take in all files").add_argument("--full", action="store_true")
    sub.add_parser("update", help="take in some files").add_argument("files", nargs="+")
    query = sub.add_parser("query", help="search")
    query.add_argument("text")
    query.add_argument("--max-tokens", type=int, default=4000)
    query.add_argument("--max-results", type=int, default=20)
    query.add_argument("--format", choices=list(FORMATS), default="text")
    query.add_argument("--file-filter", action="append")
    query.add_argument("--weights", type=_weights, help=f"{len(WEIGHTS)} numbers: {', '.join(WEIGHTS)}")
    sub.add_parser("status", help="what the index holds")
    config = sub.add_parser("config", help="show settings or change storage.max_db_size_mb")
    config.add_argument("key", nargs="?", choices=["storage.max_db_size_mb"])
    config.add_argument("value", nargs="?", type=int)
    sub.add_parser("serve", help="answer JSON-RPC on standard input").add_argument("--transport", choices=["stdio"], default="stdio")
    sub.add_parser("ingest", help="append chunks of a JSON file").add_argument("file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root = str(Path.cwd())
    conf = settings.load(FILE) if FILE.exists() else settings.Config()
    if args.command == "config":
        if args.key and args.value is None:
            print(f"{args.key} needs a value", file=sys.stderr)
            return 2
        if args.key:
            conf.storage.max_db_size_mb = args.value
            FILE.write_text(settings.dump(conf), "utf-8")
        print(settings.dump(conf), end="")
        return 0
    place = conf.storage.db_path
    index = Index(spark or SparkSession.builder.getOrCreate(), place if Path(place).is_absolute() or ":/" in place else f"{root}/{place}", conf)
    match args.command:
        case "init":
            FILE.parent.mkdir(exist_ok=True)
            if not FILE.exists():
                FILE.write_text(settings.dump(conf), "utf-8")
            index.create()
            print(f"Made an index in {index.tables.root}")
        case "index" | "update" | "ingest":
            index.create()
            done = index.index(root, args.full) if args.command == "index" else index.update(root, args.files) if args.command == "update" else index.ingest(args.file)
            print(", ".join(f"{k}: {v}" for k, v in done.items()))
        case "query":
            packed, asked = index.search({0: args.text}, Options(args.max_tokens, args.max_results, args.file_filter, args.weights))
            if args.format == "text" and packed.isEmpty():
                print("No results found.")
            else:
                print(FORMATS[args.format](packed, asked).first().output, end="" if args.format != "json" else "\n")
        case "status":
            state, languages = index.status()
            print("\n".join([f"Index: {index.tables.root}", f"  Files:  {count(state, 'total_files')}", f"  Chunks: {count(state, 'total_chunks')}", *[f"    {r.language}: {r.n_files}" for r in languages.collect()]]))
        case "serve":
            for line in Server(index, root).run(sys.stdin):
                print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
