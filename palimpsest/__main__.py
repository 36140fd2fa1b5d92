"""python -m palimpsest: index a tree, ask it, look at it, keep its memory."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Config, Engine
from .operators import context, memory


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--data", default=".palimpsest", help="folder of the engine's tables, on any file system")
    p.add_argument("--config", default="palimpsest.toml")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("init", help="write a configuration with the defaults")
    sub.add_parser("index", help="index a source tree").add_argument("root")
    ask = sub.add_parser("query", aliases=["ask"], help="bundles for a query, or for each line of standard input")
    ask.add_argument("text", nargs="?")
    ask.add_argument("--format", choices=("text", "json"), default="text")
    ask.add_argument("--depth", default="full", help="summary, signatures, anchors or full")
    look = sub.add_parser("inspect", help="counts, or a node with its neighbours")
    look.add_argument("node", nargs="?")
    sub.add_parser("summary", help="languages, conventions and entry points")
    mem = sub.add_parser("memory", help="status, gc or wipe")
    mem.add_argument("action", choices=("status", "gc", "wipe"))
    mem.add_argument("--dry-run", action="store_true")
    return p


def show(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "init":
        keys = {k: v for k, v in Config().__dict__.items() if v is not None}
        with open(args.config, "x") as f:
            f.writelines(f"{k} = {json.dumps(v)}\n" for k, v in keys.items())
        return 0
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    e = Engine(spark, Config.load(args.config), args.data if "://" in args.data else f"file://{__import__('os').path.abspath(args.data)}")
    if args.verb == "index":
        show(e.index(args.root))
    elif args.verb in ("query", "ask"):
        lines = [args.text] if args.text else [x.strip() for x in sys.stdin if x.strip()]
        bundle = e.query(spark.createDataFrame(list(enumerate(lines, 1)), "query_id int, text string"))
        bundle = context.compressed_bundle(bundle, context.depth_of(args.depth))[0]
        show(context.as_json(bundle) if args.format == "json" else context.as_text(bundle))
    elif args.verb == "inspect" and args.node:
        asked = spark.createDataFrame([(1, args.node)], "query_id int, key string")
        found = e.find_nodes(asked)
        if found.isEmpty():
            print(f"no node {args.node}; like it:", file=sys.stderr)
            show(e.suggestions(asked).join(e.nodes.select("node_id", "name"), "node_id").select("name", "node_id"))
            return 1
        show(e.topology(found.select("node_id")))
    elif args.verb == "inspect":
        show(e.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files")).orderBy(F.desc("n")))
    elif args.verb == "summary":
        show(e.repo_summary())
    elif args.action == "status":
        show(e.memory_status())
    elif args.action == "gc":
        show(memory.garbage_counts(e.collect_garbage(int(time.time()), args.dry_run)))
    else:
        e.delete(e.events.select("id"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
