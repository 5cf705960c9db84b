"""The command line: python -m weftgraph COMMAND [PATHS].

query TEXT    run a Cypher query over the code of the paths; --schema shows the catalog instead
lint          diagnostics and custom rules, with a summary; exit code 1 if there is an error
index         --stats, --dot, --check-integrity, --report-orphans[=PATH], --show-builtins,
              --stop-after listing|indexing|resolution
A query is parsed before anything is read. Progress goes to stderr.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import CypherSyntaxError
from .plans.query import Query


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("weftgraph")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("text", nargs="?")
    query.add_argument("--schema", action="store_true")
    query.add_argument("--format", default="table", choices=["table", "json"])
    lint = commands.add_parser("lint")
    lint.add_argument("--rules", action="append", default=[], help="glob of Python files with custom rules")
    index = commands.add_parser("index")
    for flag in ("--stats", "--dot", "--check-integrity", "--show-builtins"):
        index.add_argument(flag, action="store_true")
    index.add_argument("--report-orphans", nargs="?", const="-", default=None)
    index.add_argument("--stop-after", choices=["listing", "indexing", "resolution"])
    for c in (query, lint, index):
        c.add_argument("--path", action="append", default=[], help="file or folder; the workspace's children if there is none")
        c.add_argument("--config", default="weftgraph.toml")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "query" and not args.schema:
        if not args.text:
            print("give a query, or --schema", file=sys.stderr)
            return 2
        try:
            Query.parse(args.text)
        except CypherSyntaxError as e:
            print(e, file=sys.stderr)
            return 2
    from .api import Graph
    from .operators.lint import Config, load_rules, summary, unknown_rules
    from .operators.lint import RULES
    from .sources.files import list_files, workspace_paths
    from .sources.facts import facts

    config = Config.load(args.config)
    root = os.getcwd()
    paths = args.path or workspace_paths(root)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    began = time.monotonic()

    def say(what: str) -> None:
        print(f"{what}: {time.monotonic() - began:.1f} s", file=sys.stderr)

    files, errors = list_files(spark, paths, list(config.exclude))
    for e in errors:
        print(f"{e['path']}: {e['message']}", file=sys.stderr)
    stop = getattr(args, "stop_after", None)
    if stop == "listing":
        print(files.count(), "files")
        return int(bool(errors))
    if stop == "indexing":
        print(facts(files.select("uri", "source")).count(), "facts")
        return int(bool(errors))
    graph = Graph.index(files.select("uri", "source"))
    say("indexed")
    if args.command == "query":
        own = graph.tables.property_graph()
        print(Query.schema(own, args.format) if args.schema else Query.parse(args.text).run(own).render(args.format))
        return 0
    if args.command == "lint":
        rules = load_rules(*args.rules)
        for name in unknown_rules(config, [*RULES, *(r.name for r in rules)]):
            print(f"unknown rule {name}", file=sys.stderr)
        found = graph.lint(config, root, rules=rules)
        rows = found.collect()
        for r in rows:
            print(f"{r['path']}:{r['line']}: {r['severity']}: {r['message']} [{r['rule']}]")
        print(", ".join(f"{r['n']} {r['severity']}" for r in summary(found).orderBy("severity").collect()) or "nothing found")
        return int(any(r["severity"] == "error" for r in rows))
    failed = bool(errors)
    if args.stats:
        for r in graph.stats().orderBy("measure", "kind").collect():
            print(r["measure"], r["kind"], f"{r['value']:g}")
    if args.dot:
        for r in graph.dot(args.show_builtins).collect():
            print(r["line"])
    if args.check_integrity:
        for r in graph.integrity().collect():
            print(r["name"], r["error"])
            failed = True
    if args.report_orphans:
        lines = ["\t".join(r) for r in graph.orphans().collect()]
        print("\n".join(lines)) if args.report_orphans == "-" else Path(args.report_orphans).write_text("".join(x + "\n" for x in lines))
    if not (args.stats or args.dot or args.check_integrity or args.report_orphans):
        print(graph.tables.declarations.count(), "declarations")
    return int(failed)
