"""Command line: index a tree and ask about it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice import project
from lattice.model import NodeKind
from lattice.operators import language


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lattice").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rows(df: DataFrame, form: str) -> str:
    if form == "table":
        return "\n".join(r[0] for r in df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))).collect())
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()], indent=2)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lattice")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "languages"):
        sub.add_parser(name)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--format", choices=("json", "table", "expand"), default="json")
    s = sub.add_parser("symbols")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=50)
    s.add_argument("--kind", action="append", default=[], choices=[k.value for k in NodeKind])
    f = sub.add_parser("files")
    f.add_argument("text")
    f.add_argument("--limit", type=int, default=50)
    c = sub.add_parser("context")
    c.add_argument("text")
    for n, d in (("--limit", 8), ("--depth", 1), ("--max-bytes", 20_000)):
        c.add_argument(n, type=int, default=d)
    sub.add_parser("symbol").add_argument("selector")
    for name in ("calls", "callers", "walk"):
        w = sub.add_parser(name)
        w.add_argument("selector")
        w.add_argument("--depth", type=int, default=1)
        w.add_argument("--limit", type=int, default=100)
    sub.add_parser("explain").add_argument("text")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "index":
        print(json.dumps(project.index_project(spark, a.root), indent=2))
        return 0
    if a.command == "status":
        print(json.dumps(project.status(spark, a.root), indent=2))
        return 0
    if a.command == "languages":
        print(_rows(project.language_support(spark), "table"))
        return 0
    index = project.ProjectIndex(spark, a.root)
    if a.command == "query":
        if not language.is_structured(a.text):
            print("unsupported query; it starts with CATALOG, MATCH or GRAPH", file=sys.stderr)
            return 2
        print(_rows(index.query_expanded(a.text) if a.format == "expand" else index.query(a.text), "table" if a.format == "table" else "json"))
    elif a.command == "symbols":
        print(_rows(index.search_symbols(a.text, a.limit, tuple(a.kind)).select("score", "id", "kind", "qualified_name", "file_path", "start_line"), "json"))
    elif a.command == "files":
        print(_rows(index.search_files(a.text, a.limit), "json"))
    elif a.command == "context":
        print(json.dumps(index.context(a.text, a.limit, a.depth, a.max_bytes), indent=2, default=str))
    elif a.command == "explain":
        print(index.explain(a.text))
    else:
        outcome, rows = index.resolve_selector(a.selector)
        if outcome != "matched" or a.command == "symbol":
            print(json.dumps({"outcome": outcome, "matches": [r.asDict() for r in rows]}, indent=2, default=str))
            return 2 if outcome == "ambiguous" and a.command != "symbol" else 0
        direction = {"calls": "outgoing", "callers": "incoming", "walk": "both"}[a.command]
        found = index.call_graph(f"element:{rows[0]['id']}", direction, a.depth, a.limit)
        print(_rows(language.expand(index.graph, found), "json"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
