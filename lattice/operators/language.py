"""The query language: catalog, element and relation matches, call walks; and the shorter navigation form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.model import EdgeKind, Graph, catalog_sizes
from lattice.operators.graph import walk
from lattice.operators.search import symbols, the_one


class QueryError(ValueError):
    """The text is no query of this language."""


@dataclass(frozen=True)
class Plan:
    """A parsed query: its form, arguments, and a line that says what runs."""

    form: str
    args: tuple
    label: str


FORMS = (
    ("catalog", r"CATALOG", "read catalog"),
    ("label", r"MATCH\s+ELEMENTS\s+HAS\s+LABEL\s+(\w+)", "scan elements with label {0}"),
    ("where", r"MATCH\s+ELEMENTS\s+WHERE\s+(\w+)\s*=\s*'((?:[^']|'')*)'", "look up elements by {0}"),
    ("elements", r"MATCH\s+ELEMENTS", "scan elements"),
    ("relations", r"MATCH\s+RELATIONS\s+TYPE\s+(\w+)", "scan relations of type {0}"),
    ("walk", r"GRAPH\s+calls\s+WALK\s+FROM\s+(\d+)\s+DEPTH\s+(\d+)(?:\s+DIRECTION\s+(outgoing|incoming|both))?(?:\s+LIMIT\s+(\d+))?", "walk calls from {0} to depth {1}"),
)
PROPERTIES = ("stable_key", "name", "qualified_name", "kind", "language", "file_path")


def parse(query: str) -> Plan:
    for form, pattern, label in FORMS:
        if m := re.fullmatch(pattern + r"\s*;?", query.strip(), re.IGNORECASE):
            args = m.groups()
            if form == "where":
                args = (args[0], args[1].replace("''", "'"))
                if args[0] not in PROPERTIES:
                    raise QueryError(f"no property {args[0]}; there are {', '.join(PROPERTIES)}")
            return Plan(form, args, label.format(*args))
    raise QueryError(f"unsupported query: {query.strip()[:80]}")


def is_structured(text: str) -> bool:
    return (text.split() or [""])[0].upper() in ("CATALOG", "MATCH", "GRAPH")


def run(graph: Graph, query: str) -> DataFrame:
    plan = parse(query)
    if plan.form == "catalog":
        return graph.elements.sparkSession.createDataFrame(list(catalog_sizes().items()), "name string, number long")
    if plan.form == "elements":
        return symbols(graph.elements).select("id")
    if plan.form == "label":
        return symbols(graph.elements).where(F.col("kind") == plan.args[0]).select("id")
    if plan.form == "where":
        return symbols(graph.elements).where(F.col(plan.args[0]) == plan.args[1]).select("id")
    if plan.form == "relations":
        return graph.relations.where(F.col("kind") == plan.args[0]).select("id")
    start, depth, direction, limit = plan.args
    seed = graph.elements.where(F.col("id") == int(start)).select("id")
    return walk(graph.relations, seed, (EdgeKind.CALLS,), (direction or "outgoing").lower(), int(depth), int(limit) if limit else None)


def explain(graph: Graph, query: str) -> str:
    """What a query does, in one line, and Spark's plan below it."""
    df = run(graph, query)
    return f"{parse(query).label}\n{df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"


def expand(graph: Graph, ids: DataFrame) -> DataFrame:
    """Ids with their symbols."""
    return ids.join(graph.elements.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line"), "id", "left")


def expand_relations(graph: Graph, ids: DataFrame) -> DataFrame:
    """Ids of relations with what they join: kind, both ends with their names, how sure it is, and where it is written."""
    ends = [graph.elements.select(F.col("id").alias(f"{end}_id"), F.col("qualified_name").alias(end)) for end in ("source", "target")]
    known = graph.relations.select("id", "kind", "source_id", "target_id", "resolution", "site_line", "site_text")
    return ids.join(known, "id").join(ends[0], "source_id", "left").join(ends[1], "target_id", "left").select("id", "kind", "source_id", "source", "target_id", "target", "resolution", "site_line", "site_text")


def run_expanded(graph: Graph, query: str) -> DataFrame:
    """A query's rows with what they stand for: symbols, or relations with their ends; the catalog as it is."""
    form, rows = parse(query).form, run(graph, query)
    return rows if form == "catalog" else expand_relations(graph, rows) if form == "relations" else expand(graph, rows)


@dataclass(frozen=True)
class Navigation:
    edge: str
    direction: str
    selector: str
    depth: int = 2
    limit: int = 1000


def parse_navigation(text: str) -> Navigation:
    """<edge> <direction> <selector> [depth n] [limit n]"""
    words = text.split()
    if len(words) < 3 or words[0] not in list(EdgeKind) or words[1] not in ("outgoing", "incoming", "both"):
        raise QueryError("expected: <edge> <direction> <selector> [depth n] [limit n]")
    rest, seen = words[3:], {}
    while rest:
        if len(rest) < 2 or rest[0] not in ("depth", "limit") or rest[0] in seen or not rest[1].isdecimal():
            raise QueryError(f"unexpected: {' '.join(rest)}")
        seen[rest[0]] = int(rest[1])
        rest = rest[2:]
    return Navigation(words[0], words[1], words[2], **seen)


def navigate(graph: Graph, text: str) -> DataFrame:
    n = parse_navigation(text)
    return walk(graph.relations, the_one(graph.elements, n.selector), (n.edge,), n.direction, n.depth, n.limit)
