"""Indexing a source tree and reading the index: the library's front door."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import SPAN, EdgeKind, Graph
from lattice.operators import context, graph, language, reconcile, resolve, search
from lattice.runtime import cut, ship
from lattice.sources import extract, tree

Progress = Callable[[str], None]


class IndexMissing(RuntimeError):
    """There is no index yet."""


def _nodes(made: DataFrame) -> DataFrame:
    """Symbols of all files, the first of each key."""
    rows = made.select(F.inline("nodes"))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("stable_key").orderBy("file_path", "start_byte"))).where("n = 1").drop("n")


def resolve_tree(made: DataFrame) -> dict[str, DataFrame]:
    """elements, relations, incidences of extractions, by stable key; ids come with storing."""
    nodes = cut(_nodes(made))
    keyed = nodes.select(F.col("stable_key").alias("id"), "name", "qualified_name", "kind", "file_path")
    refs = made.select(F.posexplode("references").alias("n", "r"), "path").select("r.*", F.concat_ws(":", F.col("path"), F.col("n").cast("string")).alias("ref_id"))
    refs = refs.join(nodes.select(F.col("stable_key").alias("source_key"), F.col("qualified_name").alias("source_name")), "source_key").withColumnRenamed("source_key", "source_id")
    refs = cut(refs)
    imports = refs.where("kind_hint = 'import'").select("file_path", F.element_at("path", -1).alias("local_name"), "path", "ref_id")
    found, lost = resolve.resolve(refs.select("ref_id", "source_id", "source_name", "file_path", "path", "qualifier"), imports, keyed)
    syntactic = made.select(F.inline("edges")).distinct()
    known = nodes.select("stable_key")
    for end in ("source_key", "target_key"):
        syntactic = syntactic.join(known.withColumnRenamed("stable_key", end), end, "left_semi")
    site = F.concat(F.col("file_path"), F.lit("@"), F.col("start_byte").cast("string"), F.lit(".."), F.col("end_byte").cast("string"))
    sites = found.drop("source_id").join(refs, "ref_id").select(F.col("source_id").alias("source_key"), F.col("target_id").alias("target_key"), "kind", "resolution", F.col("start_line").alias("site_line"), F.col("text").alias("site_text"), site.alias("site"))
    plain = lambda df: df.select("source_key", "target_key", "kind", F.lit("exact").alias("resolution"), F.lit(None).cast("long").alias("site_line"), F.lit(None).cast("string").alias("site_text"), F.lit("-").alias("site"))
    edges = cut(plain(syntactic).unionByName(sites))
    files = nodes.where("kind = 'file'")
    containers, spine = resolve.container_spine(files.select("stable_key", "qualified_name", "file_path"))
    real = files.select("stable_key", "file_path").join(spine.withColumnRenamed("target_key", "stable_key"), "stable_key").select("file_path", F.array(F.concat(F.lit("package:"), F.regexp_extract("source_key", r"^(?:package|module):([^:]*(?::[^:]+)*?)(?:::|$)", 1)), "source_key", "stable_key").alias("levels"))
    levels = nodes.select(F.col("stable_key").alias("id"), "file_path").join(real, "file_path").select("id", "levels")
    lifted = resolve.lift_dependencies(edges.select(F.col("source_key").alias("source_id"), F.col("target_key").alias("target_id"), "kind", "resolution"), levels)
    lifted = lifted.select(F.col("source_id").alias("source_key"), F.col("target_id").alias("target_key"), F.lit(EdgeKind.DEPENDS_ON.value).alias("kind"))
    edges = edges.unionByName(plain(spine.withColumn("kind", F.lit(EdgeKind.CONTAINS.value)).unionByName(lifted)))
    minted = containers.select(F.col("key").alias("stable_key"), text.last_segment(F.col("qualified_name")).alias("name"), "qualified_name", "kind", "file_path")
    diagnostics = lost.join(refs.drop("source_id"), "ref_id").select(
        F.concat_ws(":", F.lit("unresolved"), "source_id", "kind", F.array_join("path", "::"), F.col("start_byte").cast("string")).alias("stable_key"), F.element_at("path", -1).alias("name"), F.array_join("path", "::").alias("qualified_name"), F.lit("unresolved_reference").alias("kind"), "file_path", *SPAN, F.col("text").alias("signature"), F.col("reason").alias("docstring")
    )
    elements = nodes.unionByName(minted, allowMissingColumns=True).unionByName(diagnostics.dropDuplicates(["stable_key"]), allowMissingColumns=True)
    elements = elements.fillna(0, list(SPAN)).fillna("", ["language"])
    members = edges.where("kind = 'contains'")
    anchors = elements.where(F.col("kind").isin("file", "module", "namespace", "package")).select(F.col("stable_key").alias("source_key"))
    inside = members.join(anchors, "source_key", "left_semi")
    parts = inside.select(F.concat(F.lit("membership:"), "source_key").alias("hyper_key"), F.col("target_key").alias("element_key"), F.lit("member").alias("role")).union(inside.select(F.concat(F.lit("membership:"), "source_key"), "source_key", F.lit("anchor")))
    blocks = elements.where("kind = 'impl_block'").select(F.col("stable_key").alias("source_key"))
    role = F.when(F.col("kind") == "contains", "member").when(F.col("kind") == "implements", "impl_trait").when(F.col("kind") == "implements_for", "impl_type")
    own = edges.join(blocks, "source_key", "left_semi").withColumn("role", role).where("role is not null")
    impl = F.concat(F.lit("impl_group:"), "source_key")
    parts = parts.union(own.select(impl, "target_key", "role")).union(own.select(impl, "source_key", F.lit("anchor")))
    keyed_edges = edges.withColumn("edge_key", text.composite_key(F.col("source_key"), F.col("kind"), F.col("target_key"), F.col("site"))).dropDuplicates(["edge_key"]).drop("site")
    return {"elements": elements, "relations": keyed_edges, "incidences": parts.distinct()}


def index_project(spark: SparkSession, root: str, folder: str | None = None, progress: Progress = lambda stage: None) -> dict:
    """Bring a tree's index up to date. An unchanged tree is only read; unchanged files keep their extractions and all symbols their ids."""
    ship(spark)
    store = reconcile.Store(spark, folder or os.path.join(root, ".lattice"))
    progress("scan")
    read = cut(tree.contents(tree.files(spark, root), root))
    hashes = read.select("path", F.concat_ws(":", F.coalesce("content_hash", F.lit("unreadable")), F.array_join("scope", "::")).alias("content_hash"))
    digest = reconcile.digest(hashes).first()
    digest = f"{tree.FORMAT}:{digest['digest'] if digest and digest['digest'] else 'empty'}"
    now = store.commit()
    if now and now["digest"] == digest:
        return now["stats"]
    progress("extract")
    made = cut(tree.reuse(read, store.table("extractions")))
    progress("resolve")
    parts = resolve_tree(made)
    progress("store")
    old = store.table("elements")
    no_ids = spark.createDataFrame([], "stable_key string, id long")
    elements = cut(search.with_words(reconcile.carry_ids(old.select("stable_key", "id") if old is not None else no_ids, parts["elements"], "stable_key")))
    ids = elements.select("stable_key", "id")
    at = lambda df, end: df.join(ids.select(F.col("stable_key").alias(f"{end}_key"), F.col("id").alias(f"{end}_id")), f"{end}_key")
    relations = at(at(parts["relations"], "source"), "target").drop("source_key", "target_key")
    old = store.table("relations")
    relations = cut(reconcile.carry_ids(old.select("edge_key", "id") if old is not None else spark.createDataFrame([], "edge_key string, id long"), relations, "edge_key"))
    whole = parts["incidences"].join(ids.withColumnRenamed("stable_key", "element_key"), "element_key", "left")
    whole = whole.withColumn("lost", F.max(F.col("id").isNull()).over(W.partitionBy("hyper_key"))).where("not lost")
    old = store.table("hyperedges")
    hyperedges = whole.select("hyper_key", F.substring_index("hyper_key", ":", 1).alias("kind")).distinct()
    hyperedges = cut(reconcile.carry_ids(old.select("hyper_key", "id") if old is not None else spark.createDataFrame([], "hyper_key string, id long"), hyperedges, "hyper_key"))
    incidences = whole.withColumnRenamed("id", "element_id").join(hyperedges.withColumnRenamed("id", "relation_id"), "hyper_key").select("relation_id", "element_id", "role", "kind")
    counts = made.agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "failed").alias("failed"), F.count_if(F.col("parse_status") == "partial").alias("partial")).first().asDict()
    more = elements.agg(F.count_if(F.col("kind") != "unresolved_reference").alias("symbols"), F.count_if(F.col("kind") == "unresolved_reference").alias("unresolved")).first().asDict()
    stats = {**counts, **more, "edges": relations.count(), "skipped": read.where(tree.unsupported(F.col("path"))).count()}
    store.publish({"elements": elements, "relations": relations, "incidences": incidences, "hyperedges": hyperedges, "extractions": made}, digest, stats)
    return stats


class ProjectIndex:
    """Reads of one snapshot."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None) -> None:
        self.store = reconcile.Store(spark, folder or os.path.join(root, ".lattice"))
        self.root, self.seen = root, None
        if self.store.commit() is None:
            raise IndexMissing(f"no index of {root}; index it first")

    @property
    def graph(self) -> Graph:
        """The current snapshot's tables; opened again after each commit."""
        now = self.store.commit()
        if self.seen is None or self.seen[0] != now["seq"]:
            inc = self.store.table("incidences")
            self.seen = (now["seq"], Graph(self.store.table("elements"), self.store.table("relations"), inc.select(F.col("relation_id").alias("id"), "kind").distinct(), inc))
        return self.seen[1]

    def resolve_selector(self, selector: str):
        return search.select_one(self.graph.elements, selector)

    def search_symbols(self, query: str, limit: int = 50, kinds: tuple[str, ...] = ()) -> DataFrame:
        return search.search_symbols(self.graph.elements, query, limit, kinds)

    def search_files(self, query: str, limit: int = 50) -> DataFrame:
        return search.search_files(self.graph.elements, query, limit)

    def call_graph(self, selector: str, direction: str = "outgoing", depth: int = 1, limit: int = 100) -> DataFrame:
        seed = search.the_one(self.graph.elements, selector)
        return graph.walk(self.graph.relations, seed, (EdgeKind.CALLS,), direction, depth, limit)

    def call_edges(self, selector: str, direction: str = "outgoing", depth: int = 1, limit: int = 100) -> DataFrame:
        """The calls among what call_graph finds, with their ends and the greater of the ends' depths."""
        found = cut(self.call_graph(selector, direction, depth, limit))
        edges = cut(graph.walk_edges(self.graph.relations, found, (EdgeKind.CALLS,)).select(F.col("relation_id").alias("id"), "depth"))
        return language.expand_relations(self.graph, edges.select("id")).join(edges, "id")

    def describe_symbol(self, selector: str) -> dict:
        """The one symbol of a selector, whole; NotOne if there is none or more than one."""
        one = search.the_one(self.graph.elements, selector)
        return search.without_words(self.graph.elements.join(one, "id", "left_semi")).first().asDict()

    def navigate(self, query: str) -> DataFrame:
        return language.navigate(self.graph, query)

    def query(self, query: str) -> DataFrame:
        return language.run(self.graph, query)

    def explain(self, query: str) -> str:
        return language.explain(self.graph, query)

    def query_expanded(self, query: str) -> DataFrame:
        return language.run_expanded(self.graph, query)

    def context(self, query: str, limit: int = 8, depth: int = 1, max_bytes: int = 20_000) -> dict:
        """A report for a task: files as skeletons within a budget, and what surrounds the symbols shown. depth is accepted and makes no difference."""
        chosen = cut(context.candidates(self.graph, query, limit))
        shown = self.graph.elements.join(F.broadcast(chosen), "id").orderBy("rank").collect()  # KEEP at most
        per: dict[str, list] = {}
        for r in shown:
            per.setdefault(r["file_path"], []).append(r)
        files, total, truncated = [], 0, False
        for path, rows in per.items():
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                    body = context.skeleton(f.read(), path, [(r["start_line"], r["end_line"]) for r in rows], max(max_bytes // 4, 1))
            except OSError:
                continue
            if files and total + len(body.encode()) > max_bytes:
                truncated = True
                break
            total += len(body.encode())
            files.append({"path": path, "text": body})
        kept = {f["path"] for f in files}
        related = context.relationships(self.graph.relations, chosen).select("relation_id", "source_id", "target_id", "kind").collect()
        calls = [(r["source_id"], r["target_id"]) for r in related if r["kind"] == "calls"]
        seeds = chosen.where("rank <= 8").select("id", "rank")
        blast = context.blast_radius(self.graph.relations, self.graph.elements, seeds).collect()
        crates = tuple(sorted({name for r in shown if (name := r["qualified_name"].split("::")[0])}))
        deps = context.package_dependencies(self.graph.relations.where("kind = 'depends_on'").select("source_id", "target_id"), self.graph.elements, crates).collect()
        return {
            "query": query,
            "budget": {"max_bytes": max_bytes, "used": total, "truncated": truncated},
            "symbols": [{"id": r["id"], "qualified_name": r["qualified_name"], "kind": r["kind"], "file_path": r["file_path"], "pagerank": r["pagerank"]} for r in shown if r["file_path"] in kept],
            "files": files,
            "relationships": [r.asDict() for r in related],
            "dependencies": [r.asDict() for r in deps],
            "hyperedges": [r.asDict(recursive=True) for r in context.hyperedges(self.graph, chosen).orderBy(F.round("score", 12).desc(), "relation_id").collect()],
            "blast_radius": [r.asDict() for r in blast],
            "call_flow": graph.longest_path(calls),
        }


def status(spark: SparkSession, root: str, folder: str | None = None) -> dict:
    """What is stored for a root; a missing index is no error."""
    now = reconcile.Store(spark, folder or os.path.join(root, ".lattice")).commit()
    return {"root": root, "exists": now is not None, **(now or {}).get("stats", {}), "commit": (now or {}).get("seq")}


def language_support(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(extract.languages(), "language string, extension string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
