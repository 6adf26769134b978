"""Bounded reports about a task: what to show within a byte budget, and what surrounds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import EXPLORED, PREFERRED, Graph
from lattice.operators import graph as walks
from lattice.operators.search import search_symbols

# Bounds of a report.
SCAN, KEEP, RELATIONS, PER_KIND, CALLERS, DEPENDENCIES = 800, 40, 160, 64, 30, 32
HYPEREDGES, PARTICIPANTS = 48, 24
PER_SEED, PER_PACKAGE = 32, 64
WHOLE_FILE, AROUND = 220, 3


def budget(ranked: DataFrame, size: str, most: int, rank: str = "file_rank") -> DataFrame:
    """The first row, and those after it while the running size stays within the budget; ranked holds a report's files, tens of rows."""
    w = W.orderBy(rank)
    return ranked.withColumn("running", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) | (F.col("running") <= most)).drop("n")


def first_seen(candidates: DataFrame, rank: str = "rank") -> DataFrame:
    """Files in the order in which their first symbol is ranked."""
    return candidates.groupBy("file_path").agg(F.min(rank).alias("file_rank"), F.count("*").alias("symbols"))


def line_windows(spans: DataFrame, around: int = AROUND) -> DataFrame:
    """Stretches of lines around spans (file_path, start_line, end_line), joined where they touch."""
    s = spans.select("file_path", F.greatest(F.col("start_line") - around, F.lit(1)).alias("low"), (F.col("end_line") + around).alias("high"))
    w = W.partitionBy("file_path").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("fresh", F.when(reach.isNull() | (F.col("low") > reach + 1), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("file_path", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def skeleton(content: str, path: str, spans: list[tuple[int, int]], cap: int) -> str:
    """One file's text for a report: whole if short, else the lines around its symbols, with numbers, up to about cap bytes."""
    lines = content.splitlines()
    if len(lines) <= WHOLE_FILE:
        parts = [(1, len(lines))]
    else:
        parts = []
        for low, high in sorted((max(1, a - AROUND), min(len(lines), b + AROUND)) for a, b in spans):
            if parts and low <= parts[-1][1] + 1:
                parts[-1] = (parts[-1][0], max(parts[-1][1], high))
            else:
                parts.append((low, high))
    out = f"// {path}\n"
    for i, (low, high) in enumerate(parts):
        if i:
            out += " " * 7 + "...\n"
        for n in range(low, high + 1):
            out += f"{n:>6}\t{lines[n - 1].rstrip()}\n"
            if len(out.encode()) > cap:
                return out + " " * 7 + "... (truncated)\n"
    return out


def relationships(relations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Relations between chosen elements (id), at most PER_KIND of a kind from one element."""
    ids = F.broadcast(chosen.select("id").distinct())  # KEEP at most
    own = relations.where("kind <> 'depends_on'").withColumnRenamed("id", "relation_id")
    own = own.join(ids, own["source_id"] == ids["id"], "left_semi").join(ids, own["target_id"] == ids["id"], "left_semi")
    n = F.row_number().over(W.partitionBy("source_id", "kind").orderBy("relation_id"))
    return own.withColumn("n", n).where(F.col("n") <= PER_KIND).drop("n").orderBy("source_id", "kind", "relation_id").limit(RELATIONS)


def blast_radius(relations: DataFrame, elements: DataFrame, seeds: DataFrame) -> DataFrame:
    """Callers of the seeds (id, rank), the first PER_SEED calls of each, each caller once, by seed and id, at most CALLERS; and whether they are tests."""
    calls = relations.where("kind = 'calls'").join(F.broadcast(seeds.select(F.col("id").alias("target_id"), "rank")), "target_id")
    calls = calls.withColumn("n", F.row_number().over(W.partitionBy("target_id").orderBy("id"))).where(F.col("n") <= PER_SEED)
    first = calls.groupBy(F.col("source_id").alias("id")).agg(F.min("rank").alias("rank"))
    named = first.join(elements, "id").select("id", "rank", "qualified_name", text.test_like(F.col("file_path")).alias("is_test"))
    return named.orderBy("rank", "id").limit(CALLERS)


def hyperedges(graph: Graph, chosen: DataFrame) -> DataFrame:
    """Hyperedges that chosen elements (id) or containers above them take part in: the best HYPEREDGES by rank from the chosen, then id, each with at most PARTICIPANTS, anchors first."""
    ids = chosen.select("id")
    around = walks.cut(ids.union(walks.ancestors(graph.relations, ids).select("ancestor_id")).distinct())
    own = graph.incidences.join(around.withColumnRenamed("id", "element_id"), "element_id", "left_semi").select("relation_id").distinct()
    parts = walks.cut(graph.incidences.join(own, "relation_id", "left_semi"))
    ranks = walks.hyper_pagerank(parts, ids)[1].withColumnsRenamed({"id": "relation_id", "rank": "score"})
    scored = own.join(ranks, "relation_id", "left").fillna(0.0, ["score"]).orderBy(F.round("score", 12).desc(), "relation_id").limit(HYPEREDGES)
    n = F.row_number().over(W.partitionBy("relation_id").orderBy(F.col("role") != "anchor", "element_id"))
    shown = parts.join(F.broadcast(scored), "relation_id").withColumn("n", n).where(F.col("n") <= PARTICIPANTS)
    return shown.groupBy("relation_id", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "role", "element_id"))), lambda x: F.struct(x["role"].alias("role"), x["element_id"].alias("element_id"))).alias("participants"))


def package_dependencies(lifted: DataFrame, elements: DataFrame, packages: tuple[str, ...] | None = None) -> DataFrame:
    """Dependencies between packages by name, of the named packages or of all: the first PER_PACKAGE of each, at most DEPENDENCIES."""
    p = elements.where("kind = 'package'").select("id", "name")
    own = p if packages is None else p.where(F.col("name").isin(*packages))
    a, b = own.select(F.col("id").alias("source_id"), F.col("name").alias("source")), p.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    found = lifted.join(a, "source_id").join(b, "target_id").select("source", "target").distinct()
    n = F.row_number().over(W.partitionBy("source").orderBy("target"))
    return found.withColumn("n", n).where(F.col("n") <= PER_PACKAGE).drop("n").orderBy("source", "target").limit(DEPENDENCIES)


def candidates(graph: Graph, query: str, limit: int = 8) -> DataFrame:
    """(id, rank, pagerank): what to show for a query: the best symbols, ranked over all explored relations."""
    seeds = search_symbols(graph.elements, query, 3 * limit, tuple(PREFERRED)).where("kind <> 'file'").orderBy(F.col("score").desc(), "qualified_name", "file_path", "start_byte").limit(limit)
    seeds = walks.cut(seeds.select("id", "score"))
    ranks = walks.pagerank(walks.adjacency(graph.relations, EXPLORED), seeds)
    top = ranks.orderBy(F.round("rank", 12).desc(), "id").limit(SCAN)
    kept = top.join(graph.elements.where("kind <> 'file'").select("id"), "id", "left_semi").orderBy(F.round("rank", 12).desc(), "id").limit(KEEP)
    return kept.select("id", F.row_number().over(W.orderBy(F.round("rank", 12).desc(), "id")).alias("rank"), F.col("rank").alias("pagerank"))


def report(graph: Graph, query: str, limit: int = 8, most: int = 20_000, size: Column | None = None) -> DataFrame:
    """A context report's files: path, rank, symbols, bytes, running bytes. size: bytes of a symbol, by default its span."""
    chosen = walks.cut(candidates(graph, query, limit))
    shown = graph.elements.join(F.broadcast(chosen), "id").withColumn("bytes", size if size is not None else F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0)))
    cap = max(most // 4, 1)
    files = shown.groupBy("file_path").agg(F.min("rank").alias("file_rank"), F.count("*").alias("symbols"), F.least(F.sum("bytes"), F.lit(cap)).alias("bytes"))
    return budget(files, "bytes", most)
