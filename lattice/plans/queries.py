"""Each operator applied to the warehouse's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import LIFTED_EDGES, catalog_sizes
from lattice.operators import context, evaluation, graph, language, reconcile, resolve, search
from lattice.runtime import release
from lattice.sources.warehouse import PARTS, Warehouse

PLANS: dict = {}


def plan(f):
    PLANS[f.__name__] = lambda spark, sf_dir, f=f: f(Warehouse(spark, sf_dir))
    return f


def symbol_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: symbols that answer a few words, best first."""
    return search.search_symbols(Warehouse(spark, sf_dir).elements(), "Customer order urgent", 50).select("id", "score", "qualified_name")


PLANS["symbol_search_topk"] = symbol_search_topk


@plan
def index_graph(w: Warehouse) -> DataFrame:
    """The number of rows of each part of the index, all of them made anew: what a first query waits for."""
    made = [(part, w.made(part)) for part in PARTS]
    sizes = w.spark.createDataFrame([(part, df.count()) for part, df in made], "part string, n long")
    release(*(df for _, df in made))
    return sizes


# scans, counts, lookups
@plan
def status_counts(w: Warehouse) -> DataFrame:
    return search.status(w.graph())


@plan
def catalog(w: Warehouse) -> DataFrame:
    return w.spark.createDataFrame(list(catalog_sizes().items()), "name string, number long")


@plan
def label_scan(w: Warehouse) -> DataFrame:
    return language.run(w.graph(), "MATCH ELEMENTS HAS LABEL struct")


@plan
def property_lookup(w: Warehouse) -> DataFrame:
    return language.run(w.graph(), "MATCH ELEMENTS WHERE name = 'small ring'")


@plan
def relations_by_type(w: Warehouse) -> DataFrame:
    return w.relations().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@plan
def adjacency_capped(w: Warehouse) -> DataFrame:
    n = F.row_number().over(W.partitionBy("source_id").orderBy("id"))
    return w.relations().where("kind = 'calls'").withColumn("n", n).where("n <= 3").select("source_id", "target_id", "n")


# text
@plan
def search_terms(w: Warehouse) -> DataFrame:
    return w.table("documents").select("doc_id", F.array_join(text.terms(F.col("text")), " ").alias("terms"))


@plan
def script_blocks(w: Warehouse) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1))
    return w.table("pages").select("page_id", F.size(found).cast("long").alias("blocks"), F.array_join(found, "|").alias("scripts"))


@plan
def symbol_search_kinds(w: Warehouse) -> DataFrame:
    return search.search_symbols(w.elements(), "order Nation 7", 40, ("module", "struct")).select("id", "score")


@plan
def symbol_search_no_terms(w: Warehouse) -> DataFrame:
    return search.search_symbols(w.elements(), "a ? b", 25).select("id", "score")


@plan
def file_search(w: Warehouse) -> DataFrame:
    return search.search_files(w.elements(), "Brand parts orders", 50).select("file_path", "score", "symbol_count", F.array_join("top_symbols", ",").alias("top"))


@plan
def test_like_split(w: Warehouse) -> DataFrame:
    return w.elements().groupBy(text.test_like(F.col("file_path")).alias("is_test"), "kind").agg(F.count("*").alias("n"))


@plan
def preview_signature(w: Warehouse) -> DataFrame:
    t = F.col("text")
    return w.table("documents").select("doc_id", text.bounded(text.compact(F.regexp_replace(t, r"[^\x20-\x7E\n]", "")), 300).alias("signature"), F.substring(F.array_join(F.slice(F.split(t, "\n"), 1, 24), "\n"), 1, 1200).alias("preview"))


@plan
def qualify_names(w: Warehouse) -> DataFrame:
    e = w.elements()
    scopes = text.enclosing(F.col("qualified_name"))
    return e.select("id", F.size(scopes).cast("long").alias("depth"), F.coalesce(F.get(scopes, F.lit(0)), F.lit("")).alias("scope"), text.last_segment(F.col("qualified_name")).alias("last"), text.composite_key(F.col("kind"), F.col("name")).alias("key"))


# selectors
@plan
def sel_name(w: Warehouse) -> DataFrame:
    return search.select(w.elements(), "name:NATION_3").select("id", "qualified_name")


@plan
def sel_qualified(w: Warehouse) -> DataFrame:
    return search.select(w.elements(), "AMERICA::NATION_1").select("id", "qualified_name")


@plan
def sel_element(w: Warehouse) -> DataFrame:
    return search.select(w.elements(), "element:4000000007").select("id", "qualified_name")


@plan
def sel_file_line(w: Warehouse) -> DataFrame:
    return search.select(w.elements(), "file:src/NATION_2/mod.rs:10").select("id", "qualified_name")


@plan
def sel_ambiguous(w: Warehouse) -> DataFrame:
    found = search.select(w.elements(), "name:red widget")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"))


# resolution
def _resolved(w: Warehouse):
    return resolve.resolve(w.refs(), w.imports(), w.elements())


@plan
def resolve_all(w: Warehouse) -> DataFrame:
    return resolve.resolved_counts(w.refs(), w.imports(), w.elements(), F.col("id") % 1000).withColumnRenamed("total", "check")


def _tier(kind: str):
    def f(w: Warehouse) -> DataFrame:
        return _resolved(w)[0].where(F.col("resolution") == kind).select("ref_id", "target_id")

    f.__name__ = f"tier_{kind}"
    plan(f)


for _kind in ("exact", "scoped", "import", "receiver", "simple"):
    _tier(_kind)


@plan
def unresolved(w: Warehouse) -> DataFrame:
    return _resolved(w)[1].select("ref_id", "source_id")


# architecture
def _levels(w: Warehouse) -> DataFrame:
    home = w.table("customer").select((F.col("c_custkey") + 4000000000).alias("c"), (F.col("c_nationkey") + 2000000000).cast("long").alias("nation"))
    owned = w.table("orders").select((F.col("o_orderkey") + 6000000000).alias("id"), (F.col("o_custkey") + 4000000000).alias("c")).join(home, "c").select("id", "nation")
    made = w.table("supplier").select((F.col("s_suppkey") + 3000000000).alias("id"), (F.col("s_nationkey") + 2000000000).cast("long").alias("nation"))
    region = w.table("nation").select((F.col("n_nationkey") + 2000000000).cast("long").alias("nation"), (F.col("n_regionkey") + 1000000000).cast("long").alias("region"))
    return owned.union(made).join(region, "nation").select("id", F.array("nation", "region").alias("levels"))


def _supplies(w: Warehouse) -> DataFrame:
    line = w.table("lineitem")
    return line.select((F.col("l_orderkey") + 6000000000).alias("source_id"), (F.col("l_suppkey") + 3000000000).alias("target_id"), F.lit(LIFTED_EDGES[0].value).alias("kind"), F.lit("exact").alias("resolution"))


@plan
def lift_dependencies(w: Warehouse) -> DataFrame:
    return resolve.lift_dependencies(_supplies(w), _levels(w))


@plan
def layer_cake(w: Warehouse) -> DataFrame:
    return context.package_dependencies(resolve.lift_dependencies(_supplies(w), _levels(w)), w.elements())


@plan
def container_spine(w: Warehouse) -> DataFrame:
    files = w.elements().select(F.concat(F.lit("file:"), "file_path").alias("stable_key"), F.regexp_replace(F.regexp_replace("file_path", r"^(src|tests)/|\.rs$|/mod\.rs$", ""), "/", "::").alias("qualified_name"), "file_path").distinct()
    return resolve.container_spine(files)[1]


@plan
def membership(w: Warehouse) -> DataFrame:
    contains = w.relations().where("kind = 'contains'")
    return resolve.membership(contains, w.elements()).select("anchor_id", F.col("size").cast("long").alias("size"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@plan
def impl_groups(w: Warehouse) -> DataFrame:
    grouped = resolve.hyperedge_groups(w.incidences().where("kind = 'impl_group'"))
    return grouped.select("relation_id", F.size("participants").cast("long").alias("size"), F.array_join(F.transform("participants", lambda p: F.concat(p["role"], F.lit(":"), p["element_id"].cast("string"))), ",").alias("participants"))


# graph
def _seed(w: Warehouse, *ids: int) -> DataFrame:
    return w.spark.createDataFrame([(i,) for i in ids], "id long")


@plan
def walk_out(w: Warehouse) -> DataFrame:
    return graph.walk(w.stored("relations"), _seed(w, 2000000003), ("contains", "calls"), "outgoing", 3)


@plan
def walk_in(w: Warehouse) -> DataFrame:
    return graph.walk(w.stored("relations"), _seed(w, 5000000010), ("contains", "calls"), "incoming", 4)


@plan
def walk_both(w: Warehouse) -> DataFrame:
    return graph.walk(w.stored("relations"), _seed(w, 6000000011), ("calls",), "both", 3)


@plan
def walk_edges(w: Warehouse) -> DataFrame:
    r = w.stored("relations")
    return graph.walk_edges(r, graph.walk(r, _seed(w, 6000000011), ("calls",), "both", 2), ("calls",))


@plan
def nav_contains(w: Warehouse) -> DataFrame:
    return language.navigate(w.graph(), "contains outgoing ASIA depth 2 limit 400")


@plan
def walk_query(w: Warehouse) -> DataFrame:
    return language.run(w.graph(), "GRAPH calls WALK FROM 6000000020 DEPTH 2 DIRECTION both LIMIT 60")


@plan
def ancestors(w: Warehouse) -> DataFrame:
    return graph.ancestors(w.relations(), w.elements().where("kind = 'function'").select("id"))


@plan
def blast_radius(w: Warehouse) -> DataFrame:
    seeds = w.spark.createDataFrame([(5000000001, 1), (5000000002, 2)], "id long, rank int")
    return context.blast_radius(w.relations(), w.elements(), seeds)


@plan
def context_relations(w: Warehouse) -> DataFrame:
    chosen = w.elements().where("id between 6000000000 and 6000000030 or id between 5000000000 and 5000000400").select("id")
    return context.relationships(w.relations(), chosen).select("relation_id", "source_id", "target_id")


def _selected(w: Warehouse) -> DataFrame:
    """A report's selection: KEEP elements at most."""
    return context.walks.cut(context.candidates(w.graph(), "order urgent Customer", 4))


@plan
def context_relations_selected(w: Warehouse) -> DataFrame:
    return context.relationships(w.relations(), _selected(w)).select("relation_id", "source_id", "target_id")


# ranking
@plan
def ppr_fixed_rounds(w: Warehouse) -> DataFrame:
    edges = graph.adjacency(w.relations(), ("calls", "contains"))
    return graph.pagerank(edges, _seed(w, 1000000001, 2000000002)).select("id", F.round("rank", 9).alias("rank"))


@plan
def hyper_ppr(w: Warehouse) -> DataFrame:
    inc = w.incidences().where("kind = 'impl_group'")
    return graph.hyper_pagerank(inc, _seed(w, 5000000001, 5000000002))[1].select("id", F.round("rank", 9).alias("rank"))


# budget
@plan
def budget_prefix(w: Warehouse) -> DataFrame:
    files = w.elements().where("kind = 'struct'").groupBy("file_path").agg(F.min("id").alias("file_rank"), F.sum(F.octet_length("qualified_name")).cast("long").alias("bytes"))
    return context.budget(files, "bytes", 900)


@plan
def skeleton_windows(w: Warehouse) -> DataFrame:
    return context.line_windows(w.elements().where("kind = 'function'")).select("file_path", "low", "high")


# storage
def _versions(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    c = w.table("customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"), "c_acctbal")
    return c.where("id % 7 <> 0").select("key", "id"), c.where("id % 5 <> 0").select("key", "c_acctbal")


@plan
def reconcile_diff(w: Warehouse) -> DataFrame:
    old, new = _versions(w)
    return reconcile.diff(old, new, "key")


@plan
def id_carry_over(w: Warehouse) -> DataFrame:
    old, new = _versions(w)
    return reconcile.carry_ids(old, new, "key").join(old.select("key", F.col("id").alias("was")), "key").select("key", "id", "was", "c_acctbal")


@plan
def digest_changed(w: Warehouse) -> DataFrame:
    files = w.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"))
    changed = files.withColumn("content_hash", F.when(F.col("path") == "3", F.lit("edited")).otherwise(F.col("content_hash")))
    a, b = (reconcile.digest(x).select(F.col("digest").alias(n)) for x, n in ((files, "a"), (changed, "b")))
    again = reconcile.digest(files.repartition(3, "content_hash")).select(F.col("digest").alias("c"))
    return a.join(F.broadcast(b)).join(F.broadcast(again)).select((F.col("a") != F.col("b")).alias("edited_differs"), (F.col("a") == F.col("c")).alias("order_irrelevant"))


# evaluation
@plan
def run_metrics(w: Warehouse) -> DataFrame:
    return evaluation.duration_metrics(w.spans().withColumn("observed", F.col("duration_ms") < 99.5), ["run_id"], "duration_ms", "observed").withColumn("total", F.round("total", 4))


@plan
def arm_medians(w: Warehouse) -> DataFrame:
    return w.spans().where("success").groupBy("arm").agg(evaluation.median("duration_ms").alias("median_ms"), F.count("*").alias("n"))


@plan
def t_ci(w: Warehouse) -> DataFrame:
    s = evaluation.spread(w.spans(), ["arm", "event_type"], "duration_ms")
    return s.select("arm", "event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "stddev", "min", "max", "ci95_half")))


@plan
def p95_nearest_rank(w: Warehouse) -> DataFrame:
    return w.spans().groupBy("event_type").agg(evaluation.nearest_rank("duration_ms", 0.95).alias("p95"))


@plan
def interval_union(w: Warehouse) -> DataFrame:
    return evaluation.union_length(w.spans(), ["run_id"], "start_us", "end_us")


@plan
def arm_compare(w: Warehouse) -> DataFrame:
    m = w.spans().groupBy("arm").agg(evaluation.median("duration_ms").alias("median_ms"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    out = evaluation.compare_arms(m, "arm", "arm0", ["median_ms", "success_rate"])
    return out.select("arm", "metric", *(F.round(c, 6).alias(c) for c in ("value", "base_value", "delta", "pct")))


@plan
def span_dedupe(w: Warehouse) -> DataFrame:
    twice = w.spans().unionByName(w.spans().where("span_id % 3 = 0"))
    return evaluation.dedupe_spans(twice, ["span_id", "run_id", "arm", "event_type", "duration_ms", "start_us", "end_us"]).groupBy("arm").agg(F.count("*").alias("n"))


@plan
def failure_buckets(w: Warehouse) -> DataFrame:
    message = F.when(F.col("event_type") == "click", "matched multiple symbols").when(F.col("event_type") == "signup", "did not match any symbol").when(F.col("event_type") == "view", "unsupported profile query").otherwise("boom")
    code = F.when(F.col("duration_ms") < 10, 0).otherwise(1)
    return evaluation.buckets(w.spans(), evaluation.classify_failure(code, message, F.col("event_type") == "view", F.col("run_id") % 2 == 0))


@plan
def missing_runs(w: Warehouse) -> DataFrame:
    runs = w.spans().groupBy("run_id").agg(F.count("*").alias("spans"))
    return evaluation.missing_runs(w.spark.range(0, 400).select(F.col("id").alias("run_id")), runs, ["run_id"]).select("run_id", "spans", "reason")


@plan
def context_report(w: Warehouse) -> DataFrame:
    return context.report(w.graph(), "order urgent Customer", 4)


@plan
def longest_path(w: Warehouse) -> DataFrame:
    ids = F.broadcast(_selected(w).select("id"))
    among = w.relations().join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edges = among.select("source_id", "target_id").distinct().collect()  # between KEEP elements at most
    chain = graph.longest_path([tuple(r) for r in edges])
    return w.spark.createDataFrame(list(enumerate(chain)), "position int, id long")
