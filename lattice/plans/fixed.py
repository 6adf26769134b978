"""Operators on small fixed inputs: sources, traces, stored snapshots; and the reports that have no table of their own."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice import format as texts
from lattice import project
from lattice.functions import text
from lattice.operators import context, evaluation, language, reconcile, resolve, runs, search
from lattice.runtime import cut, session_folder
from lattice.sources import traces, tree
from lattice.sources.warehouse import Warehouse

#: A text in each language that has an extractor: path, scope, content.
SOURCES = {
    "rust": ("src/lib.rs", "c", "/// Helps.\npub fn helper() -> u32 { 1 }\n\npub struct Foo { a: u32 }\n\nimpl Foo {\n    pub fn run(&self) { helper(); }\n}\n\npub trait Go { fn go(&self); }\n\nimpl Go for Foo {\n    fn go(&self) { self.run(); }\n}\n\npub enum E { A }\npub const N: u32 = 1;\npub type T = u32;\nmod inner { pub fn deep() {} }\nuse crate::a::{Bar, b::Baz};\n"),
    "go": ("db/store.go", "m::db", "package db\n\n// Helper helps.\nfunc Helper() int { return 1 }\n\ntype Store struct { n int }\n\ntype Reader interface { Read() }\n\nfunc (s *Store) Get() int { return Helper() }\n"),
    "typescript": ("src/app.ts", "src::app", "import { helper } from './util';\n\n/** A class. */\nclass A {\n  run(x: number): void {\n    helper(x);\n  }\n}\n\nexport interface I { x: number }\n\nexport function entry() {\n  return helper(1);\n}\n\nexport const f = (a: number) => a;\ntype T = string;\nenum E { A }\n"),
    "javascript": ("src/a.js", "src::a", "class A {\n  run() {\n    go();\n  }\n}\nfunction f() { run(); }\n"),
    "python": ("pkg/app.py", "pkg::app", "from pkg.util import helper\n\n\nclass A:\n    def run(self):\n        return self.step(1)\n\n\n# Starts.\ndef entry():\n    return helper(1)\n"),
    "svelte": ("src/App.svelte", "src::App", "<h1>x</h1>\n<script>\nfunction entry() { helper(); }\nfunction helper() {}\n</script>\n"),
    "vue": ("src/App.vue", "src::App", "<template><p/></template>\n<script setup>\nfunction go() { run(); }\n</script>\n"),
    "java": ("A.java", "A", "class A {\n  public int f(int x) { return g(x); }\n}\ninterface B {}\nenum C { X }\n"),
    "c": ("s.c", "s", "struct s { int a; };\nint f(int x) { return g(x); }\n#define M 1\n"),
    "cpp": ("s.cpp", "s", "namespace n {\nclass K { int a; };\n}\nint f(int x) { return g(x); }\n"),
    "csharp": ("N.cs", "N", "namespace N {\n  class A {\n    public int F() { return G(); }\n  }\n  interface I {}\n}\n"),
    "ruby": ("a.rb", "a", "module M\n  class A\n    def run\n      go(1)\n    end\n  end\nend\n"),
    "kotlin": ("a.kt", "a", "class A {\n  fun f() { g() }\n}\ninterface I\n"),
    "swift": ("a.swift", "a", "struct A {\n  func f() { g() }\n}\nprotocol P {}\n"),
    "php": ("a.php", "a", "<?php\nclass A {\n  function f() { g(); }\n}\n"),
    "scala": ("a.scala", "a", "trait T {\n  def f = g(1)\n}\nobject O {}\n"),
    "lua": ("a.lua", "a", "local function f()\n  g()\nend\n"),
    "luau": ("a.luau", "a", "local function f()\n  g()\nend\n"),
    "dart": ("a.dart", "a", "class A {\n  void f() { g(); }\n}\nenum E { x }\n"),
    "objc": ("a.m", "a", "@interface A\n@end\n@implementation A\n- (void)f { g(); }\n@end\n"),
    "pascal": ("a.pas", "a", "procedure F;\nbegin\n  G(1);\nend;\n"),
}
#: A tree of two packages, in which one calls the other, with what a walk leaves out.
TREE = {
    "crates/a/Cargo.toml": '[package]\nname = "a-one"\n',
    "crates/a/src/lib.rs": "use b::bar;\n/// Starts.\npub fn start() { b::bar(); inner(); missing(); }\nfn inner() {}\n",
    "crates/b/Cargo.toml": '[package]\nname = "b"\n',
    "crates/b/src/lib.rs": "pub fn bar() {}\npub struct S;\nimpl S { pub fn go(&self) { bar(); } }\n",
    "_tools/__init__.py": "",
    "_tools/run.py": "def main():\n    pass\n",
    ".gitignore": "*.log\nout/\n",
    "x.log": "left out",
    "out/y.rs": "fn left_out() {}\n",
    "target/z.rs": "fn left_out() {}\n",
    "page.liquid": "{{ x }}",
}

FIXED: dict = {}


def fixed(f):
    FIXED[f.__name__] = f
    return f


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this application on the driver's disk, for trees and stores, which are files."""
    folder = session_folder(spark)
    if not folder.startswith(("file:", "/")):
        raise RuntimeError("source trees and stores are files; the shared folder is not")
    return os.path.join(folder.removeprefix("file://").removeprefix("file:"), name)


# extraction
def _extracted(spark: SparkSession) -> DataFrame:
    files = [(p, lang, scope.split("::"), bytearray(body.encode()), None, "h") for lang, (p, scope, body) in SOURCES.items()]
    read = spark.createDataFrame(files, "path string, language string, scope array<string>, content binary, message string, content_hash string")
    return tree.extractions(read)


@fixed
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark).select(F.col("language").alias("lang"), F.explode("nodes").alias("n"))
    return rows.where("n.kind <> 'file'").select("lang", "n.kind", "n.qualified_name", "n.start_line", "n.end_line", "n.signature", "n.docstring")


@fixed
def extracted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracted(spark).select(F.col("language").alias("lang"), F.explode("references").alias("r"))
    return rows.select("lang", "r.kind", F.array_join("r.path", "::").alias("path"), "r.qualifier", F.col("r.start_line").alias("line"))


@fixed
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.createDataFrame(
        [("a.rs", "rust", ["c"], bytearray(b"fn a( {"), None, "1"), ("b.rs", "rust", ["c"], bytearray(b"fn b() {}"), None, "2"), ("c.py", "python", ["c"], bytearray(b"def broken(:\n"), None, "3"), ("d.py", "python", ["d"], None, "unreadable", None), ("e.txt", None, [], bytearray(b"x"), None, "5")],
        "path string, language string, scope array<string>, content binary, message string, content_hash string",
    )
    return tree.extractions(read).select("path", "parse_status", "message", F.size("nodes").cast("long").alias("nodes"))


@fixed
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.language_support(spark).groupBy("language").agg(F.array_join(F.sort_array(F.collect_list("extension")), ",").alias("extensions"))


# source trees and their index
def _tree(spark: SparkSession, name: str, more: dict[str, str] | None = None) -> str:
    root = _folder(spark, name)
    for path, body in (TREE | (more or {})).items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(body)
    return root


@fixed
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tree.contents(tree.files(spark, _tree(spark, "tree_files")), _folder(spark, "tree_files"))
    return read.select("path", "language", F.array_join("scope", "::").alias("scope"), "content_hash")


def _indexed(spark: SparkSession, name: str = "project") -> tuple[dict, project.ProjectIndex]:
    """The tree's index; built by the first query that asks, found unchanged by the others."""
    root = _tree(spark, name)
    return project.index_project(spark, root), project.ProjectIndex(spark, root)


@fixed
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = _indexed(spark)
    return spark.createDataFrame([(k, int(stats[k])) for k in ("files", "failed", "partial", "symbols", "unresolved", "skipped")], "name string, n long")


@fixed
def index_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    return index.graph.elements.select("stable_key", "kind", "qualified_name")


@fixed
def index_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    e = index.graph.elements
    a, b = (e.select(F.col("id").alias(f"{end}_id"), F.concat_ws(" ", "kind", "qualified_name").alias(end)) for end in ("source", "target"))
    return index.graph.relations.join(a, "source_id").join(b, "target_id").select("source", "kind", "target", "resolution", "site_line")


@fixed
def index_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    named = index.graph.incidences.join(index.graph.elements.select(F.col("id").alias("element_id"), F.col("qualified_name").alias("member"), F.col("kind").alias("of")), "element_id")
    per = named.groupBy("relation_id", "kind").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "role", "of", "member"))), ", ").alias("participants"))
    return per.select("kind", "participants")


@fixed
def index_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of symbols after one file was edited: ids that stayed are the same ids."""
    _, index = _indexed(spark, "index_again")
    before = cut(index.graph.elements.select("stable_key", F.col("id").alias("old_id")))
    root = _tree(spark, "index_again", {"crates/b/src/lib.rs": "pub fn bar() {}\npub struct S;\npub fn fresh() {}\n"})
    project.index_project(spark, root)
    after = index.graph.elements.select("stable_key", "id")
    both = before.join(after, "stable_key", "full_outer")
    state = F.when(F.col("id").isNull(), "pruned").when(F.col("old_id").isNull(), "minted").when(F.col("id") == F.col("old_id"), "kept").otherwise("changed")
    return both.select("stable_key", state.alias("state"))


@fixed
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    found = index.call_graph("a_one::start", "outgoing", 2, 1).unionByName(index.call_graph("b::bar", "incoming", 1, 10))
    return found.join(index.graph.elements, "id").select("depth", "qualified_name")


@fixed
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    report = index.context("start bar", max_bytes=2000)
    return spark.createDataFrame([(i, f["path"], f["text"]) for i, f in enumerate(report["files"])], "position int, path string, text string")


@fixed
def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    return index.query_expanded("MATCH ELEMENTS HAS LABEL function").select("kind", "name", "qualified_name", "file_path", "start_line")


@fixed
def expanded_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    return index.query_expanded("MATCH RELATIONS TYPE calls").select("kind", "source", "target", "resolution", "site_line", "site_text")


@fixed
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _indexed(spark)
    return index.call_edges("a_one::start", "both", 2, 10).select("source", "target", "depth", "resolution")


@fixed
def described_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _indexed(spark)[1].describe_symbol("name:start")
    return spark.createDataFrame([tuple(one[c] for c in ("kind", "qualified_name", "signature", "docstring", "start_line", "end_line"))], "kind string, qualified_name string, signature string, docstring string, start_line long, end_line long")


@fixed
def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["a.rs", "b.liquid", "c.hxx", "d.txt", "e/f.dpr", "noext", "x.tar.mm", ".liquid", "g.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", tree.unsupported(F.col("path")).alias("unsupported"))


@fixed
def ambiguous_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of selectors that should name one symbol."""
    w = Warehouse(spark, sf_dir)
    out = []
    for q in ("NATION_3", "name:NATION_3", "name:red widget", "file:src/ASIA/mod.rs:2", "element:x"):
        try:
            out.append((q, search.the_one(w.elements(), q).first()["id"], None))
        except search.NotOne as e:
            out.append((q, None, len(e.candidates)))
    return spark.createDataFrame(out, "selector string, id long, candidates long")


@fixed
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored twice: keys keep their ids, those that are gone go, new ones get the next."""
    store = reconcile.Store(spark, _folder(spark, "store_versions"))
    frame = lambda keys: spark.createDataFrame([(k, len(k) if k != "bb" else None) for k in keys], "key string, size long")
    reconcile.upsert(store, {"t": (frame(["a", "bb", "ccc"]), "key")}, "one", {"rows": 3})
    first = cut(store.table("t").select("key", F.col("id").alias("first_id")))
    reconcile.upsert(store, {"t": (frame(["bb", "ccc", "dddd", "eeeee"]), "key")}, "two", {"rows": 4})
    now = store.commit()
    told = store.table("t").join(first, "key", "left").select("key", "size", (F.col("id") == F.col("first_id")).alias("kept"), (F.col("id") > 3).alias("after_all"))
    return told.withColumn("digest", F.lit(now["digest"])).withColumn("seq", F.lit(now["seq"]).cast("long"))


# traces
def _events(w: Warehouse) -> DataFrame:
    """Two lines for each event of the table, as an agent's run would have them: a command started, and the same one completed; some never end."""
    kind = F.col("event_type")
    command = F.when(kind == "view", "rg -n x src").when(kind == "click", "cat a.rs").when(kind == "signup", "bash -lc 'git grep y'").when(kind == "purchase", "A=1 /usr/bin/find .")
    start = F.col("event_id").cast("double") * 10
    item = lambda code, output: F.struct(F.col("event_id").cast("string").alias("id"), F.when(kind == "error", "mcp_tool_call").otherwise("command_execution").alias("type"), command.alias("command"), F.when(kind == "error", "explore").alias("tool"), F.lit(None).cast("string").alias("server"), F.lit(None).cast("string").alias("status"), code.cast("int").alias("exit_code"), output.cast("string").alias("aggregated_output"), F.lit(None).cast("string").alias("error"))
    usage = F.struct(*((F.floor(F.col("value") * f)).cast("long").alias(n) for n, f in (("input_tokens", 10), ("cached_input_tokens", 3), ("output_tokens", 1), ("reasoning_output_tokens", 0))))
    none = F.lit(None)
    e = w.table("events")
    begin = e.select("user_id", (F.col("event_id") * 3).alias("line"), F.lit("item.started").alias("type"), start.alias("observed_ms"), none.cast(dict(e.select(usage.alias("u")).dtypes)["u"]).alias("usage"), item(none, none).alias("item"))
    end = e.where("event_id % 11 <> 0").select("user_id", F.col("event_id") * 3 + 1, F.lit("item.completed"), start + F.floor(F.col("value")), none, item(F.col("event_id") % 3, F.lit("out")))
    turn = e.select("user_id", F.col("event_id") * 3 + 2, F.lit("turn.completed"), none, usage, none)
    return begin.union(end).union(turn)


@fixed
def run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.usage(_events(Warehouse(spark, sf_dir)), ["user_id"])
    return out.select("user_id", "input_tokens", "cached_input_tokens", "output_tokens", "non_cached_input_tokens", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@fixed
def run_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.commands(_events(Warehouse(spark, sf_dir)), ["user_id"])
    return out.select("user_id", F.col("id").cast("long").alias("event_id"), "command", "classifier", F.col("exit_code").cast("int").alias("exit_code"), "duration_ms")


@fixed
def run_command_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(Warehouse(spark, sf_dir))
    calls = runs.commands(events, ["user_id"])
    whole = events.groupBy("user_id").agg((F.max("observed_ms") - F.min("observed_ms") + 100).alias("wall_clock_ms"))
    out = runs.run_metrics(calls, whole, ["user_id"])
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("shell_commands", "indexed_cli_commands", "search_commands", "read_commands", "failed_commands", "pre_index_search_count", "tool_ms_sum", "search_ms_sum", "read_ms_p50", "read_ms_p95")))


@fixed
def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(Warehouse(spark, sf_dir)).where("item is not null").withColumn("id", F.col("item.id").cast("long"))
    return evaluation.pairing(e, ["id"], "observed_ms", F.substring_index("type", ".", -1))


@fixed
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two runs' files, numbered within each, with the times that were seen apart from them."""
    folder = f"{session_folder(spark)}/event_lines"
    for run in ("a", "b"):
        rows = [(json.dumps({"type": f"{run}.{i}", "item": {"id": str(i)}}) if i != 2 else "no json",) for i in range(4)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run={run}")
    events = traces.read_events(spark, f"{folder}/run=*/*.txt").withColumn("run_path", F.regexp_extract("run_path", "run=([ab])", 1))
    seen = spark.createDataFrame([(r, i, 100.0 * i) for r in ("a", "b") for i in range(3)], "run_path string, line long, observed_ms double")
    return traces.attach_timeline(events, seen).select("run_path", "line", "type", F.col("item.id").alias("item"), "observed_ms")


@fixed
def span_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as nested documents and read back."""
    s = Warehouse(spark, sf_dir).spans().where("span_id % 20 = 0")
    attributes = F.create_map(F.lit("suite_id"), F.lit("s"), F.lit("task_id"), F.col("event_type"), F.lit("arm"), F.col("arm"), F.lit("run_index"), (F.col("run_id") % 2).cast("string"))
    ms = F.floor(F.col("start_us") / 1000).cast("double")
    rows = s.select(F.col("span_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("event_type").alias("name"), F.when(F.col("success"), "OK").otherwise("ERROR").alias("status"), ms.alias("start_time_ms"), (ms + F.floor("duration_ms")).alias("end_time_ms"), attributes.alias("attributes"))
    rows = rows.withColumn("run_key", F.concat_ws(":", *(F.col("attributes")[k] for k in ("suite_id", "task_id", "arm", "run_index"))))
    path = f"{session_folder(spark)}/span_documents-{os.path.basename(sf_dir.rstrip('/'))}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    traces.write_spans(rows, path)
    back = traces.read_spans(spark, path)
    return back.select(F.col("id").cast("long").alias("span_id"), "name", "status", "duration_ms", "run_key", F.col("attributes")["arm"].alias("arm"))


@fixed
def task_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task file, read after a run's answer was added to it twice."""
    file = 'suite: s1\ntasks:\n  - id: a\n    question: "why?"  # note\n    expected_files: [x.rs, \'y.rs\']\n    n: 3\n'
    run = {"task_id": "a", "question": "how so", "expected_files": ["z.rs"], "expected_symbols": ["f", "g"]}
    got = traces.parse_tasks(runs.promote(runs.promote(file, run), run))
    rows = [(got["suite"], t["id"], t["question"], ",".join(t["expected_files"]), ",".join(t.get("expected_symbols", [])), t.get("n")) for t in got["tasks"]]
    return spark.createDataFrame(rows, "suite string, id string, question string, expected_files string, expected_symbols string, n long")


@fixed
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [(n, *(lambda p, h: (p, h["template"], h["question"], h["prompt"]))(*traces.render_prompt("{{name}} asks: {{ question }} {{none}}", {"name": n, "question": f"why {n}"}))) for n in ("ann", "bob")]
    return spark.createDataFrame(out, "name string, prompt string, template string, question string, prompt_hash string")


@fixed
def prompt_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Warehouse(spark, sf_dir).table("events").select((F.col("user_id") % 97).alias("task_id"), F.md5(F.concat_ws(":", F.col("user_id") % 97, F.when(F.col("value") > 99, "b").otherwise("a"))).alias("prompt_sha256"))
    return runs.prompt_conflicts(e)


@fixed
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"required_concepts": F.split(F.lit("the,queries,runs"), ","), "expected_symbols": F.when(F.col("doc_id") % 2 == 0, F.split(F.lit("And,zzzz"), ",")), "expected_files": F.array().cast("array<string>")}
    return Warehouse(spark, sf_dir).table("documents").select("doc_id", F.round(runs.keyword_score(F.col("text"), lists), 9).alias("score"))


@fixed
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    said = F.when(n % 4 == 0, F.concat(F.lit('{"score": '), (n % 5 / 2).cast("string"), F.lit(', "correct": -1}'))).when(n % 4 == 1, F.concat(F.lit('well\n{"score": '), (n % 3 / 4).cast("string"), F.lit(', "reason": "r"}'))).when(n % 4 == 2, F.lit('a {"x": 1} b {"refusal_ok": 0.5} c')).otherwise(F.lit("no verdict"))
    v = runs.verdict(said, n % 4 == 2)
    return Warehouse(spark, sf_dir).table("documents").select("doc_id", v["score"].alias("score"), v["correct"].alias("correct"), v["refusal_ok"].alias("refusal_ok"), v["reason"].alias("reason"))


@fixed
def cross_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = Warehouse(spark, sf_dir).spans().groupBy("arm").agg(evaluation.median("duration_ms").alias("duration_ms"), F.count("*").cast("double").alias("calls"), F.lit(0.0).alias("zero"))
    out = runs.cross_tool(medians, "arm", "arm1", "arm0", ["duration_ms", "calls", "zero"])
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("base", "treatment", "reduction_pct")))


@fixed
def run_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Warehouse(spark, sf_dir).spans().groupBy("run_id").agg(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"), F.sum(F.when(F.col("event_type") != "view", 1).otherwise(0)).alias("others"))
    return s.select("run_id", F.round(evaluation.share(F.col("clicks"), F.col("others")), 6).alias("share"))


# texts
@fixed
def symbol_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, previews, paths and places, as an index makes them from a symbol's text."""
    d, t = Warehouse(spark, sf_dir).table("documents"), F.col("text")
    head = F.regexp_replace(t, r"[^\x20-\x7E\n]", "")
    return d.select(
        "doc_id",
        text.signature(head).alias("signature"),
        F.length(text.preview(head)).cast("long").alias("preview_chars"),
        text.qualify(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.col("doc_id").cast("string")).alias("qualified"),
        F.array_join(text.clean_path(F.concat(F.lit("r#a :: "), F.col("lang"), F.lit("!.b;"))), "/").alias("path"),
        text.location(F.col("source"), F.col("doc_id"), F.lit(1), F.col("doc_id") + 2, F.lit(9)).alias("location"),
    )


@fixed
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a search as its lines."""
    found = [r.asDict() for r in search.search_symbols(Warehouse(spark, sf_dir).elements(), "Customer order urgent", 10).collect()]
    lines = texts.search_text("Customer order urgent", found).rstrip("\n").split("\n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(x for x in lines if not x.startswith("  "))], "n int, line string")


@fixed
def skeleton_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "\n".join(f"line {i}" for i in range(1, 301))
    return spark.createDataFrame([("long", context.skeleton(body, "a.rs", [(10, 12), (18, 18), (100, 101)], 5000)), ("short", context.skeleton("x\ny ", "b.rs", [(1, 1)], 5000)), ("cut", context.skeleton(body, "c.rs", [(10, 200)], 60))], "name string, text string")


# architecture
@fixed
def container_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Warehouse(spark, sf_dir).elements()
    files = e.select(F.concat(F.lit("file:"), "file_path").alias("stable_key"), F.regexp_replace(F.regexp_replace("file_path", r"^(src|tests)/|\.rs$|/mod\.rs$", ""), "/", "::").alias("qualified_name"), "file_path").distinct()
    return resolve.container_spine(files)[0].select("key", "qualified_name", "kind")


@fixed
def id_minting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How new ids were given: as many as new keys, each once, right after the largest stored one."""
    c = Warehouse(spark, sf_dir).table("customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("id"))
    old, new = c.where("id % 7 <> 0"), c.where("id % 5 <> 0").select("key")
    minted = reconcile.carry_ids(old, new, "key").join(old.select("key"), "key", "left_anti")
    return minted.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@fixed
def project_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Warehouse(spark, sf_dir).table("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return reconcile.digest(files)


@fixed
def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.candidates(Warehouse(spark, sf_dir).graph(), "order urgent Customer", 4).select("id", "rank", F.round("pagerank", 9).alias("pagerank"))


@fixed
def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are queries of the language, and what they are read as."""
    said = ["MATCH ELEMENTS", "match elements has label struct", "MATCH RELATIONS TYPE calls", "CATALOG", "GRAPH calls WALK FROM 1 DEPTH 2", "who calls main", ""]
    rows = []
    for q in said:
        try:
            rows.append((q, language.is_structured(q), language.parse(q).form))
        except language.QueryError:
            rows.append((q, language.is_structured(q), None))
    return spark.createDataFrame(rows, "query string, structured boolean, form string")
