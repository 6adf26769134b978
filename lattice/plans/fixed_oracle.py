"""What the operators on fixed inputs give, written out, and SQL for those that read the test tables."""

from __future__ import annotations

from lattice.plans import oracle
from lattice.plans.oracle import E, R, SPANS


def _quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _rows(columns: str, *rows: tuple) -> str:
    """SQL for rows written out; columns as `name TYPE, ...`."""
    named = [c.split() for c in columns.split(", ")]
    picked = ", ".join(f"{n}::{t} AS {n}" for n, t in named)
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in named)})"


SYMBOLS = (
    ("rust", "function", "c::helper", 2, 2, "pub fn helper() -> u32", "Helps."),
    ("rust", "struct", "c::Foo", 4, 4, "pub struct Foo", None),
    ("rust", "impl_block", "c::Foo", 6, 8, "impl Foo", None),
    ("rust", "method", "c::Foo::run", 7, 7, "pub fn run(&self)", None),
    ("rust", "trait", "c::Go", 10, 10, "pub trait Go", None),
    ("rust", "method", "c::Go::go", 10, 10, "fn go(&self)", None),
    ("rust", "impl_block", "c::Foo", 12, 14, "impl Go for Foo", None),
    ("rust", "method", "c::Foo::go", 13, 13, "fn go(&self)", None),
    ("rust", "enum", "c::E", 16, 16, "pub enum E", None),
    ("rust", "constant", "c::N", 17, 17, "pub const N: u32 = 1", None),
    ("rust", "type_alias", "c::T", 18, 18, "pub type T = u32", None),
    ("rust", "module", "c::inner", 19, 19, "mod inner", None),
    ("rust", "function", "c::inner::deep", 19, 19, "pub fn deep()", None),
    ("go", "function", "m::db::Helper", 4, 4, "func Helper() int", "Helper helps."),
    ("go", "struct", "m::db::Store", 6, 6, "type Store struct", None),
    ("go", "interface", "m::db::Reader", 8, 8, "type Reader interface", None),
    ("go", "method", "m::db::Store::Get", 10, 10, "func (s *Store) Get() int", None),
    ("typescript", "class", "src::app::A", 4, 8, "class A", "A class."),
    ("typescript", "method", "src::app::A::run", 5, 7, "run(x: number): void", None),
    ("typescript", "interface", "src::app::I", 10, 10, "interface I", None),
    ("typescript", "function", "src::app::entry", 12, 14, "function entry()", None),
    ("typescript", "function", "src::app::f", 16, 16, "f = (a: number)", None),
    ("typescript", "type_alias", "src::app::T", 17, 17, "type T = string", None),
    ("typescript", "enum", "src::app::E", 18, 18, "enum E", None),
    ("javascript", "class", "src::a::A", 1, 5, "class A", None),
    ("javascript", "method", "src::a::A::run", 2, 4, "run()", None),
    ("javascript", "function", "src::a::f", 6, 6, "function f()", None),
    ("python", "class", "pkg::app::A", 4, 6, "class A: def run(self): return self.step(1)", None),
    ("python", "function", "pkg::app::A::run", 5, 6, "def run(self): return self.step(1)", None),
    ("python", "function", "pkg::app::entry", 10, 11, "def entry(): return helper(1)", "Starts."),
    ("svelte", "function", "src::App::entry", 3, 3, "function entry()", None),
    ("svelte", "function", "src::App::helper", 4, 4, "function helper()", None),
    ("vue", "function", "src::App::go", 3, 3, "function go()", None),
    ("java", "class", "A::A", 1, 3, "class A", None),
    ("java", "method", "A::A::f", 2, 2, "public int f(int x)", None),
    ("java", "interface", "A::B", 4, 4, "interface B", None),
    ("java", "enum", "A::C", 5, 5, "enum C", None),
    ("c", "struct", "s::s", 1, 1, "struct s", None),
    ("c", "function", "s::f", 2, 2, "int f(int x)", None),
    ("c", "macro", "s::M", 3, 3, "#define M", None),
    ("cpp", "namespace", "s::n", 1, 3, "namespace n", None),
    ("cpp", "class", "s::n::K", 2, 2, "class K", None),
    ("cpp", "function", "s::f", 4, 4, "int f(int x)", None),
    ("csharp", "namespace", "N::N", 1, 6, "namespace N", None),
    ("csharp", "class", "N::N::A", 2, 4, "class A", None),
    ("csharp", "method", "N::N::A::F", 3, 3, "public int F()", None),
    ("csharp", "interface", "N::N::I", 5, 5, "interface I", None),
    ("ruby", "module", "a::M", 1, 7, "module M class A def run go(1) end end end", None),
    ("ruby", "class", "a::M::A", 2, 6, "class A def run go(1) end end", None),
    ("ruby", "method", "a::M::A::run", 3, 5, "def run go(1) end", None),
    ("kotlin", "class", "a::A", 1, 3, "class A", None),
    ("kotlin", "function", "a::A::f", 2, 2, "fun f()", None),
    ("kotlin", "interface", "a::I", 4, 4, "interface I", None),
    ("swift", "struct", "a::A", 1, 3, "struct A", None),
    ("swift", "function", "a::A::f", 2, 2, "func f()", None),
    ("swift", "interface", "a::P", 4, 4, "protocol P", None),
    ("php", "class", "a::A", 2, 4, "class A", None),
    ("php", "function", "a::A::f", 3, 3, "function f()", None),
    ("scala", "trait", "a::T", 1, 3, "trait T", None),
    ("scala", "function", "a::T::f", 2, 2, "def f = g(1)", None),
    ("scala", "class", "a::O", 4, 4, "object O", None),
    ("lua", "function", "a::f", 1, 3, "function f() g() end", None),
    ("luau", "function", "a::f", 1, 3, "function f() g() end", None),
    ("dart", "class", "a::A", 1, 3, "class A", None),
    ("dart", "function", "a::A::f", 2, 2, "void f()", None),
    ("dart", "enum", "a::E", 4, 4, "enum E", None),
    ("objc", "class", "a::A", 1, 4, "@interface A @end @implementation A - (void)f", None),
    ("objc", "method", "a::A::f", 4, 4, "- (void)f", None),
    ("pascal", "function", "a::F", 1, 1, "procedure F", None),
)
REFERENCES = (
    ("rust", "implements_for", "Foo", None, 6), ("rust", "implements_for", "Foo", None, 12), ("rust", "implements", "Go", None, 12), ("rust", "imports", "crate::a::Bar", "crate::a", 20), ("rust", "imports", "crate::a::b::Baz", "crate::a::b", 20), ("rust", "calls", "helper", None, 7), ("rust", "calls", "run", "Foo", 13),
    ("go", "calls", "Helper", None, 10), ("typescript", "imports", "src::util::helper", "src::util", 1), ("typescript", "calls", "helper", None, 6), ("typescript", "calls", "helper", None, 13), ("javascript", "calls", "go", None, 3), ("javascript", "calls", "run", None, 6),
    ("python", "imports", "pkg::util::helper", "pkg::util", 1), ("python", "calls", "step", "A", 6), ("python", "calls", "helper", None, 11), ("svelte", "calls", "helper", None, 3), ("vue", "calls", "run", None, 3), ("java", "calls", "g", None, 2), ("c", "calls", "g", None, 2), ("cpp", "calls", "g", None, 4), ("csharp", "calls", "G", None, 3),
    ("ruby", "calls", "go", None, 4), ("kotlin", "calls", "g", None, 2), ("swift", "calls", "g", None, 2), ("php", "calls", "g", None, 3), ("scala", "calls", "g", None, 2), ("lua", "calls", "g", None, 2), ("luau", "calls", "g", None, 2),
)
EXTENSIONS = (
    ("rust", "rs"), ("go", "go"), ("typescript", "cts,mts,ts,tsx"), ("javascript", "cjs,js,jsx,mjs"), ("svelte", "svelte"), ("vue", "vue"), ("python", "py,pyi"), ("java", "java"), ("c", "c,h"), ("cpp", "cc,cpp,cxx,hh,hpp,hxx"), ("csharp", "cs"), ("php", "php"), ("ruby", "rb"), ("swift", "swift"), ("kotlin", "kt,kts"), ("scala", "sc,scala"), ("dart", "dart"), ("lua", "lua"), ("luau", "luau"), ("objc", "m,mm"), ("pascal", "dpk,dpr,lpr,pas"),
)
_A, _B, _PY = "symbol:crates/a/src/lib.rs:function:a_one::", "symbol:crates/b/src/lib.rs:", "symbol:_tools/run.py:function:_tools::run::main#0"
_LOST = f"unresolved:{_A}start#0:calls:missing:60"
ELEMENTS = (
    ("file:_tools/__init__.py", "file", "_tools"), ("file:_tools/run.py", "file", "_tools::run"), ("file:crates/a/src/lib.rs", "file", "a_one"), ("file:crates/b/src/lib.rs", "file", "b"), ("package:a_one", "package", "a_one"), ("package:b", "package", "b"), (_PY, "function", "_tools::run::main"),
    (f"{_A}inner#0", "function", "a_one::inner"), (f"{_A}start#0", "function", "a_one::start"), (f"{_B}function:b::bar#0", "function", "b::bar"), (f"{_B}impl_block:b::S#0", "impl_block", "b::S"), (f"{_B}method:b::S::go#0", "method", "b::S::go"), (f"{_B}struct:b::S#0", "struct", "b::S"), (_LOST, "unresolved_reference", "missing"),
)
#: What a walk of the tree finds: path, language, scope, content.
FILES = (
    (".gitignore", None, ".gitignore", "*.log\nout/\n"), ("_tools/__init__.py", "python", "_tools", ""), ("_tools/run.py", "python", "_tools::run", "def main():\n    pass\n"), ("crates/a/Cargo.toml", None, "crates::a::Cargo", '[package]\nname = "a-one"\n'),
    ("crates/a/src/lib.rs", "rust", "a_one", "use b::bar;\n/// Starts.\npub fn start() { b::bar(); inner(); missing(); }\nfn inner() {}\n"), ("crates/b/Cargo.toml", None, "crates::b::Cargo", '[package]\nname = "b"\n'),
    ("crates/b/src/lib.rs", "rust", "b", "pub fn bar() {}\npub struct S;\nimpl S { pub fn go(&self) { bar(); } }\n"), ("page.liquid", None, "page", "{{ x }}"),
)
RELATIONS = (
    ("file _tools::run", "contains", "function _tools::run::main", "exact", None), ("file a_one", "contains", "function a_one::inner", "exact", None), ("file a_one", "contains", "function a_one::start", "exact", None), ("file a_one", "depends_on", "file b", "exact", None), ("file a_one", "imports", "function b::bar", "exact", 1),
    ("file b", "contains", "function b::bar", "exact", None), ("file b", "contains", "impl_block b::S", "exact", None), ("file b", "contains", "struct b::S", "exact", None), ("function a_one::start", "calls", "function a_one::inner", "scoped", 3), ("function a_one::start", "calls", "function b::bar", "exact", 3),
    ("impl_block b::S", "contains", "method b::S::go", "exact", None), ("impl_block b::S", "implements_for", "impl_block b::S", "ambiguous", 3), ("impl_block b::S", "implements_for", "struct b::S", "ambiguous", 3), ("method b::S::go", "calls", "function b::bar", "scoped", 3),
    ("package a_one", "contains", "file a_one", "exact", None), ("package a_one", "depends_on", "package b", "exact", None), ("package b", "contains", "file b", "exact", None),
)
HYPEREDGES = (
    ("impl_group", "anchor impl_block b::S, impl_type impl_block b::S, impl_type struct b::S, member method b::S::go"), ("membership", "anchor file _tools::run, member function _tools::run::main"), ("membership", "anchor file a_one, member function a_one::inner, member function a_one::start"),
    ("membership", "anchor file b, member function b::bar, member impl_block b::S, member struct b::S"), ("membership", "anchor package a_one, member file a_one"), ("membership", "anchor package b, member file b"),
)
_GONE = (f"{_B}impl_block:b::S#0", f"{_B}method:b::S::go#0")
AGAIN = (*((k, "pruned" if k in _GONE else "kept") for k, _, _ in ELEMENTS), (f"{_B}function:b::fresh#0", "minted"))
SKELETONS = (
    ("long", "// a.rs\n" + "".join(f"{n:>6}\tline {n}\n" for n in range(7, 22)) + "       ...\n" + "".join(f"{n:>6}\tline {n}\n" for n in range(97, 105))),
    ("short", "// b.rs\n     1\tx\n     2\ty\n"),
    ("cut", "// c.rs\n" + "".join(f"{n:>6}\tline {n}\n" for n in range(7, 11)) + "       ... (truncated)\n"),
)
QUERIES = (("MATCH ELEMENTS", True, "elements"), ("match elements has label struct", True, "label"), ("MATCH RELATIONS TYPE calls", True, "relations"), ("CATALOG", True, "catalog"), ("GRAPH calls WALK FROM 1 DEPTH 2", True, "walk"), ("who calls main", False, None), ("", False, None))

#: A row for each event: the command it stands for, its class, start, end and exit code; a tool call has no code of its own.
_EVENTS = """c AS (SELECT user_id, event_id, event_id * 10.0::DOUBLE AS start_ms, CASE WHEN event_id % 11 <> 0 THEN event_id * 10.0::DOUBLE + floor(value) END AS end_ms, value,
  CASE event_type WHEN 'view' THEN 'rg -n x src' WHEN 'click' THEN 'cat a.rs' WHEN 'signup' THEN 'bash -lc ''git grep y''' WHEN 'purchase' THEN 'A=1 /usr/bin/find .' ELSE 'explore' END AS command,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read' WHEN 'signup' THEN 'search' WHEN 'purchase' THEN 'search' ELSE 'indexed_cli' END AS classifier,
  CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') AND event_id % 11 <> 0 THEN event_id % 3 ELSE 0 END::INT AS exit_code FROM events)"""


def _disc(kind: str, p: float) -> str:
    return f"CASE WHEN bool_and(end_ms IS NOT NULL) FILTER (classifier = '{kind}') IS DISTINCT FROM false THEN coalesce(quantile_disc(end_ms - start_ms, {p}) FILTER (classifier = '{kind}'), 0) END::BIGINT"


_WORD = "contains(lower(text), '{0}')"
_HIT = "({0})::INT"
_CONCEPTS = f"({_HIT.format(_WORD.format('the'))} + {_HIT.format(_WORD.format('queries') + ' OR ' + _WORD.format('query') + ' OR ' + _WORD.format('querie'))} + {_HIT.format(_WORD.format('runs') + ' OR ' + _WORD.format('run'))}) / 3.0::DOUBLE"
_NAMES = f"({_HIT.format(_WORD.format('and'))} + {_HIT.format(_WORD.format('zzzz'))}) / 2.0::DOUBLE"
_SEEDS = oracle._search("order urgent Customer", ["customer", "order", "urgent"], "WHERE kind IN ('function', 'method', 'trait', 'struct', 'enum', 'type_alias', 'constant', 'macro')", 12, "id, score, qualified_name, file_path, start_byte")

FIXED_ORACLE: dict[str, str] = {
    "extracted_symbols": _rows("lang VARCHAR, kind VARCHAR, qualified_name VARCHAR, start_line BIGINT, end_line BIGINT, signature VARCHAR, docstring VARCHAR", *SYMBOLS),
    "extracted_references": _rows("lang VARCHAR, kind VARCHAR, path VARCHAR, qualifier VARCHAR, line BIGINT", *REFERENCES),
    "extraction_status": _rows("path VARCHAR, parse_status VARCHAR, message VARCHAR, nodes BIGINT", ("a.rs", "partial", None, 2), ("b.rs", "ok", None, 2), ("c.py", "partial", None, 2), ("d.py", "failed", "unreadable", 0)),
    "language_support": _rows("language VARCHAR, extensions VARCHAR", *EXTENSIONS),
    "tree_files": "SELECT path, language, scope, sha256(content) AS content_hash FROM (" + _rows("path VARCHAR, language VARCHAR, scope VARCHAR, content VARCHAR", *FILES) + ") t",
    "index_stats": _rows("name VARCHAR, n BIGINT", ("files", 4), ("failed", 0), ("partial", 0), ("symbols", 13), ("unresolved", 1), ("skipped", 1)),
    "index_symbols": _rows("stable_key VARCHAR, kind VARCHAR, qualified_name VARCHAR", *ELEMENTS),
    "index_relations": _rows("source VARCHAR, kind VARCHAR, target VARCHAR, resolution VARCHAR, site_line BIGINT", *RELATIONS),
    "index_hyperedges": _rows("kind VARCHAR, participants VARCHAR", *HYPEREDGES),
    "index_again": _rows("stable_key VARCHAR, state VARCHAR", *AGAIN),
    "call_graph": _rows("depth INT, qualified_name VARCHAR", (0, "a_one::start"), (1, "a_one::inner"), (0, "b::bar"), (1, "a_one::start"), (1, "b::S::go")),
    "query_rows": _rows("kind VARCHAR, name VARCHAR, qualified_name VARCHAR, file_path VARCHAR, start_line BIGINT", ("function", "bar", "b::bar", "crates/b/src/lib.rs", 1), ("function", "inner", "a_one::inner", "crates/a/src/lib.rs", 4), ("function", "main", "_tools::run::main", "_tools/run.py", 1), ("function", "start", "a_one::start", "crates/a/src/lib.rs", 3)),
    "expanded_relations": _rows("kind VARCHAR, source VARCHAR, target VARCHAR, resolution VARCHAR, site_line BIGINT, site_text VARCHAR", ("calls", "a_one::start", "b::bar", "exact", 3, "b::bar"), ("calls", "a_one::start", "a_one::inner", "scoped", 3, "inner"), ("calls", "b::S::go", "b::bar", "scoped", 3, "bar")),
    "call_edges": _rows("source VARCHAR, target VARCHAR, depth INT, resolution VARCHAR", ("a_one::start", "b::bar", 1, "exact"), ("a_one::start", "a_one::inner", 1, "scoped"), ("b::S::go", "b::bar", 2, "scoped")),
    "described_symbol": _rows("kind VARCHAR, qualified_name VARCHAR, signature VARCHAR, docstring VARCHAR, start_line BIGINT, end_line BIGINT", ("function", "a_one::start", "pub fn start()", "Starts.", 3, 3)),
    "unsupported_files": _rows("path VARCHAR, unsupported BOOLEAN", ("a.rs", False), ("b.liquid", True), ("c.hxx", False), ("d.txt", False), ("e/f.dpr", False), ("noext", False), ("x.tar.mm", False), (".liquid", True), ("g.py", False)),
    "ambiguous_selectors": f"""WITH {E}, p(selector) AS (VALUES ('NATION_3'), ('name:NATION_3'), ('name:red widget'), ('file:src/ASIA/mod.rs:2'), ('element:x')),
      m AS (SELECT selector, e.id FROM p LEFT JOIN e ON selector = concat('name:', name) OR selector = qualified_name OR (selector = 'file:src/ASIA/mod.rs:2' AND file_path = 'src/ASIA/mod.rs')),
      c AS (SELECT selector, count(id) AS n, min(id) AS id FROM m GROUP BY 1) SELECT selector, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n <> 1 THEN n END AS candidates FROM c""",
    "store_versions": _rows("key VARCHAR, size BIGINT, kept BOOLEAN, after_all BOOLEAN, digest VARCHAR, seq BIGINT", ("bb", None, True, False, "two", 2), ("ccc", 3, True, False, "two", 2), ("dddd", 4, None, True, "two", 2), ("eeeee", 5, None, True, "two", 2)),
    "run_usage": """SELECT user_id, i AS input_tokens, c AS cached_input_tokens, o AS output_tokens, greatest(i - c, 0) AS non_cached_input_tokens, i + o AS total_tokens, round((greatest(i - c, 0) * 1.25::DOUBLE + c * 0.125::DOUBLE + o * 10.0::DOUBLE) / 1e6, 9) AS cost_usd
      FROM (SELECT user_id, sum(floor(value * 10)::BIGINT)::BIGINT AS i, sum(floor(value * 3)::BIGINT)::BIGINT AS c, sum(floor(value)::BIGINT)::BIGINT AS o FROM events GROUP BY 1) t""",
    "run_commands": f"WITH {_EVENTS} SELECT user_id, event_id, command, classifier, exit_code, end_ms - start_ms AS duration_ms FROM c",
    "run_command_metrics": f"""WITH {_EVENTS}, f AS (SELECT user_id, min(start_ms) FILTER (classifier = 'indexed_cli') AS first FROM c GROUP BY 1)
      SELECT user_id, count(*) AS shell_commands, count(*) FILTER (classifier = 'indexed_cli') AS indexed_cli_commands, count(*) FILTER (classifier = 'search') AS search_commands, count(*) FILTER (classifier = 'read') AS read_commands, count(*) FILTER (exit_code <> 0) AS failed_commands,
      CASE WHEN any_value(first) IS NOT NULL THEN count(*) FILTER (classifier <> 'indexed_cli' AND start_ms < first) END AS pre_index_search_count, CASE WHEN bool_and(end_ms IS NOT NULL) THEN sum(end_ms - start_ms) END::BIGINT AS tool_ms_sum,
      CASE WHEN bool_and(end_ms IS NOT NULL) FILTER (classifier = 'search') IS DISTINCT FROM false THEN coalesce(sum(end_ms - start_ms) FILTER (classifier = 'search'), 0) END::BIGINT AS search_ms_sum, {_disc('read', 0.5)} AS read_ms_p50, {_disc('read', 0.95)} AS read_ms_p95
      FROM c JOIN f USING (user_id) GROUP BY user_id""",
    "event_pairs": f"WITH {_EVENTS} SELECT event_id AS id, start_ms AS started, end_ms AS completed FROM c",
    "event_lines": _rows("run_path VARCHAR, line BIGINT, type VARCHAR, item VARCHAR, observed_ms DOUBLE", *((r, i, None if i == 2 else f"{r}.{i}", None if i == 2 else str(i), 100 * i if i < 3 else None) for r in "ab" for i in range(4))),
    "span_documents": f"WITH {SPANS} SELECT span_id, event_type AS name, CASE WHEN success THEN 'OK' ELSE 'ERROR' END AS status, floor(duration_ms)::DOUBLE AS duration_ms, concat('s:', event_type, ':', arm, ':', run_id % 2) AS run_key, arm FROM s WHERE span_id % 20 = 0",
    "task_file": _rows("suite VARCHAR, id VARCHAR, question VARCHAR, expected_files VARCHAR, expected_symbols VARCHAR, n BIGINT", ("s1", "a", "why?", "x.rs,y.rs", "", 3), ("s1", "a-golden", "how so", "z.rs", "f,g", None)),
    "prompts": """SELECT name, name || ' asks: why ' || name || ' ' AS prompt, sha256('{{name}} asks: {{ question }} {{none}}') AS template, sha256('why ' || name) AS question, sha256(name || ' asks: why ' || name || ' ') AS prompt_hash FROM (VALUES ('ann'), ('bob')) t(name)""",
    "prompt_conflicts": "SELECT user_id % 97 AS task_id, count(DISTINCT value > 99) AS prompts FROM events GROUP BY 1 HAVING count(DISTINCT value > 99) > 1",
    "keyword_scores": f"SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN ({_CONCEPTS} * 0.5::DOUBLE + {_NAMES} * 0.3::DOUBLE) / 0.8::DOUBLE ELSE {_CONCEPTS} END, 9) AS score FROM documents",
    "verdicts": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN least(1.0::DOUBLE, doc_id % 5 / 2.0::DOUBLE) WHEN 1 THEN doc_id % 3 / 4.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS score, CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE END AS correct,
      CASE WHEN doc_id % 4 = 2 THEN 0.5::DOUBLE END AS refusal_ok, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN 'r' ELSE '' END AS reason FROM documents""",
    "cross_tool": f"""WITH {SPANS}, g AS (SELECT arm, median(duration_ms) AS duration_ms, count(*)::DOUBLE AS calls, 0.0::DOUBLE AS zero FROM s GROUP BY 1), u AS (UNPIVOT g ON duration_ms, calls, zero INTO NAME metric VALUE v)
      SELECT a.metric, round(a.v, 6) AS base, round(b.v, 6) AS treatment, round((1 - b.v / nullif(a.v, 0)) * 100, 6) AS reduction_pct FROM u a JOIN u b ON a.metric = b.metric AND a.arm = 'arm0' AND b.arm = 'arm1'""",
    "run_shares": f"WITH {SPANS} SELECT run_id, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type <> 'view'), 0)::DOUBLE * 100, 6) AS share FROM s GROUP BY 1",
    "symbol_texts": r"""WITH h AS (SELECT *, regexp_replace(text, '[^\x20-\x7E\n]', '', 'g') AS head FROM documents), p AS (SELECT *, regexp_replace(head, '^(\s*\n)+', '') AS body FROM h)
      SELECT doc_id, nullif(trim(substr(trim(regexp_replace(string_split(string_split(head, '{')[1], ';')[1], '\s+', ' ', 'g')), 1, 300), ''), '') AS signature, length(substr(array_to_string(string_split(body, chr(10))[1:24], chr(10)), 1, 1200)) AS preview_chars,
      concat_ws('::', lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, doc_id::VARCHAR) AS qualified, concat('a/', lang, '/b') AS path, concat(source, ':', doc_id, ':1-', doc_id + 2, ':9') AS location FROM p""",
    "search_lines": f"""WITH x AS ({oracle._search("Customer order urgent", ["customer", "order", "urgent"], "", 10, "*")})
      SELECT (row_number() OVER (ORDER BY score DESC, qualified_name, file_path, start_byte) - 1)::INT AS n, concat(kind, ' ', qualified_name, ' [', id, '] ', file_path, ':', start_line, ' score ', score) AS line FROM x""",
    "skeleton_text": _rows("name VARCHAR, text VARCHAR", *SKELETONS),
    "container_nodes": rf"""WITH {E}, f AS (SELECT DISTINCT string_split(regexp_replace(file_path, '^(src|tests)/|\.rs$|/mod\.rs$', '', 'g'), '/') AS p FROM e WHERE list_contains(string_split(file_path, '/'), 'src')), c AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM f)
      SELECT DISTINCT concat(CASE d WHEN 1 THEN 'package:' ELSE 'module:' END, array_to_string(p[1:d], '::')) AS key, array_to_string(p[1:d], '::') AS qualified_name, CASE d WHEN 1 THEN 'package' ELSE 'module' END AS kind FROM c""",
    "id_minting": "SELECT n, n AS ids, top + 1 AS low, top + n AS high FROM (SELECT count(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) AS n, max(c_custkey) FILTER (c_custkey % 7 <> 0) AS top FROM customer) t",
    "project_digest": """WITH f AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), g AS (SELECT substr(sha256(path), 1, 2) AS p, sha256(string_agg(sha256(path || ':' || h), '' ORDER BY path)) AS h FROM f GROUP BY 1)
      SELECT sha256(string_agg(h, '' ORDER BY p)) AS digest FROM g""",
    "context_candidates": f"""WITH {E}, {R}, y AS MATERIALIZED ({_SEEDS}), z AS MATERIALIZED (SELECT id FROM y ORDER BY score DESC, qualified_name, file_path, start_byte LIMIT 4), g AS MATERIALIZED (SELECT DISTINCT source_id AS a, target_id AS b FROM r WHERE kind = 'calls'),
      o AS (SELECT a, 1.0::DOUBLE / count(*) AS w FROM g GROUP BY a), t AS MATERIALIZED (SELECT g.a, b, w FROM g JOIN o ON g.a = o.a), s AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM z) AS p FROM z){oracle._rounds("t")},
      q AS (SELECT id, k, row_number() OVER (ORDER BY round(k, 12) DESC, id) AS n FROM k{oracle.ROUNDS}) SELECT id, n::INT AS rank, round(k, 9) AS pagerank FROM q WHERE n <= 40""",
    "raw_queries": _rows("query VARCHAR, structured BOOLEAN, form VARCHAR", *QUERIES),
}
_CANDIDATES = FIXED_ORACLE["context_candidates"]
FIXED_ORACLE |= {
    "context_report": f"""WITH {E}, q AS ({_CANDIDATES}), f AS (SELECT file_path, min(rank) AS file_rank, count(*) AS symbols, least(sum(greatest(end_byte - start_byte, 0)), 5000)::BIGINT AS bytes FROM e JOIN q USING (id) GROUP BY 1),
      x AS (SELECT *, sum(bytes) OVER (ORDER BY file_rank)::BIGINT AS running, row_number() OVER (ORDER BY file_rank) AS n FROM f) SELECT file_path, file_rank, symbols, bytes, running FROM x WHERE n = 1 OR running <= 20000""",
    "context_relations_selected": f"""WITH {R}, q AS MATERIALIZED ({_CANDIDATES}), x AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind ORDER BY id) AS n FROM r WHERE source_id IN (SELECT id FROM q) AND target_id IN (SELECT id FROM q))
      SELECT id AS relation_id, source_id, target_id FROM x WHERE n <= 64 ORDER BY source_id, kind, id LIMIT 160""",
    "longest_path": f"""WITH RECURSIVE {R}, q AS MATERIALIZED ({_CANDIDATES}), g AS MATERIALIZED (SELECT DISTINCT source_id AS a, target_id AS b FROM r WHERE source_id <> target_id AND source_id IN (SELECT id FROM q) AND target_id IN (SELECT id FROM q)),
      v(here, chain) AS (SELECT a, [a] FROM (SELECT DISTINCT a FROM g) z UNION ALL SELECT b, list_append(chain, b) FROM v JOIN g ON a = here WHERE NOT list_contains(chain, b)),
      best AS (SELECT chain FROM v WHERE len(chain) > 1 ORDER BY len(chain) DESC, chain LIMIT 1) SELECT (unnest(range(len(chain))))::INT AS position, unnest(chain) AS id FROM best""",
}
