import pytest
from pyspark.sql import functions as F

from lattice.functions import text
from lattice.model import NodeKind, catalog_sizes
from lattice.operators import context, evaluation, graph, language, reconcile, resolve, search


def rows(df, *c):
    return {tuple(r) for r in df.select(*c).collect()}


def test_terms(spark):
    got = spark.sql("SELECT 'HTTPServer parseURL2Foo a_b é_xy' AS q").select(text.terms(F.col("q"))).first()[0]
    assert got == ["foo", "httpserver", "parse", "url2", "xy"] == text.query_terms("HTTPServer parseURL2Foo a_b é_xy")


def element(i, name, qualified, kind="function", path="src/lib.rs", start=0, end=10, line=1, last=5):
    return (i, name, qualified, kind, path, start, end, line, last, None, None, f"k{i}")


ELEMENTS = "id long, name string, qualified_name string, kind string, file_path string, start_byte long, end_byte long, start_line long, end_line long, signature string, docstring string, stable_key string"


def test_search_keeps_symbols_without_a_hit(spark):
    e = spark.createDataFrame([element(1, "serve", "crate::serve"), element(2, "other", "crate::other"), element(3, "serve", "crate::tests::serve", path="tests/a.rs"), element(4, "t.rs", "t", "file", "tests/t.rs")], ELEMENTS)
    got = [(r.id, r.score) for r in search.search_symbols(e, "serve").collect()]
    assert [i for i, _ in got] == [1, 3, 2] and got[2][1] == 340
    assert got[1][1] == (1800 + 900 + 800 + 160 + 130 + 220 + 0) // 3
    assert [r.id for r in search.search_symbols(e, "x").collect()] == [2, 1, 3, 4]
    assert search.search_symbols(e, "serve tests").collect()[0].id == 3


def test_selectors(spark):
    e = spark.createDataFrame([element(1, "a", "m::a", start=0, end=100, line=1, last=50), element(2, "a", "n::a", start=10, end=20, line=5, last=6)], ELEMENTS)
    assert search.select_one(e, "name:a")[0] == "ambiguous"
    assert search.select_one(e, "m::a")[0] == "matched"
    assert search.select_one(e, "zzz")[0] == "not_found"
    assert [r.id for r in search.select(e, "file:src/lib.rs:5").collect()] == [2]
    for bad in ("element:x", "element:-1", "file:src/lib.rs", "file::3", "file:src/lib.rs:x", "element:99999999999999999999"):
        assert search.select(e, bad).count() == 0


REFS = "ref_id long, source_id long, source_name string, file_path string, path array<string>, qualifier string"
NAMES = "id long, name string, qualified_name string"
IMPORTS = "file_path string, local_name string, path array<string>, ref_id long"


@pytest.mark.parametrize(
    ("names", "refs", "imports", "want"),
    [
        ([(1, "caller", "crate::caller"), (2, "callee", "crate::callee")], [(1, 1, "crate::caller", "f", ["callee"], None)], [], {(2, "scoped")}),
        ([(1, "run", "crate::Foo::run"), (2, "entry", "crate::entry")], [(1, 2, "crate::entry", "f", ["run"], "Foo")], [], {(1, "receiver")}),
        ([(1, "new", "crate::A::new"), (2, "new", "crate::B::new"), (3, "e", "x::e")], [(1, 3, "x::e", "f", ["new"], None)], [], {(1, "ambiguous"), (2, "ambiguous")}),
        ([(1, "f", "crate::f")], [(1, 1, "crate::f", "f", ["f"], None)], [], {(1, "scoped")}),
        ([(1, "Bar", "src::a::Bar"), (2, "entry", "src::app::entry")], [(1, 2, "src::app::entry", "f", ["Bar"], None)], [("f", "Bar", ["src", "a", "Bar"], 0), ("f", "Bar", ["src", "b", "Bar"], 5)], {(1, "import")}),
        ([(1, "g", "c::g"), (2, "e", "c::e")], [(1, 2, "c::e", "f", ["c", "g"], None)], [], {(1, "exact")}),
        ([(1, "g", "c::g")], [(1, 1, "c::g", "f", ["nowhere"], None), (2, 9, "c::x", "f", ["g"], None), (3, 1, "c::g", "f", [], None)], [], set()),
    ],
)
def test_tiers(spark, names, refs, imports, want):
    found, lost = resolve.resolve(spark.createDataFrame(refs, REFS), spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(names, NAMES))
    assert rows(found, "target_id", "resolution") == want
    assert (lost.count() > 0) == (not want)


def test_spine_and_lift(spark):
    files = spark.createDataFrame([("file:a/src/x.rs", "a::x", "a/src/x.rs"), ("file:a/src/lib.rs", "a", "a/src/lib.rs"), ("file:b/tests/t.rs", "b::t", "b/tests/t.rs")], "stable_key string, qualified_name string, file_path string")
    nodes, edges = resolve.container_spine(files)
    assert rows(nodes, "key", "kind", "file_path") == {("package:a", "package", "a/src/lib.rs"), ("module:a::x", "module", "a/src/x.rs")}
    assert rows(edges, "source_key", "target_key") == {("package:a", "module:a::x"), ("module:a::x", "file:a/src/x.rs"), ("package:a", "file:a/src/lib.rs")}
    calls = spark.createDataFrame([(1, 2, "calls", "exact"), (1, 3, "calls", "exact"), (1, 2, "calls", "simple"), (3, 2, "contains", "exact")], "source_id long, target_id long, kind string, resolution string")
    levels = spark.createDataFrame([(1, [10, 11]), (2, [20, 21]), (3, [10, 12])], "id long, levels array<long>")
    assert rows(resolve.lift_dependencies(calls, levels), "source_id", "target_id") == {(10, 20), (11, 21), (11, 12)}


def test_walk_cycles_and_limit(spark):
    r = spark.createDataFrame([(1, 1, 2, "calls"), (2, 2, 3, "calls"), (3, 3, 1, "calls"), (4, 3, 4, "calls"), (5, 4, 5, "imports")], "id long, source_id long, target_id long, kind string")
    seed = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.walk(r, seed, ("calls",), depth=6), "id", "depth") == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert rows(graph.walk(r, seed, ("calls",), "incoming", 1), "id", "depth") == {(1, 0), (3, 1)}
    assert rows(graph.walk(r, seed, ("calls",), depth=6, limit=2), "id", "depth") == {(1, 0), (2, 1), (3, 2)}  # the seed and two others


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src long, dst long")
    got = {r.id: r["rank"] for r in graph.pagerank(edges, spark.createDataFrame([(1,)], "id long"), 40).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[1] > got[2] > got[3]
    assert graph.pagerank(edges, spark.createDataFrame([], "id long"), 2).count() == 0


def test_longest_path():
    assert graph.longest_path([(1, 2), (2, 3), (1, 3), (3, 4), (4, 2)]) == [1, 2, 3, 4]
    assert graph.longest_path([(5, 5)]) == [] == graph.longest_path([])


def test_queries():
    assert language.parse("match elements where name = 'it''s'").args == ("name", "it's")
    assert language.parse("MATCH ELEMENTS").label == "scan elements"
    assert language.parse("GRAPH calls WALK FROM 7 DEPTH 2 DIRECTION both LIMIT 9").args == ("7", "2", "both", "9")
    for bad in ("SELECT 1", "MATCH", "MATCH ELEMENTS WHERE colour = 'x'", ""):
        with pytest.raises(language.QueryError):
            language.parse(bad)
    n = language.parse_navigation("calls incoming name:f")
    assert (n.depth, n.limit) == (2, 1000)
    assert language.parse_navigation("calls both x limit 5 depth 1").limit == 5
    for bad in ("calls", "calls up x", "jumps both x", "calls both x depth", "calls both x depth one", "calls both x depth 1 depth 2"):
        with pytest.raises(language.QueryError):
            language.parse_navigation(bad)


def test_catalog():
    assert catalog_sizes() == {"roles": 6, "labels": 18, "relation_types": 10, "property_keys": 35, "projections": 10, "indexes": 9}
    assert len(NodeKind) == 17


def test_skeleton():
    body = "\n".join(f"line {i}  " for i in range(1, 301))
    out = context.skeleton(body, "a.rs", [(10, 12), (17, 18), (100, 100)], 10_000)
    assert out.startswith("// a.rs\n     7\tline 7\n") and out.count("       ...\n") == 1 and "    21\tline 21\n" in out and "    22\t" not in out
    assert context.skeleton(body, "a.rs", [(1, 300)], 60).endswith("       ... (truncated)\n")
    assert context.skeleton("x\ny", "b", [], 100) == "// b\n     1\tx\n     2\ty\n"


def test_budget(spark):
    f = spark.createDataFrame([(1, 500), (2, 10), (3, 5)], "file_rank int, bytes long")
    assert [r.file_rank for r in context.budget(f, "bytes", 100).collect()] == [1]
    assert [r.file_rank for r in context.budget(f, "bytes", 512).collect()] == [1, 2]


def test_intervals(spark):
    s = spark.createDataFrame([("r", 0, 100), ("r", 50, 110), ("r", 110, 120), ("r", 160, 200), ("q", None, 5)], "run string, a long, b long")
    assert rows(evaluation.union_length(s, ["run"], "a", "b"), "run", "union_length", "islands") == {("r", 160, 2)}


def test_spread(spark):
    s = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)] + [("y", 5.0)], "g string, v double")
    got = {r.g: r for r in evaluation.spread(s, ["g"], "v").collect()}
    assert got["x"].ci95_half == pytest.approx(3.182 * (5 / 3) ** 0.5 / 2) and got["y"].stddev is None and got["y"].ci95_half is None
    t = spark.range(0, 45).select(evaluation.t_multiplier(F.col("id")).alias("t")).collect()
    assert t[0].t is None and t[11].t == 2.179 and t[25].t == 2.042 and t[44].t == 1.96


def test_command_class(spark):
    want = {"rg x": "search", "FOO=1 env grep a": "search", "/bin/zsh -lc 'sed -n 1p f'": "read", "git grep x": "search", "git log": "other", "/usr/bin/cat f": "read", "bash -c \"find .\"": "search"}
    df = spark.createDataFrame([(k,) for k in want], "c string").select("c", evaluation.command_class(F.col("c")).alias("k"))
    assert dict(df.collect()) == want


def test_ids_are_carried(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("gone", 9)], "key string, id long")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = dict(reconcile.carry_ids(stored, new, "key").select("key", "id").collect())
    assert got["a"] == 1 and got["b"] == 2 and {got["c"], got["d"]} == {10, 11}
    assert rows(reconcile.diff(stored, new, "key"), "key", "state") == {("a", "kept"), ("b", "kept"), ("c", "minted"), ("d", "minted"), ("gone", "pruned")}


def test_store(spark, tmp_path):
    store = reconcile.Store(spark, str(tmp_path / "s"))
    assert store.commit() is None and store.table("t") is None
    store.publish({"t": spark.range(3)}, "d1", {"n": 3})
    store.publish({"t": spark.range(5)}, "d2", {"n": 5})
    assert store.commit()["seq"] == 2 and store.table("t").count() == 5
    (tmp_path / "s" / "current.json").write_text("{broken")
    assert store.commit() is None


def test_keys_are_injective(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("a", None)], "x string, y string")
    assert df.select(text.composite_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == 3


def looked_up_by_hand(names, refs, imports):
    """The tiers one by one, as the SQL has them: {ref: (targets, tier)}."""
    base = {}
    for f, local, path, i in sorted(imports, key=lambda x: (x[3], x[2])):
        base.setdefault((f, local), path)
    out = {}
    for ref, source, source_name, f, path, qualifier in refs:
        if source not in {n[0] for n in names} or not path:
            continue
        joined, scope = "::".join(path), source_name.split("::")
        whole = [[joined]] + [["::".join([*scope[:k], joined])] for k in range(len(scope) - 1, 0, -1)]
        owner = qualifier.split("::")[-1] if qualifier else path[-2] if len(path) > 1 else None
        tiers = [("exact", whole[0])] + [("scoped", w) for w in whole[1:]] + ([("import", ["::".join([*base[f, path[0]], *path[1:]])])] if (f, path[0]) in base else [])
        found = [(tier, {i for i, _, q in names if q == keys[0]}) for tier, keys in tiers]
        found.append(("receiver", {i for i, _, q in names if "::" in q and q.split("::")[-2:] == [owner, path[-1]]}))
        found.append(("simple", {i for i, n, _ in names if n == path[-1]}))
        out[ref] = next(((t, k) for k, t in found if t), (set(), None))
    return out


def test_many_symbols_of_one_name(spark):
    """Names that many symbols share, imports under another name, scopes of any depth; pairs counted without being made."""
    names = [(i, f"n{i % 3}", f"a::b{i % 5}::n{i % 3}") for i in range(40)] + [(100 + i, f"m{i}", f"p{i % 2}::q::m{i}") for i in range(9)] + [(200, "part", "x::9"), (201, "top", "top"), (202, "top", "a::top")]
    paths = [["n1"], ["b1", "n1"], ["m3"], ["q", "m3"], ["part"], ["alias"], ["alias", "m2"], ["top"], ["9"], ["none"], ["a", "b2", "n2"], ["other"]]
    imports = [("f", "alias", ["p0", "q", "m4"], 0), ("f", "alias", ["p1", "q", "m5"], 1), ("g", "other", ["a", "b1", "n0"], 0), ("f", "n1", ["a", "b0", "n0"], 2)]
    refs = [(k * 10 + j, j % 40, ["a::b0::n0", "top", "a::b3::n1::deep::er::s"][j % 3], "fg"[j % 2], p, [None, "q", "z::b4"][j % 3]) for k, p in enumerate(paths) for j in range(6)]
    want = looked_up_by_hand(names, refs, imports)
    args = spark.createDataFrame(refs, REFS), spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(names, NAMES)
    found, lost = resolve.resolve(*args)
    pairs = {(ref, i, tier if len(to) == 1 else "ambiguous") for ref, (to, tier) in want.items() for i in to}
    assert rows(found, "ref_id", "target_id", "resolution") == pairs and found.count() == len(pairs) > 0
    assert rows(lost, "ref_id") == {(ref,) for ref, (to, _) in want.items() if not to} != set()
    counts = {k: (n, r, t) for k, n, r, t in resolve.resolved_counts(*args, F.col("id") % 7).select("resolution", "n", "refs", "total").collect()}
    assert counts == {k: (len(own := [p for p in pairs if p[2] == k]), len({p[0] for p in own}), sum(p[1] % 7 for p in own)) for k in {p[2] for p in pairs}}


def test_pairs_of_a_crowded_name_are_counted_only(spark):
    """3,000 references to a name of 3,000 symbols: the lookup has one row for each reference, so no plan makes nine million."""
    names = spark.range(3000).select("id", F.lit("new").alias("name"), F.concat(F.lit("a::T"), "id", F.lit("::new")).alias("qualified_name"))
    refs = spark.range(3000).selectExpr("id AS ref_id", "id AS source_id", "'a::T' AS source_name", "'f' AS file_path", "array('new') AS path", "CAST(NULL AS STRING) AS qualifier")
    imports = spark.createDataFrame([], IMPORTS)
    assert resolve.looked_up(refs, imports, names).count() == 3000
    assert [tuple(r) for r in resolve.resolved_counts(refs, imports, names, F.lit(1)).collect()] == [("ambiguous", 9_000_000, 3000, 9_000_000)]
