"""The same rows in SQL for DuckDB."""

from __future__ import annotations

from lattice.operators.evaluation import T95
from lattice.sources import warehouse as w

E = f"e AS ({w.ELEMENTS})"
R = f"r AS ({w.CALLS} UNION ALL {w.CONTAINS})"
REFS = f"f AS ({w.REFS})"
IMPORTS = "i AS (" + w.IMPORTS.replace("FROM nation, part,", "FROM nation CROSS JOIN part CROSS JOIN") + ")"
SPANS = f"s AS ({w.SPANS.format(epoch=w.DUCKDB_EPOCH)})"
LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = lambda c: f"list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: {LOW('x')}), lambda x: length(x) > 1)))"
TEST = r"regexp_matches(file_path, '(^|/)(tests|benches|examples|fixtures|__tests__)/|_test\.(go|py)$|(^|/)test_[^/]*\.py$|\.(test|spec)\.([^/]*\.)?([jt]sx?|[mc][jt]s)$')"
KIND = "CASE kind WHEN 'function' THEN 220 WHEN 'method' THEN 220 WHEN 'trait' THEN 160 WHEN 'struct' THEN 160 WHEN 'enum' THEN 160 WHEN 'type_alias' THEN 80 WHEN 'constant' THEN 80 WHEN 'macro' THEN 80 WHEN 'module' THEN 15 WHEN 'impl_block' THEN 5 WHEN 'file' THEN 0 ELSE 30 END"
PATH = f"CASE WHEN {TEST} THEN 0 WHEN starts_with(file_path, 'src/') OR contains(file_path, '/src/') THEN 120 ELSE 60 END"


def _search(query: str, words: list[str], where: str, limit: int, columns: str) -> str:
    fields = ("name", "qualified_name", "kind", "signature", "docstring", "file_path")
    low = ", ".join(f"{LOW(f"coalesce({c}, '')")} AS l_{c}" for c in fields)
    bag = "list_concat(" + ", ".join(TERMS(c) for c in fields[:2]) + ")"
    for c in fields[2:]:
        bag = f"list_concat({bag}, {TERMS(c)})"
    hit = lambda t, c: f"(list_contains(bag, '{t}') OR contains(l_{c}, '{t}'))"
    score = f"CASE WHEN l_qualified_name = '{query.lower()}' THEN 2000 ELSE 0 END + CASE WHEN l_name = '{query.lower()}' THEN 1800 ELSE 0 END"
    score += "".join(f" + CASE WHEN {' AND '.join(hit(t, c) for t in words)} THEN {n} ELSE 0 END" for c, n in (("qualified_name", 900), ("name", 800)))
    for t in words:
        score += f" + CASE WHEN {hit(t, 'name')} THEN 160 ELSE 0 END + CASE WHEN {hit(t, 'qualified_name')} THEN 130 ELSE 0 END"
        score += "".join(f" + CASE WHEN contains(l_{c}, '{t}') THEN {n} ELSE 0 END" for c, n in (("kind", 45), ("signature", 75), ("docstring", 55), ("file_path", 20)))
    return f"""WITH {E}, b AS (SELECT *, {bag} AS bag, {low} FROM e {where}),
    p AS (SELECT *, {score} + {KIND} + {PATH} AS raw FROM b),
    q AS (SELECT *, CASE WHEN {TEST} THEN raw // 3 ELSE raw END AS cut FROM p),
    z AS (SELECT *, (CASE WHEN kind IN ('file', 'module', 'impl_block') THEN cut // 2 ELSE cut END)::BIGINT AS score FROM q)
    SELECT {columns} FROM z WHERE score > 0 ORDER BY score DESC, qualified_name, file_path, start_byte LIMIT {limit}"""


def _walk(seed: int, kinds: str, direction: str, depth: int, tail: str = "") -> str:
    out, into = f"SELECT source_id AS a, target_id AS b FROM r WHERE kind IN ({kinds})", f"SELECT target_id AS a, source_id AS b FROM r WHERE kind IN ({kinds})"
    step = {"outgoing": out, "incoming": into, "both": f"{out} UNION {into}"}[direction]
    return f"""WITH RECURSIVE {R}, g AS ({step}), v(id, depth) AS (
      SELECT {seed}::BIGINT, 0 UNION SELECT b, depth + 1 FROM v JOIN g ON a = id WHERE depth < {depth}),
    m AS (SELECT id, min(depth)::INT AS depth FROM v GROUP BY id) {tail or 'SELECT id, depth FROM m'}"""


def _limited(n: int) -> str:
    """The seed, and n others."""
    return f"SELECT id, depth FROM m WHERE depth = 0 UNION ALL SELECT * FROM (SELECT id, depth FROM m WHERE depth > 0 ORDER BY depth, id LIMIT {n}) x"


RESOLVE = f"""WITH {E}, {REFS}, {IMPORTS},
p AS (SELECT *, string_split(joined, '::') AS path, string_split(source_name, '::') AS scope FROM f WHERE source_id IN (SELECT id FROM e)),
m AS (SELECT file_path, local_name, min(joined) AS base FROM i GROUP BY 1, 2),
n AS (SELECT id, name, qualified_name, string_split(qualified_name, '::') AS parts FROM e),
h AS (
  SELECT ref_id, 0 AS tier, 0 AS depth, id FROM p JOIN n ON joined = qualified_name
  UNION ALL SELECT ref_id, 1, len(scope) - 1 - k, id FROM (SELECT *, unnest(range(1, len(scope))) AS k FROM p) x JOIN n ON concat(array_to_string(scope[1:k], '::'), '::', joined) = qualified_name
  UNION ALL SELECT ref_id, 2, 0, id FROM p JOIN m ON p.file_path = m.file_path AND path[1] = local_name JOIN n ON array_to_string(list_concat([base], path[2:]), '::') = qualified_name
  UNION ALL SELECT ref_id, 3, 0, id FROM p JOIN n ON coalesce(qualifier, CASE WHEN len(path) > 1 THEN path[len(path) - 1] END) = parts[len(parts) - 1] AND path[len(path)] = parts[len(parts)]
  UNION ALL SELECT ref_id, 4, 0, id FROM p JOIN n ON path[len(path)] = name),
b AS (SELECT DISTINCT ref_id, id, tier FROM (SELECT *, min(tier * 1000 + depth) OVER (PARTITION BY ref_id) AS low FROM h) x WHERE tier * 1000 + depth = low),
z AS (SELECT ref_id, id AS target_id, CASE WHEN count(*) OVER (PARTITION BY ref_id) > 1 THEN 'ambiguous' ELSE ['exact', 'scoped', 'import', 'receiver', 'simple'][tier + 1] END AS resolution FROM b)
"""
T_TABLE = "CASE " + " ".join(f"WHEN n - 1 <= {k} THEN {v}" for k, v in sorted(T95.items())) + " ELSE 1.96 END"

LIFT = """WITH l AS (
  SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
d AS (SELECT 2000000000 + a AS source_id, 2000000000 + b AS target_id FROM l
  UNION SELECT 1000000000 + x.n_regionkey, 1000000000 + y.n_regionkey FROM l JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey),
z AS (SELECT source_id::BIGINT AS source_id, target_id::BIGINT AS target_id FROM d WHERE source_id <> target_id)
"""

ROUNDS, SHARE = 20, "0.85::DOUBLE"  # of a ranking, as the operator's are by default


def _rounds(steps: str) -> str:
    """ROUNDS rounds from s(id, p) along steps(a, b, w), each written out once."""
    out = ", k0 AS MATERIALIZED (SELECT id, p AS k FROM s)"
    for n in range(ROUNDS):
        out += f""", m{n} AS MATERIALIZED (SELECT b AS id, sum(k * w) AS m FROM {steps} JOIN k{n} ON a = id GROUP BY b),
    k{n + 1} AS MATERIALIZED (SELECT id, sum(v) AS k FROM (SELECT id, {SHARE} * m AS v FROM m{n} UNION ALL SELECT id, p * (1 - {SHARE} * (SELECT coalesce(sum(m), 0) FROM m{n})) FROM s) x GROUP BY id)"""
    return out


_RANK = f"""WITH {R}, g AS MATERIALIZED (SELECT DISTINCT source_id AS a, target_id AS b FROM r), o AS (SELECT a, 1.0::DOUBLE / count(*) AS w FROM g GROUP BY a),
t AS MATERIALIZED (SELECT g.a, b, w FROM g JOIN o ON g.a = o.a), s AS MATERIALIZED (SELECT unnest([1000000001, 2000000002])::BIGINT AS id, 0.5::DOUBLE AS p){_rounds("t")}"""
_HYPER = f"""WITH n AS ({w.INCIDENCES}), i AS MATERIALIZED (SELECT DISTINCT element_id AS a, relation_id AS g FROM n WHERE kind = 'impl_group' AND role <> 'anchor'),
j AS MATERIALIZED (SELECT DISTINCT relation_id AS g, element_id AS b FROM n WHERE kind = 'impl_group' AND role = 'anchor'),
d AS MATERIALIZED (SELECT a, count(*) AS n FROM i GROUP BY a), c AS (SELECT g, count(*) AS n FROM j GROUP BY g),
t AS MATERIALIZED (SELECT i.a, b, sum(1.0::DOUBLE / (d.n * c.n)) AS w FROM i JOIN d ON i.a = d.a JOIN j ON i.g = j.g JOIN c ON c.g = i.g GROUP BY i.a, b),
s AS MATERIALIZED (SELECT unnest([5000000001, 5000000002])::BIGINT AS id, 0.5::DOUBLE AS p){_rounds("t")}"""

ORACLE: dict[str, str] = {
    "symbol_search_topk": _search("Customer order urgent", ["customer", "order", "urgent"], "", 50, "id, score, qualified_name"),
    "symbol_search_kinds": _search("order Nation 7", ["nation", "order"], "WHERE kind IN ('module', 'struct')", 40, "id, score"),
    "symbol_search_no_terms": f"WITH {E} SELECT id, 0::BIGINT AS score FROM e ORDER BY qualified_name, file_path, start_byte LIMIT 25",
    "status_counts": f"""WITH {E}, {R}, n AS ({w.INCIDENCES}) SELECT (SELECT count(*) FROM e) AS elements, 0::BIGINT AS unresolved, (SELECT count(*) FROM e WHERE kind = 'function') AS functions,
      (SELECT count(DISTINCT file_path) FROM e) AS files, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM r WHERE kind = 'calls') AS calls, (SELECT count(*) FROM n) AS incidences""",
    "index_graph": f"""WITH {E}, {R}, {REFS}, {IMPORTS}, n AS ({w.INCIDENCES}) SELECT 'elements' AS part, (SELECT count(*) FROM e) AS n UNION ALL SELECT 'relations', (SELECT count(*) FROM r)
      UNION ALL SELECT 'incidences', (SELECT count(*) FROM n) UNION ALL SELECT 'refs', (SELECT count(*) FROM f) UNION ALL SELECT 'imports', (SELECT count(*) FROM i)""",
    "catalog": "SELECT * FROM (VALUES ('roles', 6::BIGINT), ('labels', 18), ('relation_types', 10), ('property_keys', 35), ('projections', 10), ('indexes', 9)) t(name, number)",
    "label_scan": f"WITH {E} SELECT id FROM e WHERE kind = 'struct'",
    "property_lookup": f"WITH {E} SELECT id FROM e WHERE name = 'small ring'",
    "relations_by_type": f"WITH {R} SELECT kind, count(*) AS n, count(DISTINCT source_id) AS sources FROM r GROUP BY kind",
    "adjacency_capped": f"WITH {R}, x AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY id)::INT AS n FROM r WHERE kind = 'calls') SELECT * FROM x WHERE n <= 3",
    "search_terms": f"SELECT doc_id, array_to_string({TERMS('text')}, ' ') AS terms FROM documents",
    "script_blocks": "SELECT page_id, len(x)::BIGINT AS blocks, array_to_string(x, '|') AS scripts FROM (SELECT page_id, regexp_extract_all(html, '<script>(.*?)</script>', 1, 's') AS x FROM pages) t",
    "file_search": f"""WITH {E}, t AS (SELECT file_path, unnest(list_concat({TERMS('name')}, {TERMS('qualified_name')})) AS t FROM e), b AS (SELECT file_path, list(DISTINCT t) AS bag FROM t GROUP BY 1),
      g AS (SELECT file_path, count(*) AS symbol_count, list_sort(list(DISTINCT qualified_name))[1:8] AS top FROM e GROUP BY 1),
      p AS (SELECT g.*, bag, {TERMS('g.file_path')} AS own, {LOW('g.file_path')} AS low, {PATH.replace('file_path', 'g.file_path')} AS raw FROM g JOIN b ON g.file_path = b.file_path),
      z AS (SELECT file_path, (raw {"".join(f" + CASE WHEN list_contains(own, '{t}') THEN 160 ELSE 0 END + CASE WHEN contains(low, '{t}') THEN 100 ELSE 0 END + CASE WHEN list_contains(bag, '{t}') THEN 80 ELSE 0 END" for t in ("brand", "orders", "parts"))})::BIGINT AS score, symbol_count, array_to_string(top, ',') AS top FROM p)
      SELECT * FROM z WHERE score > 0 ORDER BY score DESC, file_path LIMIT 50""",
    "test_like_split": f"WITH {E} SELECT {TEST} AS is_test, kind, count(*) AS n FROM e GROUP BY 1, 2",
    "preview_signature": r"""SELECT doc_id, nullif(substr(trim(trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', '', 'g'), '\s+', ' ', 'g'))), 1, 300), '') AS signature,
      substr(array_to_string(string_split(text, chr(10))[1:24], chr(10)), 1, 1200) AS preview FROM documents""",
    "qualify_names": f"""WITH {E}, x AS (SELECT *, string_split(qualified_name, '::') AS p FROM e) SELECT id, (len(p) - 1)::BIGINT AS depth, array_to_string(p[1:len(p) - 1], '::') AS scope, p[len(p)] AS last,
      concat(strlen(kind), ':', kind, strlen(name), ':', name) AS key FROM x""",
    "sel_name": f"WITH {E} SELECT id, qualified_name FROM e WHERE name = 'NATION_3'",
    "sel_qualified": f"WITH {E} SELECT id, qualified_name FROM e WHERE qualified_name = 'AMERICA::NATION_1'",
    "sel_element": f"WITH {E} SELECT id, qualified_name FROM e WHERE id = 4000000007",
    "sel_file_line": f"WITH {E} SELECT id, qualified_name FROM e WHERE file_path = 'src/NATION_2/mod.rs' AND 10 BETWEEN start_line AND end_line ORDER BY end_byte - start_byte, start_byte DESC LIMIT 1",
    "sel_ambiguous": f"WITH {E} SELECT name, count(*) AS n, min(id) AS first FROM e WHERE name = 'red widget' GROUP BY name",
    "resolve_all": RESOLVE + "SELECT resolution, count(*) AS n, count(DISTINCT ref_id) AS refs, sum(target_id % 1000)::BIGINT AS check FROM z GROUP BY 1",
    **{f"tier_{t}": RESOLVE + f"SELECT ref_id, target_id FROM z WHERE resolution = '{t}'" for t in ("exact", "scoped", "import", "receiver", "simple")},
    "unresolved": RESOLVE + "SELECT ref_id, source_id FROM p WHERE ref_id NOT IN (SELECT ref_id FROM z)",
    "lift_dependencies": LIFT + "SELECT * FROM z",
    "layer_cake": LIFT + "SELECT x.r_name AS source, y.r_name AS target FROM z JOIN region x ON source_id = 1000000000 + x.r_regionkey JOIN region y ON target_id = 1000000000 + y.r_regionkey ORDER BY 1, 2 LIMIT 32",
    "container_spine": rf"""WITH {E}, f AS (SELECT DISTINCT file_path, concat('file:', file_path) AS k, string_split(regexp_replace(file_path, '^(src|tests)/|\.rs$|/mod\.rs$', '', 'g'), '/') AS p FROM e WHERE list_contains(string_split(file_path, '/'), 'src')),
      c AS (SELECT *, unnest(range(1, len(p) + 1)) AS d FROM f), n AS (SELECT *, concat(CASE d WHEN 1 THEN 'package:' ELSE 'module:' END, array_to_string(p[1:d], '::')) AS key, concat(CASE d WHEN 2 THEN 'package:' ELSE 'module:' END, array_to_string(p[1:d - 1], '::')) AS up FROM c)
      SELECT up AS source_key, key AS target_key FROM n WHERE d > 1 UNION SELECT key, k FROM n WHERE d = len(p)""",
    "membership": f"WITH {E}, {R} SELECT source_id AS anchor_id, count(DISTINCT target_id) AS size, array_to_string(list_sort(list(DISTINCT target_id)), ',') AS members FROM r JOIN e ON source_id = e.id WHERE r.kind = 'contains' AND e.kind IN ('package', 'module') GROUP BY 1",
    "impl_groups": f"WITH n AS ({w.INCIDENCES}) SELECT relation_id, count(*) AS size, array_to_string(list_transform(list_sort(list(DISTINCT {{'role': role, 'id': element_id}})), lambda x: concat(x.role, ':', x.id)), ',') AS participants FROM n WHERE kind = 'impl_group' GROUP BY 1 HAVING count(*) > 1",
    "walk_out": _walk(2000000003, "'contains', 'calls'", "outgoing", 3),
    "walk_in": _walk(5000000010, "'contains', 'calls'", "incoming", 4),
    "walk_both": _walk(6000000011, "'calls'", "both", 3),
    "walk_edges": _walk(6000000011, "'calls'", "both", 2, "SELECT r.id AS relation_id, source_id, target_id, greatest(x.depth, y.depth) AS depth FROM r JOIN m x ON source_id = x.id JOIN m y ON target_id = y.id WHERE kind = 'calls'"),
    "nav_contains": _walk(1000000002, "'contains'", "outgoing", 2, _limited(400)),
    "walk_query": _walk(6000000020, "'calls'", "both", 2, _limited(60)),
    "ancestors": """WITH o AS (SELECT 6000000000 + o_orderkey AS id, 4000000000 + c_custkey AS a, 2000000000 + n_nationkey AS b, 1000000000 + n_regionkey AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
      SELECT id::BIGINT AS id, a::BIGINT AS ancestor_id, 1 AS depth FROM o UNION ALL SELECT id, b, 2 FROM o UNION ALL SELECT id, c, 3 FROM o""",
    "blast_radius": f"""WITH {E}, {R}, x AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id) AS n FROM r WHERE kind = 'calls' AND target_id IN (5000000001, 5000000002)),
      c AS (SELECT source_id AS id, min(target_id - 5000000000)::INT AS rank FROM x WHERE n <= 32 GROUP BY 1)
      SELECT c.id, rank, qualified_name, {TEST} AS is_test FROM c JOIN e ON c.id = e.id ORDER BY rank, c.id LIMIT 30""",
    "context_relations": f"""WITH {R}, x AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind ORDER BY id) AS n FROM r WHERE kind = 'calls' AND source_id BETWEEN 6000000000 AND 6000000030 AND target_id BETWEEN 5000000000 AND 5000000400)
      SELECT id AS relation_id, source_id, target_id FROM x WHERE n <= 64 ORDER BY source_id, kind, id LIMIT 160""",
    "ppr_fixed_rounds": _RANK + f" SELECT id, round(k, 9) AS rank FROM k{ROUNDS}",
    "hyper_ppr": _HYPER + f" SELECT g AS id, round(sum(k / n), 9) AS rank FROM i JOIN d ON i.a = d.a JOIN k{ROUNDS} ON id = i.a GROUP BY g",
    "budget_prefix": f"""WITH {E}, f AS (SELECT file_path, min(id) AS file_rank, sum(strlen(qualified_name))::BIGINT AS bytes FROM e WHERE kind = 'struct' GROUP BY 1),
      x AS (SELECT *, sum(bytes) OVER (ORDER BY file_rank)::BIGINT AS running, row_number() OVER (ORDER BY file_rank) AS n FROM f) SELECT file_path, file_rank, bytes, running FROM x WHERE n = 1 OR running <= 900""",
    "skeleton_windows": f"""WITH {E}, s AS (SELECT file_path, greatest(start_line - 3, 1) AS low, end_line + 3 AS high FROM e WHERE kind = 'function'),
      g AS (SELECT *, max(high) OVER (PARTITION BY file_path ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT file_path, min(low) AS low, max(high) AS high FROM i GROUP BY file_path, island""",
    "reconcile_diff": "SELECT c_name AS key, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS old_id, CASE WHEN c_custkey % 7 = 0 THEN 'minted' WHEN c_custkey % 5 = 0 THEN 'pruned' ELSE 'kept' END AS state FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 <> 0",
    "id_carry_over": "SELECT c_name AS key, c_custkey AS id, c_custkey AS was, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0",
    "digest_changed": "SELECT true AS edited_differs, true AS order_irrelevant",
    "run_metrics": f"""WITH {SPANS}, g AS (SELECT run_id, count(*) AS n, bool_and(duration_ms < 99.5) AS ok, sum(duration_ms) AS t, quantile_disc(duration_ms, 0.5) AS a, quantile_disc(duration_ms, 0.95) AS b FROM s GROUP BY 1)
      SELECT run_id, n, CASE WHEN ok THEN round(t, 4) END AS total, CASE WHEN ok THEN a END AS p50, CASE WHEN ok THEN b END AS p95 FROM g""",
    "arm_medians": f"WITH {SPANS} SELECT arm, median(duration_ms) AS median_ms, count(*) AS n FROM s WHERE success GROUP BY 1",
    "t_ci": f"""WITH {SPANS}, g AS (SELECT arm, event_type, count(*) AS n, avg(duration_ms) AS mean, stddev_samp(duration_ms) AS stddev, min(duration_ms) AS min, max(duration_ms) AS max FROM s GROUP BY 1, 2)
      SELECT arm, event_type, n, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(min, 6) AS min, round(max, 6) AS max, round(({T_TABLE})::DOUBLE * stddev / sqrt(n), 6) AS ci95_half FROM g""",
    "p95_nearest_rank": f"WITH {SPANS} SELECT event_type, quantile_disc(duration_ms, 0.95) AS p95 FROM s GROUP BY 1",
    "interval_union": f"""WITH {SPANS}, g AS (SELECT run_id, start_us, end_us, max(end_us) OVER (PARTITION BY run_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM g),
      l AS (SELECT run_id, island, max(end_us) - min(start_us) AS length FROM i GROUP BY 1, 2) SELECT run_id, sum(length)::BIGINT AS union_length, count(*) AS islands FROM l GROUP BY 1""",
    "arm_compare": f"""WITH {SPANS}, g AS (SELECT arm, median(duration_ms) AS median_ms, avg(success::INT::DOUBLE) AS success_rate FROM s GROUP BY 1),
      u AS (SELECT arm, 'median_ms' AS metric, median_ms AS value FROM g UNION ALL SELECT arm, 'success_rate', success_rate FROM g), b AS (SELECT metric, value AS base_value FROM u WHERE arm = 'arm0')
      SELECT arm, u.metric, round(value, 6) AS value, round(base_value, 6) AS base_value, round(value - base_value, 6) AS delta, round((value - base_value) / nullif(base_value, 0) * 100, 6) AS pct FROM u JOIN b ON u.metric = b.metric WHERE arm <> 'arm0'""",
    "span_dedupe": f"WITH {SPANS} SELECT arm, count(*) AS n FROM s GROUP BY 1",
    "failure_buckets": f"""WITH {SPANS} SELECT CASE WHEN duration_ms < 10 THEN 'success' WHEN event_type = 'click' THEN 'ambiguous_selector' WHEN event_type = 'signup' THEN 'selector_not_found'
      WHEN event_type = 'view' THEN CASE WHEN run_id % 2 = 0 THEN 'raw_query_unsupported' ELSE 'raw_query_nl_unsupported' END ELSE 'other_failure' END AS bucket, count(*) AS n FROM s GROUP BY 1""",
    "missing_runs": f"""WITH {SPANS}, g AS (SELECT run_id, count(*) AS spans FROM s GROUP BY 1) SELECT run_id, spans, NULL::VARCHAR AS reason FROM g
      UNION ALL SELECT x, NULL, 'missing' FROM range(0, 400) t(x) WHERE x NOT IN (SELECT run_id FROM g)""",
}
