"""Ranks at their default rounds against plain Python."""

from collections import defaultdict

import pytest

from lattice.model import Graph
from lattice.operators import context
from lattice.plans import PLANS
from lattice.sources.warehouse import Warehouse

SF = "/root/testdata/sf0.001"


def ranked(weights, seeds, rounds=20):
    """Ranks by steps {src: {dst: weight}} after the rounds; what does not move returns to the seeds."""
    rank = {s: 1 / len(seeds) for s in seeds}
    for _ in range(rounds):
        moved = defaultdict(float)
        for a, r in rank.items():
            for b, w in weights.get(a, {}).items():
                moved[b] += r * w
        kept = sum(moved.values())
        rank = defaultdict(float, {b: 0.85 * m for b, m in moved.items()})
        for s in seeds:
            rank[s] += (1 - 0.85 * kept) / len(seeds)
    return rank


def hyper_ranked(incidences, seeds):
    parts, anchors = defaultdict(set), defaultdict(set)
    for edge, element, role in incidences:
        (anchors[edge] if role == "anchor" else parts[element]).add(element if role == "anchor" else edge)
    weights = defaultdict(lambda: defaultdict(float))
    for a, edges in parts.items():
        for e in edges:
            for b in anchors[e]:
                weights[a][b] += 1 / len(edges) / len(anchors[e])
    rank, out = ranked(weights, seeds), defaultdict(float)
    for a, edges in parts.items():
        for e in edges:
            if a in rank:
                out[e] += rank[a] / len(edges)
    return out


def test_ppr_runs_all_rounds(spark):
    edges = defaultdict(set)
    for r in Warehouse(spark, SF).relations().where("kind in ('calls', 'contains')").collect():
        edges[r.source_id].add(r.target_id)
    want = ranked({a: dict.fromkeys(to, 1 / len(to)) for a, to in edges.items()}, [1000000001, 2000000002])
    got = dict(PLANS["ppr_fixed_rounds"](spark, SF).collect())
    assert got == pytest.approx(want, abs=2e-9)


def test_hyper_ppr_runs_all_rounds(spark):
    inc = [(r.relation_id, r.element_id, r.role) for r in Warehouse(spark, SF).incidences().where("kind = 'impl_group'").collect()]
    assert dict(PLANS["hyper_ppr"](spark, SF).collect()) == pytest.approx(hyper_ranked(inc, [5000000001, 5000000002]), abs=2e-9)


def test_hyperedges_of_a_report_run_all_rounds(spark):
    inc = [(100 + i, i, "part") for i in range(7)] + [(100 + i, i + 1, "anchor") for i in range(7)] + [(200, 6, "part"), (200, 0, "anchor")]
    relations = spark.createDataFrame([], "id long, source_id long, target_id long, kind string")
    elements = spark.createDataFrame([], "id long")
    chosen = spark.createDataFrame([(0,), (6,)], "id long")
    got = context.hyperedges(Graph(elements, relations, None, spark.createDataFrame(inc, "relation_id long, element_id long, role string")), chosen)
    near = {e for e, x, _ in inc if x in (0, 6)}
    want = hyper_ranked([x for x in inc if x[0] in near], [0, 6])
    assert {r.relation_id: r.score for r in got.collect()} == pytest.approx({e: want[e] for e in near}, abs=1e-12)


def test_candidates_are_ranked_beyond_two_steps(spark):
    symbols = "id long, name string, qualified_name string, kind string, file_path string, start_byte long, end_byte long, start_line long, end_line long, signature string, docstring string, stable_key string"
    names = ["serve", "a", "b", "c", "d", "e", "f", "g"]
    e = spark.createDataFrame([(i, n, f"m::{n}", "function", "src/m.rs", i, i + 1, i + 1, i + 1, None, None, n) for i, n in enumerate(names)], symbols)
    calls = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 2), (2, 6)]  # symbol 7 is out of reach
    r = spark.createDataFrame([(i, a, b, "calls") for i, (a, b) in enumerate(calls)], "id long, source_id long, target_id long, kind string")
    out = defaultdict(set)
    for a, b in calls:
        out[a].add(b)
    got = {r.id: r.pagerank for r in context.candidates(Graph(e, r), "serve", 1).collect()}
    assert set(got) == set(range(7))
    assert got == pytest.approx(ranked({a: dict.fromkeys(to, 1 / len(to)) for a, to in out.items()}, [0]), abs=1e-12)


def test_relations_and_chain_of_a_selection(spark):
    w = Warehouse(spark, SF)
    chosen = {r.id for r in context.candidates(w.graph(), "order urgent Customer", 4).collect()}
    among = [r for r in w.relations().collect() if r.source_id in chosen and r.target_id in chosen]
    after = defaultdict(set)
    for r in among:
        after[r.source_id].add(r.target_id)

    def longest(n, on):
        return 1 + max((longest(m, on | {m}) for m in after[n] - on), default=0)

    chain = [r.id for r in PLANS["longest_path"](spark, SF).orderBy("position").collect()]
    assert set(chain) <= chosen and all(b in after[a] for a, b in zip(chain, chain[1:], strict=False))
    assert len(chain) == max(longest(n, {n}) for n in list(after)) > 1
    assert len(among) <= context.RELATIONS
    assert {r.relation_id for r in PLANS["context_relations_selected"](spark, SF).collect()} == {r.id for r in among if r.kind != "depends_on"}
