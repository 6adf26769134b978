"""Queries make what they ask for and no more, and deal it out over more tasks the more there is."""

import pytest
from pyspark.sql import functions as F

from lattice import runtime
from lattice.operators import graph
from lattice.plans import PLANS
from lattice.sources import warehouse

SF = "/root/testdata/sf0.001"


def files(df):
    return {f.rsplit("/", 1)[1].split(".")[0] for f in df.inputFiles()}


@pytest.mark.parametrize(
    ("name", "tables"),
    [
        ("label_scan", {"supplier", "nation", "region"}),
        ("property_lookup", {"part", "orders", "customer", "supplier", "nation", "region"}),
        ("sel_element", {"customer", "part", "orders", "supplier", "nation", "region"}),
        ("test_like_split", {"customer", "part", "orders", "supplier", "nation", "region"}),
        ("layer_cake", {"customer", "lineitem", "orders", "supplier", "nation", "region"}),
        ("status_counts", {"customer", "part", "orders", "supplier", "nation", "region", "lineitem"}),
    ],
)
def test_only_the_tables_asked_for(spark, monkeypatch, name, tables):
    monkeypatch.setattr(warehouse, "_stored", {})
    assert files(PLANS[name](spark, SF)) <= tables and not warehouse._stored


@pytest.mark.parametrize("name", ["nav_contains", "ambiguous_selectors"])
def test_nothing_is_stored_for_a_lookup(spark, monkeypatch, name):
    monkeypatch.setattr(warehouse, "_stored", {})
    monkeypatch.setattr(warehouse, "cut", None)  # parts aren't written
    assert PLANS[name](spark, SF).count() > 0 and not warehouse._stored


def test_more_tasks_for_more(spark, monkeypatch):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey")
    few = runtime.tasks(line)
    monkeypatch.setattr(runtime, "TASK_BYTES", 1000)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) < runtime.tasks(line)
    assert runtime.dealt(line, "l_orderkey").rdd.getNumPartitions() == runtime.tasks(line) < runtime.tasks(line.union(line))


def test_ancestors_of_many_in_few(spark):
    """Cycles, repeated ids, several containers of one element, more levels than are asked for; only containers climb, their contents are joined once."""
    edges = [(1, 10, 1), (2, 11, 1), (3, 20, 10), (4, 10, 20), (5, 30, 31), (6, 31, 32), (7, 32, 33), (8, 40, 40)]
    r = spark.createDataFrame([(i, a, b, "contains") for i, a, b in edges] + [(9, 99, 1, "calls")], "id long, source_id long, target_id long, kind string")
    ids = spark.createDataFrame([(1,), (1,), (33,), (40,), (7,)], "id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.ancestors(r, ids)) == [(1, 10, 1), (1, 20, 2), (33, 30, 3), (33, 31, 2), (33, 32, 1)]
    assert rows(graph.ancestors(r, ids, 2)) == [(1, 10, 1), (1, 20, 2), (33, 31, 2), (33, 32, 1)]
    assert rows(graph.ancestors(r, ids, 1)) == [(1, 10, 1), (33, 32, 1)]
    plan = graph.ancestors(r, ids.where(F.col("id") > 0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" not in plan
