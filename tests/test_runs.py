import json

import pytest
from pyspark.sql import functions as F

from lattice import format as texts
from lattice.operators import runs
from lattice.sources import traces

LINES = [
    {"type": "item.started", "observed_ms": 0, "item": {"id": "a", "type": "command_execution", "command": "rg x"}},
    {"type": "item.completed", "observed_ms": 100, "item": {"id": "a", "type": "command_execution", "exit_code": 0, "aggregated_output": "ok"}},
    {"type": "item.started", "observed_ms": 50, "item": {"id": "b", "type": "command_execution", "command": "cat f"}},
    {"type": "item.completed", "observed_ms": 110, "item": {"id": "b", "type": "command_execution", "exit_code": 1}},
    {"type": "item.started", "observed_ms": 160, "item": {"id": "c", "type": "mcp_tool_call", "tool": "explore"}},
    {"type": "item.completed", "observed_ms": 210, "item": {"id": "c", "type": "mcp_tool_call", "tool": "explore", "status": "completed"}},
    {"type": "turn.completed", "usage": {"input_tokens": 1000, "cached_input_tokens": 400, "output_tokens": 50}},
    {"type": "turn.completed", "usage": {"input_tokens": 100, "cached_input_tokens": 0, "output_tokens": 5}},
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("run") / "r.jsonl"
    p.write_text("\n".join(map(json.dumps, LINES)) + "\nnot json\n")
    return traces.read_events(spark, str(p)).withColumn("run", F.lit("r"))


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"type": f"{n}.{i}"}) + "\n" for i in range(5)))
    events = traces.read_events(spark, str(tmp_path))
    seen = spark.createDataFrame([(r.run_path, i, float(i)) for r in events.select("run_path").distinct().collect() for i in range(5)], "run_path string, line long, observed_ms double")
    assert {(r.type, r.line, r.observed_ms) for r in traces.attach_timeline(events, seen).collect()} == {(f"{n}.{i}", i, float(i)) for n in range(3) for i in range(5)}


def test_usage(events):
    r = runs.usage(events, ["run"]).first()
    assert (r.input_tokens, r.non_cached_input_tokens, r.total_tokens) == (1100, 700, 1155)
    assert r.cost_usd == pytest.approx((700 * 1.25 + 400 * 0.125 + 55 * 10) / 1e6)


def test_commands_and_metrics(spark, events):
    calls = runs.commands(events, ["run"])
    got = {r.id: (r.classifier, r.exit_code, r.duration_ms) for r in calls.collect()}
    assert got == {"a": ("search", 0, 100.0), "b": ("read", 1, 60.0), "c": ("indexed_cli", 0, 50.0)}
    whole = spark.createDataFrame([("r", 1000.0), ("missing", 5.0)], "run string, wall_clock_ms double")
    m = {r.run: r for r in runs.run_metrics(calls, whole, ["run"]).collect()}
    r = m["r"]
    assert (r.shell_commands, r.search_commands, r.failed_commands, r.pre_index_search_count) == (3, 1, 1, 2)
    assert (r.tool_ms_sum, r.tool_wall_union_ms, r.non_tool_wall_ms, r.tool_ms_p50, r.tool_ms_p95) == (210, 160, 840, 60, 100)
    assert m["missing"].shell_commands == 0 and m["missing"].tool_ms_sum is None


def test_a_missing_completion_gives_nulls(spark, events):
    calls = runs.commands(events.where("not (type = 'item.completed' and item.id = 'b')"), ["run"])
    r = runs.run_metrics(calls, spark.createDataFrame([("r", 1000.0)], "run string, wall_clock_ms double"), ["run"]).first()
    assert r.tool_ms_sum is None and r.tool_wall_union_ms is None and r.search_ms_sum == 100


def test_keyword_score(spark):
    df = spark.createDataFrame([("It handles queries in src/a.rs", ["query", "queries", "none"], ["a.rs"], [])], "a string, c list, f list, s list".replace("list", "array<string>"))
    got = df.select(runs.keyword_score(F.col("a"), {"required_concepts": F.col("c"), "expected_files": F.col("f"), "expected_symbols": F.col("s")})).first()[0]
    assert got == pytest.approx((1 / 3 * 0.5 + 0.2) / 0.7) or got == pytest.approx((2 / 3 * 0.5 + 0.2) / 0.7)


def test_verdict(spark):
    rows = [('{"score": 1.5, "correct": 0.5}', False), ('words\n{"score": 0.25}', False), ('x {"a":1} y {"refusal_ok": 1} z', True), ("nothing", False)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, r boolean").select(runs.verdict(F.col("t"), F.col("r"))).collect()]
    assert got[0].score == 1.0 and got[0].correct == 0.5 and got[1].score == 0.25 and got[2].refusal_ok == 1.0 and got[3] is None


def test_spans_round_trip(spark, tmp_path):
    doc = {"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "1", "name": "n", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3500000", "status": {"code": 1}, "attributes": [{"key": "task_id", "value": {"stringValue": "t"}}, {"key": "run_index", "value": {"intValue": "3"}}]}]}]}]}
    p = tmp_path / "a.json"
    p.write_text(json.dumps(doc))
    spans = traces.read_spans(spark, str(p))
    r = spans.first()
    assert (r.duration_ms, r.status, r.attributes["run_index"], r.run_key) == (2.5, "OK", "3", "t:3")
    traces.write_spans(spans, str(tmp_path / "out"))
    back = traces.read_spans(spark, str(tmp_path / "out")).first()
    assert back == r


def test_spans_of_many_runs_round_trip(spark, tmp_path):
    rows = [(str(i), None, "n", "OK", 1_700_000_000_000.0 + i, 1_700_000_000_001.0 + 3 * i, {"task_id": f"t{i % 5}"}, f"t{i % 5}") for i in range(40)]
    spans = spark.createDataFrame(rows, "id string, parent_span_id string, name string, status string, start_time_ms double, end_time_ms double, attributes map<string,string>, run_key string").coalesce(1)
    traces.write_spans(spans, str(tmp_path / "out"))
    assert {(r.id, r.duration_ms, r.run_key) for r in traces.read_spans(spark, str(tmp_path / "out")).collect()} == {(str(i), 1.0 + 2 * i, f"t{i % 5}") for i in range(40)}


def test_tasks():
    got = traces.parse_tasks("suite: s1\ntasks:\n  - id: a\n    question: \"why?\"  # note\n    expected_files: [x.rs, 'y.rs']\n    n: 3\n  - id: b\n    expected_symbols: []\n")
    assert got == {"suite": "s1", "tasks": [{"id": "a", "question": "why?", "expected_files": ["x.rs", "y.rs"], "n": 3}, {"id": "b", "expected_symbols": []}]}
    once = runs.promote("tasks:\n", {"task_id": "a", "question": "q"})
    assert runs.promote(once, {"task_id": "a", "question": "q"}) == once and "a-golden" in once
    prompt, hashes = traces.render_prompt("Q: {{question}}", {"question": "x"})
    assert prompt == "Q: x" and len(set(hashes.values())) == 3


def test_cross_tool_and_conflicts(spark):
    m = spark.createDataFrame([("none", 100.0, 0.0), ("tool", 25.0, 1.0)], "arm string, tokens double, zero double")
    got = {r.metric: r.reduction_pct for r in runs.cross_tool(m, "arm", "tool", "none", ["tokens", "zero"]).collect()}
    assert got == {"tokens": 75.0, "zero": None}
    p = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "task_id string, prompt_sha256 string")
    assert [r.task_id for r in runs.prompt_conflicts(p).collect()] == ["a"]


def test_texts():
    s = {"id": 1, "kind": "function", "qualified_name": "a::f", "file_path": "x.rs", "start_line": 3, "signature": "fn  f()", "docstring": None, "score": 5, "depth": 1}
    assert texts.search_text("q", [s]) == "function a::f [1] x.rs:3 score 5\n  signature: fn f()\n"
    assert texts.walk_text("m", "outgoing", [s]).splitlines()[1] == "  1 function a::f [1] x.rs:3"
    assert "no symbols" in texts.search_text("q", []) and "no files" in texts.files_text("q", [])
    assert texts.values_text([(1, None, "x")]) == "1\t\tx\n"
    assert "element:<id>" in texts.ambiguous_text("f", [s, s]) and "no symbol" in texts.not_found_text("f")
    assert runs.summary_markdown([{"arm": "a", "v": None, "x": 1.23456}]).splitlines()[2] == "| a | n/a | 1.23 |"
