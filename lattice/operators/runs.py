"""From a run's events and spans to one row of metrics for each run, and reports over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.operators import evaluation

# US dollars for a million tokens, and the weights of a keyword score.
PRICES = {"input": 1.25, "cached": 0.125, "output": 10.0}
WEIGHTS = {"required_concepts": 0.5, "expected_symbols": 0.3, "expected_files": 0.2}


def usage(events: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and cost of the completed turns; cached input has its own price. Runs without usage have no row."""
    turns = events.where("type = 'turn.completed' and usage is not null")
    total = lambda c: F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c)
    out = turns.groupBy(*by).agg(*(total(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")))
    plain = F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0))
    cost = (plain * PRICES["input"] + F.col("cached_input_tokens") * PRICES["cached"] + F.col("output_tokens") * PRICES["output"]) / 1e6
    return out.withColumn("non_cached_input_tokens", plain).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost_usd", cost)


def commands(events: DataFrame, by: list[str]) -> DataFrame:
    """One row for each command or tool call of a run: its started and completed lines joined by id."""
    i = F.col("item")
    own = events.where(i["type"].isin("command_execution", "mcp_tool_call")).withColumn("id", F.coalesce(i["id"], F.concat_ws(":", F.col("line").cast("string"), i["command"], i["tool"])))
    started, ended = F.col("type").rlike("(?i)started|in_progress"), F.col("type").rlike("(?i)completed|failed|cancell?ed")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    broken = i["error"].isNotNull() | F.coalesce(i["status"], F.col("type")).rlike("(?i)failed|cancell?ed|error")
    out = own.groupBy(*by, "id").agg(
        F.bool_or(i["type"] == "mcp_tool_call").alias("is_tool"),
        F.min_by(F.coalesce(i["command"], i["tool"]), "line").alias("command"),
        last(i["exit_code"]).alias("code"),
        F.bool_or(broken).alias("broken"),
        last(i["aggregated_output"]).alias("output"),
        F.min(F.when(~ended, F.col("observed_ms"))).alias("start_ms"),
        F.max(F.when(~started, F.col("observed_ms"))).alias("end_ms"),
        F.min("line").alias("line"),
    )
    kind = F.when(F.col("is_tool"), "indexed_cli").otherwise(evaluation.command_class(F.col("command")))
    code = F.when(F.col("is_tool"), F.col("broken").cast("int")).otherwise(F.coalesce("code", F.lit(0)))
    return out.withColumn("classifier", kind).withColumn("exit_code", code).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).drop("code", "broken")


def run_metrics(calls: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Counts and durations of each run's commands. runs: by, wall_clock_ms. Durations are null where any was not observed, and 0 where there are none."""
    first = F.min(F.when(F.col("classifier") == "indexed_cli", F.col("start_ms"))).alias("first_indexed_ms")
    known = calls.join(calls.groupBy(*by).agg(first), by)
    kinds = ("indexed_cli", "search", "read")
    aggs = [F.count("*").alias("shell_commands"), *(F.count_if(F.col("classifier") == k).alias(f"{k}_commands") for k in kinds), F.count_if(F.col("exit_code") != 0).alias("failed_commands"), F.first("first_indexed_ms").alias("first_indexed_ms")]
    aggs.append(F.when(F.first("first_indexed_ms").isNotNull(), F.count_if(F.col("classifier").isin("search", "read") & (F.col("start_ms") < F.col("first_indexed_ms")))).alias("pre_index_search_count"))
    for k in ("tool", *kinds):
        mine = F.lit(True) if k == "tool" else F.col("classifier") == k
        ok = F.coalesce(F.bool_and(F.when(mine, F.col("duration_ms").isNotNull())), F.lit(True))
        took = F.when(mine, F.col("duration_ms"))
        aggs += [F.when(ok, F.coalesce(F.sum(took), F.lit(0.0))).alias(f"{k}_ms_sum"), *(F.when(ok, F.coalesce(_disc(took, p), F.lit(0.0))).alias(f"{k}_ms_p{int(p * 100)}") for p in (0.5, 0.95))]
    counted = known.groupBy(*by).agg(*aggs)
    union = evaluation.union_length(calls, by, "start_ms", "end_ms").select(*by, F.col("union_length").alias("tool_wall_union_ms"))
    out = runs.join(counted, by, "left").join(union, by, "left").fillna(0, ["shell_commands", *(f"{k}_commands" for k in kinds), "failed_commands"])
    out = out.withColumn("tool_wall_union_ms", F.when(F.col("tool_ms_sum").isNotNull(), F.col("tool_wall_union_ms")))
    return out.withColumn("non_tool_wall_ms", F.greatest(F.col("wall_clock_ms") - F.col("tool_wall_union_ms"), F.lit(0))).withColumn("tool_share_pct", evaluation.share(F.col("tool_wall_union_ms"), F.col("wall_clock_ms")))


def _disc(c: Column, p: float) -> Column:
    """Nearest rank among a group's values that aren't null."""
    values = F.array_sort(F.collect_list(c))  # a run's commands
    return F.get(values, F.greatest(F.ceil(F.size(values) * p) - 1, F.lit(0)).cast("int"))


def keyword_score(answer: Column, wanted: dict[str, Column]) -> Column:
    """Share of wanted terms that the answer has, weighted by list; lists that are empty give their weight to the others. Null without any terms."""
    low = F.lower(F.coalesce(answer, F.lit("")))

    def forms(t: Column) -> Column:
        many = F.when(t.endswith("ies") & (F.length(t) > 3), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        one = F.when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1))
        return low.contains(t) | F.coalesce(low.contains(many), F.lit(False)) | F.coalesce(low.contains(one), F.lit(False))

    got, weight = F.lit(0.0), F.lit(0.0)
    for name, c in wanted.items():
        terms = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
        hits = F.size(F.filter(F.transform(terms, F.lower), forms))
        n = F.size(terms)
        got = got + F.when(n > 0, hits / n * WEIGHTS[name]).otherwise(0.0)
        weight = weight + F.when(n > 0, WEIGHTS[name]).otherwise(0.0)
    return got / F.nullif(weight, F.lit(0.0))


VERDICT = "score double, correct double, complete double, grounded double, refusal_ok double, reason string"


def verdict(text: Column, refusal: Column) -> Column:
    """A judge's JSON verdict from its whole answer, its last line, or its last object; numbers cut to 0..1. Null without a score."""
    trimmed = F.trim(text)
    options = [trimmed, F.regexp_extract(trimmed, r"([^\n]*)\z", 1), F.get(F.reverse(F.regexp_extract_all(trimmed, F.lit(r"\{[^{}]*\}"), F.lit(0))), F.lit(0))]
    raw = F.coalesce(*(F.when(F.trim(o).startswith("{"), F.from_json(o, VERDICT, {"mode": "PERMISSIVE"})) for o in options))
    unit = lambda c: F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    score = F.when(refusal, F.coalesce(unit(raw["score"]), unit(raw["refusal_ok"]))).otherwise(unit(raw["score"]))
    plain = lambda n: F.when(~refusal, unit(raw[n])).alias(n)
    return F.when(score.isNotNull(), F.struct(score.alias("score"), plain("correct"), plain("complete"), plain("grounded"), F.when(refusal, F.coalesce(unit(raw["refusal_ok"]), unit(raw["score"]))).alias("refusal_ok"), F.substring(F.coalesce(raw["reason"], F.lit("")), 1, 240).alias("reason")))


def prompt_conflicts(runs: DataFrame, task: str = "task_id", prompt_hash: str = "prompt_sha256") -> DataFrame:
    """Tasks whose runs had more than one prompt."""
    return runs.groupBy(task).agg(F.count_distinct(prompt_hash).alias("prompts")).where("prompts > 1")


def cross_tool(medians: DataFrame, arm: str, treatment: str, base: str, names: list[str]) -> DataFrame:
    """How much lower, in per cent, the treatment's medians are than those of its control."""
    long = medians.unpivot([arm], names, "metric", "value")
    side = lambda a, n: long.where(F.col(arm) == a).select("metric", F.col("value").alias(n))
    both = side(base, "base").join(side(treatment, "treatment"), "metric", "left")
    return both.withColumn("reduction_pct", (1 - F.col("treatment") / F.nullif(F.col("base"), F.lit(0.0))) * 100)


def summary_markdown(rows: list[dict]) -> str:
    """A table of a few rows for people."""
    if not rows:
        return "no runs\n"
    head = list(rows[0])
    cell = lambda v: "n/a" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)]) + "\n"


def promote(tasks_text: str, run: dict) -> str:
    """A task file with a run's answer added as a golden task, once."""
    key = f"- id: {run['task_id']}-golden"
    if key in tasks_text:
        return tasks_text
    listed = lambda n: "[" + ", ".join(run.get(n, [])) + "]"
    return tasks_text.rstrip("\n") + f"\n  {key}\n    question: {run['question']}\n    required_concepts: {listed('required_concepts')}\n    expected_files: {listed('expected_files')}\n    expected_symbols: {listed('expected_symbols')}\n"
