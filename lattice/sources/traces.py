"""Run traces: JSON-lines events, nested span documents, task files; and writing spans."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One line of a run: its type, the item it is about, token usage, and when it was seen.
EVENT = "type string, observed_ms double, usage struct<input_tokens:long,cached_input_tokens:long,output_tokens:long,reasoning_output_tokens:long>, item struct<id:string,type:string,command:string,tool:string,server:string,status:string,exit_code:int,aggregated_output:string,error:string>"
#: A span document as tracing tools write it.
DOCUMENT = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>>>>>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """run_path, line, event columns; lines that are no JSON have null columns. Lines are numbered from 0 within their file, which is one run's and read as a whole."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "value"))
    return whole.select("run_path", F.col("line").cast("long").alias("line"), F.from_json("value", EVENT).alias("e")).select("run_path", "line", "e.*")


def attach_timeline(events: DataFrame, timeline: DataFrame) -> DataFrame:
    """Events with the time their line was seen; timeline: run_path, line, observed_ms."""
    return events.drop("observed_ms").join(timeline, ["run_path", "line"], "left")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """One row for each span of nested documents, attributes as a map of text. A file is one document, or has one on each line."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    documents = F.when(F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}")), lines).otherwise(F.array("value"))
    df = spark.read.text(path, wholetext=True).select(F.explode(documents).alias("d")).select(F.from_json("d", DOCUMENT).alias("d")).select("d.*")
    spans = df.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x")).select("x.*")
    pairs = F.transform("attributes", lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value")))
    attrs = F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))
    start, end = (F.col(c).cast("decimal(20,0)") / 1_000_000 for c in ("startTimeUnixNano", "endTimeUnixNano"))
    duration = F.greatest((end - start).cast("double"), F.lit(0.0))  # before doubles lose what is below a microsecond
    out = spans.select(F.col("spanId").alias("id"), F.col("parentSpanId").alias("parent_span_id"), "name", F.when(F.col("status.code") == 1, "OK").otherwise("ERROR").alias("status"), start.cast("double").alias("start_time_ms"), end.cast("double").alias("end_time_ms"), attrs.alias("attributes"), duration.alias("duration_ms"))
    return out.withColumn("run_key", F.concat_ws(":", F.col("attributes")["suite_id"], F.col("attributes")["task_id"], F.col("attributes")["arm"], F.col("attributes")["run_index"]))


def write_spans(spans: DataFrame, path: str) -> None:
    """Span rows as nested documents, one for each run."""
    attr = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    nano = lambda c: (F.col(c).cast("decimal(20,6)") * 1_000_000).cast("decimal(20,0)").cast("string")
    span = F.struct(F.col("id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", nano("start_time_ms").alias("startTimeUnixNano"), nano("end_time_ms").alias("endTimeUnixNano"), F.struct(F.when(F.col("status") == "OK", 1).otherwise(2).alias("code")).alias("status"), attr.alias("attributes"))
    runs = spans.groupBy("run_key").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    runs.select(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")).write.json(path)


def _scalar(raw: str):
    value = raw.strip()
    bare = lambda x: re.sub(r"^[\"']|[\"']$", "", x)
    if value in ("", "[]"):
        return []
    if value[0] == "[" and value[-1] == "]":
        return [bare(x.strip()) for x in value[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"-?\d+(\.\d+)?", value):
        return float(value) if "." in value else int(value)
    return bare(value)


def parse_tasks(text: str) -> dict:
    """A task file: a suite's name and a list of flat tasks with text, numbers and one-line lists."""
    out: dict = {"suite": None, "tasks": []}
    for line in text.splitlines():
        line = re.sub(r"\s+#.*$", "", line)
        top = re.fullmatch(r"suite:\s*(.+)", line)
        pair = re.fullmatch(r"\s*(-\s+)?([^:]+):\s*(.*)", line)
        if top:
            out["suite"] = _scalar(top[1])
        elif pair and line.strip() != "tasks:":
            if pair[1]:
                out["tasks"].append({})
            if out["tasks"]:
                out["tasks"][-1][pair[2].strip()] = _scalar(pair[3])
    return out


def render_prompt(template: str, values: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The prompt with {{name}} replaced, and hashes of template, question and prompt."""
    prompt = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values.get(m[1], "")), template)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return prompt, {"template": sha(template), "question": sha(values.get("question", "")), "prompt": sha(prompt)}


def stable_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)
