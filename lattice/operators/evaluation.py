"""Metrics of runs: medians, intervals, confidence, comparison of arms, failure buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Two-sided 95 % Student t by degrees of freedom; the next larger one listed counts, beyond the table 1.96.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042}


def t_multiplier(df: Column) -> Column:
    out = F.lit(1.96)
    for k in sorted(T95, reverse=True):
        out = F.when(df <= k, T95[k]).otherwise(out)
    return F.when(df > 0, out)


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, stddev, min, max and the half width of the 95 % interval of a value by group."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.withColumn("ci95_half", t_multiplier(F.col("n") - 1) * F.col("stddev") / F.sqrt("n"))


def median(value: str) -> Column:
    return F.percentile(value, F.lit(0.5))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least p of the values not above it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def union_length(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Length of time that intervals cover together, by group; touching intervals join."""
    w = W.partitionBy(*by).orderBy(start, end)
    gap = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("reach", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col(start) > F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    islands = gap.withColumn("island", island).groupBy(*by, "island").agg((F.max(end) - F.min(start)).alias("length"))
    return islands.groupBy(*by).agg(F.sum("length").alias("union_length"), F.count("*").alias("islands"))


def duration_metrics(spans: DataFrame, by: list[str], duration: str, observed: str) -> DataFrame:
    """Sum, p50 and p95 of durations by group, all null if any span wasn't observed."""
    ok = F.bool_and(observed)
    return spans.groupBy(*by).agg(F.count("*").alias("n"), F.when(ok, F.sum(duration)).alias("total"), F.when(ok, nearest_rank(duration, 0.5)).alias("p50"), F.when(ok, nearest_rank(duration, 0.95)).alias("p95"))


def compare_arms(metrics: DataFrame, arm: str, base: str, names: list[str]) -> DataFrame:
    """Each metric of each arm against the base arm: value, base_value, delta, and per cent, null where the base is 0 or null."""
    long = metrics.unpivot([arm], names, "metric", "value")
    ground = long.where(F.col(arm) == base).select(F.col("metric").alias("m"), F.col("value").alias("base_value"))
    out = long.where(F.col(arm) != base).join(ground, F.col("metric") == F.col("m"), "left").drop("m")
    return out.withColumn("delta", F.col("value") - F.col("base_value")).withColumn("pct", F.col("delta") / F.nullif(F.col("base_value"), F.lit(0.0)) * 100)


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0)) * 100


def buckets(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "bucket")


def dedupe_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    return spans.dropDuplicates(key)


def missing_runs(expected: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """All runs, and those expected that have no row, with a reason."""
    lost = expected.join(runs, key, "left_anti").withColumn("reason", F.lit("missing"))
    return runs.withColumn("reason", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)


def pairing(events: DataFrame, by: list[str], time: str, phase: Column) -> DataFrame:
    """Started and completed events of one id as one row with first and last time."""
    return events.groupBy(*by).agg(F.min(F.when(phase == "started", F.col(time))).alias("started"), F.max(F.when(phase == "completed", F.col(time))).alias("completed"))


def classify_failure(exit_code: Column, output: Column, is_query: Column, structured: Column) -> Column:
    """The bucket of one command's outcome."""
    unsupported = is_query & output.contains("unsupported") & output.contains("profile query")
    return (
        F.when(exit_code == 0, "success")
        .when(output.contains("matched multiple symbols"), "ambiguous_selector")
        .when(output.contains("did not match any symbol"), "selector_not_found")
        .when(unsupported, F.when(structured, "raw_query_unsupported").otherwise("raw_query_nl_unsupported"))
        .otherwise("other_failure")
    )


def command_class(command: Column) -> Column:
    """What a shell command does, by its first word after assignments and env: search, read or other. A shell's -c argument counts as the command."""
    inner = F.regexp_replace(F.trim(command), r"^\S*\b(ba|z)?sh\s+-l?c\s+[\"']?", "")
    word = F.regexp_extract(inner, r"^(?:(?:\S*/)?env\s+|[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*[\"']?([^\s\"']+)", 1)
    name = F.substring_index(word, "/", -1)
    search = name.isin("rg", "grep", "find", "fd") | ((name == "git") & command.rlike(r"\bgit\s+grep\b"))
    return F.when(search, "search").when(name.isin("cat", "sed", "awk", "head", "tail", "nl", "less"), "read").otherwise("other")
