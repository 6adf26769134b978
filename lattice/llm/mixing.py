"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.llm.common import cut, text_key

#: Words are what these white-space bytes leave.
WORDS = r"[^\x20\x09-\x0D]+"
#: Ranges of the sampling key in which a source's sizes are summed; only the range where its budget ends is sorted.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], percent: int, epochs: int) -> DataFrame:
    """source, source_size, target for a row of each source: weights by code point order, null last; targets stop at epochs times the size, and the excess goes to the others by weight.

    Sources fill up in order of size by weight, so running sums find the water level: the first source that the level left by those before it doesn't fill. One row for each source is sorted, not the documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(epochs).cast("double")).withColumn("order", F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source"))
    every, before, here = W.partitionBy(), W.orderBy("order").rowsBetween(W.unboundedPreceding, -1), W.orderBy("order").rowsBetween(W.currentRow, W.unboundedFollowing)
    weighted = weighted.withColumn("left", F.sum("source_size").over(every) * percent / 100.0 - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("share", F.sum("weight").over(here))
    weighted = weighted.withColumn("open", F.col("left") / F.col("share") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("order").alias("o"), F.col("left").alias("l"), F.col("share").alias("s")))).over(every)
    weighted = weighted.withColumn("first", first)
    level = F.col("weight") * F.col("first.l") / F.col("first.s")
    return weighted.select("source", "source_size", F.when(F.col("first").isNull() | (F.col("order") < F.col("first.o")), F.col("cap")).otherwise(level).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from the md5 of the parts, the same on every run."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(df: DataFrame, quality: DataFrame | None = None, cycle: tuple[int, ...] = (3, 1, 2), percent: int = 150, epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document go into a mix that has percent of all words, shared among the sources by weight.

    quality: (id, weight), weights above 0; 1 for documents without a row. A source whose target is n times its size and a rest gives n whole epochs first. The rest is an Efraimidis-Spirakis sample: documents in order of -ln(u) / weight, u a hash of the id, as far as the budget goes; where it ends, one document is taken in part. Sizes are summed by source and key range first, so no task gets a whole source.

    Returns (id, source, text_key, size, source_size, target, taken): a row for each row; text_key tells rows of one id apart. A null or wordless text has size 0 and takes 0. Null is a source of its own. Ties in the key go by id; rows that are the same throughout are interchangeable. An empty table gives an empty result. Other columns are not read."""
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_key(F.col(text_col)).alias("text_key"))
    if quality is not None:
        sized = sized.join(quality.toDF("qid", "weight").groupBy("qid").agg(F.max("weight").alias("weight")), F.col("id") == F.col("qid"), "left").drop("qid")
        sized = sized.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    key = -F.log(uniform(F.col("id"), F.lit(seed))) / F.col("weight")
    keyed = cut(sized.withColumn("key", key).withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")).drop("weight"))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("held"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("held").alias("source_size")), cycle, percent, epochs)
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = F.sum("held").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn("lower", F.coalesce(before, F.lit(0)))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan = plan.withColumnRenamed("source", "of")
    # at most RANGES rows for each source
    ends = ranges.join(plan, same("source", "of")).drop("of").select(F.col("source").alias("of"), F.col("range").alias("r"), "lower", "held", "source_size", "target", "whole", "budget")
    joined = keyed.join(ends, same("source", "of") & (F.col("range") == F.col("r")))
    inner = joined.where((F.col("lower") < F.col("budget")) & (F.col("budget") < F.col("lower") + F.col("held")))
    inner = inner.withColumn("sofar", F.col("lower") + F.coalesce(F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "id", "text_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("sofar")))
    outer = joined.where((F.col("lower") >= F.col("budget")) | (F.col("budget") >= F.col("lower") + F.col("held"))).withColumn("sofar", F.col("lower"))
    whole = F.when(F.col("lower") < F.col("budget"), F.col("size")).otherwise(F.lit(0))
    out = inner.withColumn("more", part).unionByName(outer.withColumn("more", whole))
    return out.select("id", "source", "text_key", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("whole") + F.col("more")).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight): documents marked good are taken four times as readily as those marked bad."""
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("quality") == 1, F.lit(2.0)).when(F.max("quality") == 0, F.lit(0.5)).otherwise(F.lit(1.0)).alias("weight"))
