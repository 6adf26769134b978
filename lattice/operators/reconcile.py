"""Incremental storage: new against stored rows by key, with ids carried over, as immutable snapshots behind one pointer."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def digest(files: DataFrame) -> DataFrame:
    """One row: a hash of all (path, content_hash) in order of path. Hashes are first gathered by path prefix, so that no task gets more than its share of long strings."""
    one = F.sha2(F.concat_ws(":", "path", F.col("content_hash").cast("string")), 256)
    part = files.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("p")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("h")))), lambda x: x["h"])), 256).alias("h"))
    return part.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])), 256).alias("digest"))


def diff(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, old_id, state: kept, minted or pruned. stored: key, id."""
    a, b = stored.select(key, F.col("id").alias("old_id")), new.select(F.col(key).alias("_new")).distinct()
    state = F.when(F.col("old_id").isNull(), "minted").when(F.col("_new").isNull(), "pruned").otherwise("kept")
    return a.join(b, F.col(key) == F.col("_new"), "full_outer").select(F.coalesce(key, "_new").alias(key), "old_id", state.alias("state"))


def carry_ids(stored: DataFrame, new: DataFrame, key: str, ranges: int = 1024) -> DataFrame:
    """new with id: the stored one of its key, or the next free ones in order of key. Numbers are given within ranges of the keys' hash and added up, so no task sees all new keys."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    joined = new.join(stored.select(key, F.col("id").alias("old_id")), key, "left")
    fresh = joined.where("old_id is null").withColumn("r", F.pmod(F.xxhash64(key), F.lit(ranges)))
    before = fresh.groupBy("r").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    minted = fresh.withColumn("n", F.row_number().over(W.partitionBy("r").orderBy(key))).join(F.broadcast(before), "r").join(F.broadcast(top))
    minted = minted.withColumn("id", F.col("top") + F.col("before") + F.col("n"))
    return joined.where("old_id is not null").withColumn("id", F.col("old_id")).drop("old_id").unionByName(minted.drop("old_id", "r", "n", "before", "top"))


class Store:
    """Snapshots of named tables under a folder; a pointer file names the current one and is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    @property
    def pointer(self) -> str:
        return os.path.join(self.root, "current.json")

    def commit(self) -> dict | None:
        """What the current snapshot was made from, or None where there is none or it can't be read."""
        try:
            with open(self.pointer) as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def table(self, name: str) -> DataFrame | None:
        now = self.commit()
        path = now and os.path.join(self.root, now["snapshot"], name)
        return self.spark.read.parquet(path) if path and os.path.isdir(path) else None

    def publish(self, tables: dict[str, DataFrame], digest_: str, stats: dict[str, int]) -> dict:
        """Write all tables, then point at them: a reader sees the old or the new snapshot, never a mixture."""
        os.makedirs(self.root, exist_ok=True)
        ignore = os.path.join(self.root, ".gitignore")
        if not os.path.exists(ignore):
            with open(ignore, "w") as f:
                f.write("*\n")
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(os.path.join(self.root, snapshot, name))
        now = {"snapshot": snapshot, "seq": ((self.commit() or {}).get("seq") or 0) + 1, "digest": digest_, "stats": stats}
        with open(f"{self.pointer}.new", "w") as f:
            json.dump(now, f)
        os.replace(f"{self.pointer}.new", self.pointer)
        return now


def upsert(store: Store, tables: dict[str, tuple[DataFrame, str]], digest_: str, stats: dict[str, int]) -> dict:
    """Publish tables (frame, key) with ids carried over from the current snapshot; rows that are gone go."""
    out = {}
    for name, (df, key) in tables.items():
        old = store.table(name)
        stored = old.select(key, "id") if old is not None else store.spark.createDataFrame([], df.select(F.col(key), F.lit(0).cast("long").alias("id")).schema)
        out[name] = carry_ids(stored, df, key)
    return store.publish(out, digest_, stats)


def fingerprint(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)
