"""Placing documents on shards through a lookup table filled by permutations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime far above the number of shards. The table is broadcast and never grows with the input.
SLOTS = 65537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard of each slot: in turn, each shard claims the next free slot of its own permutation (offset + i * skip)."""
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, and the table a slot for each")
    if any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be prime")
    marks = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(m[:8], "big") % slots for m in marks]
    skip = [int.from_bytes(m[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for m in marks]
    table, filled = [-1] * slots, 0
    while filled < slots:
        for s in range(len(shards)):
            while table[place[s]] >= 0:
                place[s] = (place[s] + skip[s]) % slots
            table[place[s]] = s
            filled += 1
            if filled == slots:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % slots).cast("int")


def shard(df: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df's rows with slot_col (int) and shard_col (a name) after the columns of df.

    A broadcast of the fixed table places every row without a shuffle. When a shard goes, few keys of other shards move. A null key counts as an empty one. Equal keys, and so repeated rows, go to one shard. No other column of df is read, however long its values. A column of df named slot_col or shard_col is replaced, even where it is the key. An empty table gives an empty result."""
    own = {c.lower() for c in df.columns}
    at, of, name = (next(n for n in (f"_{stem}{i or ''}" for i in range(len(own) + 1)) if n not in own) for stem in ("at", "of", "name"))
    table = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], f"{of} int, {name} string")
    placed = df.withColumn(at, slot(df[key_col], slots)).join(F.broadcast(table), F.col(at) == F.col(of))
    kept = [df[c] for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    return placed.select(*kept, F.col(at).alias(slot_col), F.col(name).alias(shard_col))
