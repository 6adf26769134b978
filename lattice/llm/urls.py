"""URL rules through a cascade of Bloom filters; DataFrame functions only."""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import cut

#: Hashes of a key; bits for each key of a level; keys that a level may hold, which bounds the literals in a plan: beyond it, keys are split by hash.
HASHES, BITS, MOST_KEYS = 4, 12, 4_000_000


class TooManyKeys(Exception):
    """A level of a cascade has more keys than a plan should carry."""

    def __init__(self, keys: int) -> None:
        super().__init__(f"a level of {keys} keys")
        self.keys = keys


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _has(bits: bytes, key: Column, level: int) -> Column:
    """Whether the filter may hold the key."""
    out = F.lit(True)
    for p in _places(key, level, len(bits) * 8):
        byte = F.conv(F.hex(F.substring(F.lit(bits), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.floor(byte / F.pow(F.lit(2), (p % 8))) % 2 == 1)
    return out


def _filter(keys: DataFrame, n: int, level: int) -> bytes:
    """The bits of all keys, gathered in words of 64."""
    size = max(64, 1 << math.ceil(math.log2(n * BITS / 8)))
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level, size * 8))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    held = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("word"))
    out = bytearray(size)
    for row in held.collect():  # at most MOST_KEYS * BITS bits, twice that when rounded up
        out[row["at"] * 8 : row["at"] * 8 + 8] = row["word"].to_bytes(8, "little", signed=True)
    return bytes(out)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[bytes, ...]

    def has(self, key: Column) -> Column:
        """Exact for the listed keys and for all of the universe: the first level that lacks the key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~_has(self.levels[i], key, i), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, most_keys: int | None = None) -> Cascade:
    """Filters in turn for the listed keys and for the false positives of the last filter, until there are none.

    listed and universe have a column key; null keys are left out, and keys that repeat count once. The lists shrink by a constant factor with each level. Raises TooManyKeys where a level has more than most_keys; split_cascades then builds one cascade for each part of the keys."""
    listed = listed.select("key").where("key is not null").distinct()
    others = universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti")
    sides, levels = [listed, others], []
    while n := sides[len(levels) % 2].count():
        if n > (most_keys or MOST_KEYS):
            raise TooManyKeys(n)
        level = len(levels)
        levels.append(_filter(sides[level % 2], n, level))
        sides[1 - level % 2] = sides[1 - level % 2].where(_has(levels[-1], F.col("key"), level))
    return Cascade(tuple(levels))


def part_of(key: Column, parts: int) -> Column:
    """The part of the keys that a key belongs to; its hash is none of those that filters use."""
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))


def split_cascades(listed: DataFrame, universe: DataFrame, parts: int = 1, most_keys: int | None = None) -> tuple[int, Iterator[Cascade]]:
    """The number of parts, and the cascade of each in turn: as many parts as it takes for every level to hold at most most_keys keys."""
    while True:
        try:
            first = build_cascade(*(x.where(part_of(F.col("key"), parts) == 0) for x in (listed, universe)), most_keys)
        except TooManyKeys as e:
            parts *= max(2, -(-e.keys * 5 // (4 * (most_keys or MOST_KEYS))))
            continue

        def rest(first: Cascade = first, parts: int = parts) -> Iterator[Cascade]:
            yield first
            for i in range(1, parts):  # parts are alike by hash; the slack lets the others be a little larger than the first
                yield build_cascade(*(x.where(part_of(F.col("key"), parts) == i) for x in (listed, universe)), 2 * (most_keys or MOST_KEYS))

        return parts, rest()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ://, up to / ? # or the end, with A-Z lowered; then up to ? # or the end. Both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", most_keys: int | None = None) -> DataFrame:
    """Each url's host, path, the longest rule (host, path, "block" or "allow") that fits it, and the verdict.

    A rule's key is its host and path written together. An url has one candidate key for each number of labels and each path length among the rules. One cascade tells which of all candidates are rules, another which rules block; nothing is joined to the urls. Of fitting rules of one length, the greatest as text wins. Urls that no rule fits get `otherwise`, for they are not on the list.

    Where a level of a cascade would exceed most_keys, keys are split by hash into parts; each part has its own cascades and its own pass over the urls, cut from the one before, so that a plan never carries more than one part's bits.

    Returns (id, host, path, rule, verdict) for each row. Null urls and urls without :// have an empty host and path; urls are read whole, however long. Rows that repeat come out as often, each judged alike. A rule given twice with both verdicts blocks. An empty table, or no rules, leaves every verdict to `otherwise`. Other columns are not read, whatever their names."""
    rules = [(host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path, verdict) for host, path, verdict in rules]
    spark = df.sparkSession
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels, lengths = sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules})
    if not rules:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    keys = [F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)) for n in labels for m in lengths]
    listed = spark.createDataFrame([(h + p,) for h, p, _ in rules], "key string")
    blocking = spark.createDataFrame([(h + p,) for h, p, v in rules if v == "block"], "key string")
    universe = pages.select(F.explode(F.array(*keys)).alias("key"))
    best = "struct<n:int,rule:string,block:boolean>"
    parts, cascades = split_cascades(listed, universe, most_keys=most_keys)
    pages = pages.withColumn("best", F.lit(None).cast(best))
    for i, on_list in enumerate(cascades):
        here = (lambda k, i=i: part_of(k, parts) == i) if parts > 1 else (lambda k: F.lit(True))
        blocked = build_cascade(*(x.where(here(F.col("key"))) for x in (blocking, listed)), 2 * (most_keys or MOST_KEYS))
        found = F.array("best", *(F.when(here(k) & on_list.has(k), F.struct(F.length(k).alias("n"), k.alias("rule"), blocked.has(k).alias("block"))) for k in keys))
        pages = pages.withColumn("best", F.array_max(found))
        if parts > 1:
            pages = cut(pages)
    verdict = F.when(F.col("best").isNull(), otherwise).when(F.col("best.block"), "block").otherwise("allow")
    return pages.select("id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
