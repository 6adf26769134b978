"""Shared pieces: durable cuts of lineage, vectorised word and byte hashing, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.runtime import cut, release

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = (9, 10, 11, 12, 13, 32)
#: Text bytes hashed at once by a Python worker, which takes about 64 bytes of memory for each; a longer single text is taken alone.
CHUNK = 1 << 19

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


#: Bytes of a batch that a Python worker gets at once; a longer single row is taken alone.
BATCH = 4 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches bounded by bytes, not only by rows, whatever the rows hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = df.sparkSession.conf.get(key, None)
    if not have or not 0 < int("".join(c for c in have if c.isdigit()) or 0) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df.mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    """Tells rows of one id apart by their text; null and empty are told apart too."""
    return F.xxhash64(text, F.length(text))


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and the offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
LOWERED = SYMBOLS.copy()
LOWERED[65:91] = SYMBOLS[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for b in (BASE, INVERSE):
            a = np.full(n, b, dtype=U)
            a[:1] = 1
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
        if n > 4 * CHUNK:  # not kept after an unusually long text
            _powers.clear()
            return out[0], out[1]
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any stretch of a symbol sequence in constant time."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=U)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n symbols from each place on."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + U(n * 0xA0761D6478BD642F & (1 << 64) - 1))


def words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of all rows, and the first word of each row with the total after it."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = Prefix((LOWERED if lower else SYMBOLS)[raw]).of(start, end)
    return hashes, start, end, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, dtype=U)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mix(out)


#: Bits of a filter of keys: fixed, so what is broadcast never grows; and keys that it is meant for.
FILTER_BITS = 1 << 26
FILTER_KEYS = FILTER_BITS // 16


def _filter_places(keys: np.ndarray) -> np.ndarray:
    x = mix(keys.view(U))
    return np.stack([x & U(FILTER_BITS - 1), (x >> U(32)) & U(FILTER_BITS - 1)]).astype(np.int64)


#: Bytes of a block of the filter.
FILTER_BLOCK = 1 << 12


def _join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        for i, b in enumerate(batch.column(0).to_pylist()):
            new = raw[at[i] : at[i + 1]]
            held[b] = held[b] | new if b in held else new.copy()
    for b, x in held.items():
        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "bits"])


def key_filter(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]):
    """A broadcast Bloom filter of the 64-bit keys of df's rows, or None if they are more than such a filter is good for."""
    if df.count() > FILTER_KEYS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _filter_places(keys(batch)).ravel()
            np.bitwise_or.at(held, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        blocks = held.reshape(-1, FILTER_BLOCK)
        for b in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([blocks[b].tobytes()], pa.binary())], names=["block", "bits"])

    schema = "block int, bits binary"
    blocks = in_batches(in_batches(df, run, schema).repartition(16, "block"), _join_bits, schema).collect()  # FILTER_BITS at most
    bits = bytearray(FILTER_BITS // 8)
    for b, raw in blocks:
        bits[b * FILTER_BLOCK : (b + 1) * FILTER_BLOCK] = raw
    return df.sparkSession.sparkContext.broadcast(bytes(bits))


def may_have(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key in the filter, and for a few others."""
    raw, at = np.frombuffer(bits, np.uint8), _filter_places(keys)
    return ((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component: the smallest node that links (a, b) reach from each node with a link. rows: the most links there can be.

    Alternating large and small stars; every round is cut in the shared folder, and nothing but counts comes to the driver. The least neighbours are cut as well, so that a join with them can be split where one node has a large share of the edges."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % (1 << 31))).first())
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), rows)
    before = mark(edges)
    while n := before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2 * n)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), n)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").union(least.select("u", "m"))
        after = cut(small.toDF("u", "v").distinct(), 2 * n)
        release(edges, low, large, least)
        edges, last, before = after, before, mark(after)
        if before == last:
            break
    top = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return top.union(top.select("component", "component").distinct())
