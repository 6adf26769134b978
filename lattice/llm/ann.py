"""Nearest neighbours by cosine: a block matrix join on int8 tiles with exact error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.llm.common import cut, in_batches

#: Vectors of a block, and blocks of each kind that meet in one task.
BLOCK, TOGETHER = 2048, 8
#: Pairs whose exact score is computed at once.
PAIRS = 65536


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length in blocks: ids and values as bytes."""
    held: dict[int, tuple[list, list]] = {}

    def out(n: int) -> pa.RecordBatch:
        ids, rows = (np.concatenate(x) for x in held.pop(n))
        return pa.record_batch([pa.array([n], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["dims", "ids", "data"])

    for batch in batches:
        vectors = batch.column("vector")
        sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes):
            pick = np.flatnonzero(sizes == n)
            rows = pa.compute.list_flatten(vectors.take(pa.array(pick))).to_numpy(zero_copy_only=False).reshape(len(pick), int(n))
            ids = batch.column("id").to_numpy()[pick]
            for i in range(0, len(pick), BLOCK):
                kept = held.setdefault(int(n), ([], []))
                kept[0].append(ids[i : i + BLOCK])
                kept[1].append(rows[i : i + BLOCK])
                if sum(map(len, kept[0])) >= BLOCK:
                    yield out(int(n))
    for n in list(held):
        yield out(n)


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right."""
    return np.cumsum(x, axis=1)[:, -1]


class Tile:
    """A block's vectors, and their int8 form with the length of what rounding lost."""

    def __init__(self, dims: int, ids: bytes, data: bytes, kind: str) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)
        # a power of two is taken out first, so that squares neither overflow nor vanish; it changes no digit of a cosine
        self.rows = np.ldexp(self.rows, -np.frexp(np.abs(self.rows).max(axis=1))[1][:, None])
        self.square = in_order(self.rows * self.rows)
        unit = self.rows / np.sqrt(self.square)[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        self.int8 = np.rint(unit / scale[:, None]).astype(np.int8)
        self.scale, self.lost = scale, np.sqrt(((unit - self.int8 * scale[:, None]) ** 2).sum(axis=1))


def nearest_in(q: Tile, c: Tile, k: int, best: list[list[tuple[float, int]]]) -> None:
    """Improve the k best (score below 0, id) of each query by a tile of candidates, merged by a heap."""
    # int8 products of fewer than 1000 dimensions are exact in float32, and then as fast as the machine multiplies
    form = np.float32 if q.int8.shape[1] < 1000 else np.float64
    near = (q.int8.astype(form) @ c.int8.astype(form).T).astype(np.float64) * q.scale[:, None] * c.scale[None, :]
    off = q.lost[:, None] + (1 + q.lost[:, None]) * c.lost[None, :] + 1e-9
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, near - off)
    floor = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best]) - 1e-9
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    row, col = np.nonzero((near + off >= floor[:, None]) & ~own)
    scores = np.empty(len(row))
    for i in range(0, len(row), PAIRS):
        r, s = row[i : i + PAIRS], col[i : i + PAIRS]
        scores[i : i + PAIRS] = np.clip(in_order(q.rows[r] * c.rows[s]) / np.sqrt(q.square[r] * c.square[s]), -1, 1)
    bounds = np.searchsorted(row, np.arange(len(q.ids) + 1))
    for n in range(len(q.ids)):
        a, b = bounds[n], bounds[n + 1]
        if a < b:
            found = zip((-scores[a:b]).tolist(), c.ids[col[a:b]].tolist(), strict=True)
            best[n] = heapq.nsmallest(k, [*best[n], *found])


def _meet(k: int, kind: str):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        tiles = [Tile(*row.values(), kind) for row in candidates.select(["dims", "ids", "data"]).to_pylist()]
        out: list[tuple] = []
        for row in queries.select(["dims", "ids", "data"]).to_pylist():
            q = Tile(*row.values(), kind)
            best: list[list[tuple[float, int]]] = [[] for _ in q.ids]
            for c in tiles:
                if c.rows.shape[1] == q.rows.shape[1]:
                    nearest_in(q, c, k, best)
            out += [(int(i), v, -s) for i, held in zip(q.ids, best, strict=True) for s, v in held]
        return pa.table([pa.array([r[m] for r in out], t) for m, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine for each row for which the Column is_query holds.

    Blocks of queries meet blocks of candidates in a grid of tasks, each block sent along one row or column of it. A tile's int8 products bound each cosine from both sides; pairs that may be among the best are computed again in double precision, and each task keeps the k best of a query.

    Returns (query_id, rank, vec_id, score), nearest first, ties to the smaller id. A row with the query's own id is no candidate. Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of other lengths than the query's are no candidates. Rows that repeat an id are one candidate if they are alike. An empty table gives an empty result. Other columns are not read."""
    spark = df.sparkSession
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & fine)
    kind = "<f4" if "float" in dict(df.dtypes)[vector_col] else "<f8"
    if kind == "<f8":
        v = v.cast("array<double>")
    named = lambda x: x.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).distinct()  # noqa: E731 # before any list is cut to k, which copies would fill
    schema = "dims int, ids binary, data binary"
    candidates = cut(in_batches(named(rows), _blocks, schema))
    queries = cut(in_batches(named(rows.where(is_query)), _blocks, schema))
    across = max(1, -(-queries.count() // TOGETHER))
    down = max(-(-candidates.count() // TOGETHER), min(spark.sparkContext.defaultParallelism, 64) // across, 1)
    cell = lambda x, n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    q = queries.withColumn("g", cell(queries, across)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    c = candidates.withColumn("c", cell(candidates, down)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    met = q.groupBy("g", "c").cogroup(c.groupBy("g", "c")).applyInArrow(_meet(k, kind), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
