"""Best-fit packing of token pieces by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.llm.common import cut, in_batches

#: Special token of the vocabulary, its id, and the id that ends a document.
SPECIAL, END = {"<|endoftext|>": 50256}, 0
#: Pieces of one length that one task numbers.
NUMBERED = 1000
#: Islands, rounds with a migration after each, crossovers of an island in a round, and how many of them it makes even if the first plans are as good as can be.
ISLANDS, ROUNDS, CROSSINGS, LEAST = 6, 4, 24, 8
#: Plans that an island starts from, each in an order of lengths disturbed so much; plans it keeps, and sends on.
DISTURBED, KEPT, ELITES = (0.3, 1.0, 1.0, 5.0), 8, 2
#: Share of a sequence from which on it counts as well filled.
FILLED = 0.9999

Bins = dict[tuple[int, ...], int]
_encoders: dict[str, object] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The byte-level BPE of that vocabulary file, kept for the life of a Python worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, allowed = encoder(path), set(SPECIAL)
        for batch in batches:
            out: list[tuple] = []
            for who, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(np.asarray(codec.encode_to_numpy(text.as_py() or "", allowed_special=allowed), dtype="<u4"), np.array([END], "<u4"))
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for piece, end in enumerate(ends):
                    out.append((who, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            yield pa.record_batch([pa.array([r[m] for r in out], t) for m, t in enumerate((batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


class Packer:
    """Bins of equal content are kept once with their number, so the work doesn't grow with the items."""

    def __init__(self, counts: dict[int, int], capacity: int, seed: int) -> None:
        self.counts, self.capacity, self.rng = {k: n for k, n in counts.items() if n}, capacity, np.random.default_rng(seed)
        self.least = -(-sum(k * n for k, n in self.counts.items()) // capacity)

    def fit(self, items: list[tuple[int, int]], bins: Bins) -> Bins:
        """Put (length, number) items, in the order given, each into the fullest bin that takes it."""
        room: dict[int, list[list]] = {}
        free = np.zeros(self.capacity + 1, bool)
        for content, n in bins.items():
            r = self.capacity - sum(content)
            room.setdefault(r, []).append([content, n])
            free[r] = True

        def put(content: tuple[int, ...], n: int) -> None:
            r = self.capacity - sum(content)
            room.setdefault(r, []).append([content, n])
            free[r] = True

        for length, n in items:
            while n:
                r = length + int(free[length:].argmax())
                if not free[r]:
                    each = min(n, self.capacity // length)
                    put((length,) * each, n // each)
                    n %= each
                    continue
                content, have = room[r][-1]
                each = min(n, r // length)
                use = min(have, n // each)
                if use == have:
                    room[r].pop()
                    free[r] = bool(room[r])
                else:
                    room[r][-1][1] -= use
                put(tuple(sorted((*content, *(length,) * each), reverse=True)), use)
                n -= use * each
        out: Bins = {}
        for held in room.values():
            for content, n in held:
                out[content] = out.get(content, 0) + n
        return out

    def seed_bins(self, noise: float) -> Bins:
        """A plan to start from: best fit in a disturbed order of lengths, which leaves room for improvement; without noise, best-fit decreasing."""
        order = sorted(self.counts, key=lambda k: -k * (1 + noise * self.rng.random()))
        return self.fit([(k, self.counts[k]) for k in order], {})

    def number(self, bins: Bins) -> int:
        return sum(bins.values())

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then the fuller ones: the room that is left is best left in few bins."""
        return -self.number(bins), sum(n * (sum(c) / self.capacity) ** 2 for c, n in bins.items())

    def cross(self, mother: Bins, father: Bins) -> Bins:
        """A section of the father's well-filled bins enters the child whole; the mother's well-filled bins follow as far as no item comes twice, but for some of those with the most items, whose short items can fill what long ones leave; all displaced items are best-fitted, longest first."""
        left, child = dict(self.counts), {}

        def take(content: tuple[int, ...], n: int) -> None:
            need: dict[int, int] = {}
            for k in content:
                need[k] = need.get(k, 0) + 1
            n = min(n, *(left[k] // m for k, m in need.items()))
            if n > 0:
                child[content] = child.get(content, 0) + n
                for k, m in need.items():
                    left[k] -= n * m

        filled = sorted((c for c in father if sum(c) >= FILLED * self.capacity), key=lambda c: (-len(c), c))
        begin, end = sorted(self.rng.choice(len(filled) + 1, 2)) if filled else (0, 0)
        for c in filled[begin:end]:
            take(c, father[c])
        own = sorted((c for c in mother if sum(c) >= FILLED * self.capacity), key=lambda c: (len(c), c))
        for c in own[: self.rng.integers(len(own) // 2, len(own) + 1)]:
            take(c, mother[c])
        return self.fit([(k, left[k]) for k in sorted(left, reverse=True) if left[k]], child)


def _to_text(bins: Bins) -> str:
    return json.dumps([[*map(int, c), int(n)] for c, n in bins.items()])


def _from_text(text: str) -> Bins:
    return {tuple(x[:-1]): x[-1] for x in json.loads(text)}


def _evolve(counts: dict[int, int], capacity: int, crossings: int):
    """Each island: its plans cross, the best are kept. A plan's generation is the number of crossovers behind it, 0 for one that an island started from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for island, start, elites in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                packer = Packer(counts, capacity, start)
                rank = lambda plan: (*packer.fitness(plan[0]), plan[1])  # noqa: B023, E731
                herd = [(_from_text(e["plan"]), e["generation"]) for e in elites] + [(packer.seed_bins(x), 0) for x in DISTURBED]
                for n in range(crossings):
                    herd = sorted(herd, key=rank, reverse=True)[:KEPT]
                    if n >= LEAST and herd[0][1] and packer.number(herd[0][0]) <= packer.least:
                        break
                    a, b = sorted(packer.rng.choice(len(herd), 2, replace=False))
                    herd.append((packer.cross(herd[a][0], herd[b][0]), max(herd[a][1], herd[b][1]) + 1))
                best = sorted(herd, key=rank, reverse=True)[:ELITES]
                yield pa.record_batch([pa.array([island] * len(best), pa.int32()), pa.array([_to_text(p) for p, _ in best], pa.string()), pa.array([g for _, g in best], pa.int32())], names=["island", "plan", "generation"])

    return run


def plan_bins(spark, counts: dict[int, int], capacity: int, islands: int = ISLANDS, rounds: int = ROUNDS, crossings: int = CROSSINGS) -> tuple[Bins, int]:
    """The best bins found for so many items of each length, and the number of crossovers behind them.

    Items of one length are alike, so counts (at most capacity numbers) are all that islands need, and bins with their numbers all they send. After each round every island gets the elites of two others; the search ends when no plan can have fewer bins."""
    whole = counts.get(capacity, 0)
    rest = {k: n for k, n in counts.items() if k < capacity and n}
    best, generation = {}, 0
    if rest:
        packer, elites = Packer(rest, capacity, 0), []
        schema = "island int, start int, elites array<struct<plan:string,generation:int>>"
        for turn in range(rounds):
            rows = [(i, turn * islands + i, [e for s in (1, 2) for e in elites[(i + s) % islands]] if elites else []) for i in range(islands)]
            evolved = in_batches(spark.createDataFrame(rows, schema).repartition(islands, "island"), _evolve(rest, capacity, crossings), "island int, plan string, generation int")
            elites = [[] for _ in range(islands)]
            for r in sorted(evolved.collect()):  # ELITES plans of each island, of a size that lengths bound, not items
                elites[r["island"]].append((r["plan"], r["generation"]))
            plans = [(_from_text(p), g) for held in elites for p, g in held]
            best, generation = max(plans, key=lambda plan: (*packer.fitness(plan[0]), plan[1]))
            if packer.number(best) <= packer.least:
                break
    if whole:
        best[(capacity,)] = whole
    return best, generation


def slots(bins: Bins) -> dict[int, list[np.ndarray]]:
    """For each length, where its items go: item r of the length belongs to the last row whose first item is not above r. Rows: first item, first bin, items in a bin, their offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for content, n in sorted(bins.items(), reverse=True):
        at = 0
        for k in sorted(set(content), reverse=True):
            m = content.count(k)
            out.setdefault(k, []).append((seen.get(k, 0), base, m, at))
            seen[k] = seen.get(k, 0) + n * m
            at += k * m
        base += n
    return {k: list(np.array(rows, np.int64).T) for k, rows in out.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                pick = np.flatnonzero(length == k)
                first, base, m, at = table[int(k)]
                row = np.searchsorted(first, rank[pick], side="right") - 1
                i = rank[pick] - first[row]
                where[pick], offset[pick] = base[row] + i // m[row], at[row] + i % m[row] * k
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(where), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every document's tokens in sequences of at most capacity tokens, as few as found.

    A document is its byte-BPE ids and an end id; one longer than capacity is cut into pieces of capacity, the first of which takes the rest. Sequences are planned for the numbers of pieces of each length, by a grouping genetic algorithm on islands that exchange their best bins; then pieces are numbered within their length and take their places, each length in as many tasks as its number asks for.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset) for each piece. A null or empty text is one end id. Equal pieces may swap places. Rows that repeat an id are packed each. An empty table gives an empty result. Other columns are not read."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    cut_up = cut(in_batches(docs, _pieces(path or vocabulary(), capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not counts:
        return cut_up.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins, _ = plan_bins(spark, counts, capacity)
    shared = spark.sparkContext.broadcast(slots(bins))
    parts = spark.createDataFrame([(k, max(1, -(-n // NUMBERED))) for k, n in counts.items()], "k long, parts int")
    dealt = cut_up.join(F.broadcast(parts), F.col("length") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("parts")).cast("int"))
    sizes = dealt.groupBy("k", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("k").alias("k2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("number", number).join(F.broadcast(sizes) if len(counts) + sum(counts.values()) // NUMBERED < 50_000 else sizes, (F.col("length") == F.col("k2")) & (F.col("part") == F.col("p2")))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("rank"))
    return in_batches(ranked, _place(shared), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
