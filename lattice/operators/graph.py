"""Walks, ancestors, PageRank and longest paths over relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattice.model import Direction
from lattice.runtime import cut, dealt, release

#: PageRank's share of steps along edges, and its rounds.
ALPHA, ROUNDS = 0.85, 20


def adjacency(relations: DataFrame, kinds: tuple[str, ...], direction: str = Direction.OUTGOING) -> DataFrame:
    """Steps (src, dst) along relations of the kinds; as many of two elements as there are relations between them."""
    r = relations.where(F.col("kind").isin(*kinds))
    out, into = r.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), r.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return {Direction.OUTGOING: out, Direction.INCOMING: into}.get(direction, out.union(into))


def walk(relations: DataFrame, seeds: DataFrame, kinds: tuple[str, ...], direction: str = Direction.OUTGOING, depth: int = 2, limit: int | None = None) -> DataFrame:
    """(id, depth): the seeds (id) at 0, and elements within depth steps of them, each at its shortest depth. With a limit, so many elements besides the seeds, by depth and id.

    Each round joins the frontier with the edges and leaves out what was met before, so a round costs its own frontier; frontiers are cut, so a later round doesn't run an earlier one again."""
    edges = adjacency(relations, kinds, direction)
    frontier = cut(seeds.select("id").distinct())
    start = met = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(met, "id", "left_anti"))
        if frontier.isEmpty():
            break
        met = met.union(frontier.withColumn("depth", F.lit(d)))
    if not limit:
        return met
    return start.union(met.where("depth > 0").orderBy("depth", "id").limit(limit)).orderBy("depth", "id")


def walk_edges(relations: DataFrame, found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Relations between found elements, at the greater depth of their ends."""
    a, b = found.select(F.col("id").alias("source_id"), F.col("depth").alias("a")), found.select(F.col("id").alias("target_id"), F.col("depth").alias("b"))
    return relations.where(F.col("kind").isin(*kinds)).join(a, "source_id").join(b, "target_id").select(F.col("id").alias("relation_id"), "source_id", "target_id", F.greatest("a", "b").alias("depth"))


def ancestors(relations: DataFrame, ids: DataFrame, depth: int = 6) -> DataFrame:
    """(id, ancestor_id, depth): containers above each id, along the first contains relation into each."""
    parent = cut(relations.where("kind = 'contains'").groupBy(F.col("target_id").alias("child")).agg(F.min_by("source_id", "id").alias("parent")))
    up = cut(parent.join(parent.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")) if depth > 1 else parent
    chains = up.select(F.col("child").alias("parent"), F.array("parent").alias("chain"))  # of containers only, which are few beside what they contain
    for _ in range(depth - 2):
        step = up.select(F.col("child").alias("c"), F.array("parent").alias("more"))
        chains = chains.join(step, F.element_at("chain", -1) == F.col("c"), "left").select("parent", F.concat("chain", F.coalesce("more", F.slice("chain", 1, 0))).alias("chain"))
    first = ids.select("id").distinct().join(parent, F.col("id") == F.col("child")).select("id", "parent")
    if depth > 1:
        first = first.join(chains, "parent", "left").select("id", F.concat(F.array("parent"), F.coalesce("chain", F.slice(F.array("parent"), 1, 0))).alias("chain"))
    else:
        first = first.select("id", F.array("parent").alias("chain"))
    found = first.select("id", "chain", F.posexplode("chain").alias("n", "ancestor_id"))
    return found.where((F.array_position("chain", F.col("ancestor_id")) == F.col("n") + 1) & (F.col("id") != F.col("ancestor_id"))).select("id", "ancestor_id", (F.col("n") + 1).alias("depth"))


def _start(seeds: DataFrame) -> DataFrame:
    """(id, p): the seeds, each with its share of 1."""
    ids = seeds.select("id").distinct()
    return cut(ids.join(F.broadcast(ids.agg((1.0 / F.count("*")).alias("p")))))  # joined with one row


def _rounds(steps: DataFrame, start: DataFrame, rounds: int, alpha: float) -> DataFrame:
    """(id, rank) after so many rounds along steps (src, dst, w). What is moved in a round is cut, and its sum is observed as it is written, so a round is one job and its plan doesn't grow. Steps are dealt out by src once for all rounds; what is lost of them is read again."""
    steps, rank, before = dealt(steps, "src").persist(), start.select("id", F.col("p").alias("rank")), None
    for _ in range(rounds):
        moved = steps.join(rank, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("moved"))
        total = Observation()
        moved = cut(moved.observe(total, F.coalesce(F.sum("moved"), F.lit(0.0)).alias("kept")))
        back = start.select("id", (F.col("p") * (1 - alpha * total.get["kept"])).alias("rank"))
        rank = moved.select("id", (alpha * F.col("moved")).alias("rank")).union(back).groupBy("id").agg(F.sum("rank").alias("rank"))
        if before is not None:
            release(before)
        before = moved
    steps.unpersist()
    return rank


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """(id, rank) of a walk along edges (src, dst) that returns to the seeds (id), as does the share of elements without a way out. No seeds, no ranks."""
    steps = cut(dealt(edges.select("src", "dst"), "src").distinct().withColumn("w", 1.0 / F.count("*").over(W.partitionBy("src"))))
    return _rounds(steps, _start(seeds), rounds, alpha)


def hyper_pagerank(incidences: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """Ranks of elements and of hyperedges, for a walk from parts to hyperedges and on to their anchors."""
    into = incidences.where("role <> 'anchor'").select(F.col("element_id").alias("src"), F.col("relation_id").alias("edge"))
    onto = incidences.where("role = 'anchor'").select(F.col("relation_id").alias("edge"), F.col("element_id").alias("dst"))
    shared = lambda df, key, n: dealt(df, key).distinct().withColumn(n, F.count("*").over(W.partitionBy(key)))
    into, onto = cut(shared(into, "src", "n_in")), cut(shared(onto, "edge", "n_out"))
    pairs = dealt(into, "edge").join(onto, "edge").select("src", "dst", (1.0 / (F.col("n_in") * F.col("n_out"))).alias("w"))
    steps = cut(dealt(pairs, "src").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    rank = _rounds(steps, _start(seeds), rounds, alpha)
    edges = into.join(rank, F.col("src") == F.col("id")).groupBy(F.col("edge").alias("id")).agg(F.sum(F.col("rank") / F.col("n_in")).alias("rank"))
    return rank, edges


def longest_path(edges: list[tuple[int, int]]) -> list[int]:
    """The longest simple chain among a few selected elements (tens of them); ties go to smaller ids. Cycles are entered once."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        if a != b:
            after.setdefault(a, []).append(b)
    best: list[int] = []
    memo: dict[int, list[int]] = {}

    def down(n: int, on: frozenset[int]) -> list[int]:
        if n in memo:
            return memo[n]
        tail: list[int] = []
        clean = True
        for m in after.get(n, ()):
            if m in on:
                clean = False
                continue
            t = down(m, on | {m})
            clean &= m in memo
            if len(t) > len(tail):
                tail = t
        if clean:
            memo[n] = [n, *tail]
        return [n, *tail]

    for n in sorted(after):
        chain = down(n, frozenset({n}))
        if len(chain) > len(best):
            best = chain
    return best if len(best) > 1 else []
