"""N-gram Jaccard join over a metric space of shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import U, components, cut, in_batches, key_filter, may_have, mix, pieces, release, shingles, text_bytes, text_key, words

#: Counters of the frequency sketch; fixed, so what is broadcast never grows.
SKETCH_BITS = 20
#: Members of a region that are paired outright, and pivots of a larger one.
SMALL, PIVOTS = 24, 8


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of two sets of that summed size with 100 * both >= percent * either."""
    return -(-(percent * total) // (100 + percent))


def window_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Places of the ordered set that a set within the threshold can't miss all of."""
    return n - -(-n * percent // 100) + 1


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, _, _, first = words(column, lower=True)
    for a, b in zip(first[:-1], first[1:], strict=True):
        h = hashes[a:b]
        if len(h) >= k:
            yield np.unique(shingles(h, k))
        elif len(h):
            yield mix(shingles(h, len(h)) + U(len(h)))
        else:
            yield np.zeros(0, U)


#: Shingles that a task holds before it counts them; blocks of counters.
COUNTED, BLOCK = 1 << 18, 1 << 12


def set_mark(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(s).sum(dtype=U).view(np.int64))


def _describe(k: int):
    """Size and two marks of each row's set; then, with null ids, the counters of all the task's shingles."""
    names = ["id", "text_key", "n", "h1", "h2", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                at, n = np.unique((np.concatenate(held) >> U(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                counts[at] += n
                held.clear()

        for batch in batches:
            for i, j in pieces(batch, "text"):
                part, out = batch.slice(i, j - i), []
                for s in sets_of(part.column("text"), k):
                    held.append(s)
                    out.append((len(s), set_mark(s), set_mark(s ^ U(0x5851F42D4C957F2D))))
                if sum(map(len, held)) > COUNTED:
                    add()
                n, h1, h2 = zip(*out, strict=True)
                none = pa.nulls(len(out), pa.binary())
                yield pa.record_batch([part.column("id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.nulls(len(out), pa.int32()), none], names=names)
        add()
        blocks, one = counts.reshape(-1, BLOCK), pa.nulls(1, pa.int64())
        for b in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.record_batch([one, one, one, one, one, pa.array([b], pa.int32()), pa.array([blocks[b].tobytes()], pa.binary())], names=names)

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        for i, b in enumerate(batch.column(0).to_pylist()):
            new = raw[at[i] : at[i + 1]].view(np.int64)
            held[b] = held[b] + new if b in held else new.copy()
    for b, x in held.items():
        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "counts"])


def _levels(described: DataFrame) -> np.ndarray:
    """A byte for each counter: 0 for ordinary shingles, more for more frequent ones."""
    blocks = described.where("block is not null").select("block", "counts")
    added = in_batches(blocks.repartition(16, "block"), _add_blocks, "block int, counts binary").collect()  # 2 ** SKETCH_BITS counters, whatever the input
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for block, raw in added:
        counts.reshape(-1, BLOCK)[block] += np.frombuffer(raw, np.int64)
    floor = 2 * counts.mean() + 16
    return np.where(counts <= floor, 0, 1 + np.log2(np.maximum(counts, 1) / floor)).astype(np.uint8)


#: Sets of which a task remembers one each by hash, so that copies don't travel.
LATELY = 1 << 16


def _windows(k: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen = np.zeros(LATELY, np.int64)
        for batch in batches:
            for i, j in pieces(batch, "text"):
                keys, owners, sizes, places = [], [], [], []
                for s in sets_of(batch.column("text").slice(i, j - i), k):
                    n = len(s)
                    if not n:
                        continue
                    own = set_mark(s)
                    if seen[own % LATELY] == own:  # a copy of a set met lately in this task; others are dropped in the regions
                        continue
                    seen[own % LATELY] = own
                    w = window_size(n, percent)
                    at = level[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
                    low = s[at == 0][:w]
                    if len(low) < w:
                        low = s[np.argsort(at, kind="stable")[:w]]
                    keys.append(low)
                    owners.append(np.full(w, own))
                    sizes.append(np.full(w, n, np.int32))
                    places.append(np.arange(w, dtype=np.int32))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["s", "c", "n", "pos"])

    return run


def _regions(percent: int):
    """Rows of a task come ordered by region, place, class. Small regions give all their pairs that size allows, at whatever place, so that who is not among them shares no small region; larger ones give pairs with their pivots that size and place allow, and their own rows for later."""

    def sized(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        na, nb = na.astype(np.int64), nb.astype(np.int64)
        return np.minimum(na, nb) >= least_overlap(na + nb, percent)

    def allowed(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
        na, nb = na.astype(np.int64), nb.astype(np.int64)
        return np.minimum(na - pa_, nb - pb) >= least_overlap(na + nb, percent)

    names = ["a", "b", "s", "n", "pos", "family"]

    def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none, short = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
        return pa.record_batch([pa.array(a), pa.array(b), none, short, short, none], names=names)

    def done(rows: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        s, c, n, pos = rows
        size = np.diff(np.append(starts, len(s)))
        group = np.repeat(np.arange(len(starts)), size)
        small = size[group] <= SMALL
        for d in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            i = i[sized(n[i], n[i + d]) & (c[i] != c[i + d])]
            if len(i):
                yield made(np.minimum(c[i], c[i + d]), np.maximum(c[i], c[i + d]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the open region
        pivots: list[np.ndarray] | None = None  # of an open region that is large

        def stars(rows: list[np.ndarray], piv: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            s, c, n, pos = rows
            for q in range(len(piv[1])):
                ok = allowed(n, pos, np.full_like(n, piv[2][q]), np.full_like(pos, piv[3][q])) & (c != piv[1][q])
                if ok.any():
                    yield made(np.minimum(c[ok], piv[1][q]), np.maximum(c[ok], piv[1][q]))
            yield pa.record_batch([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(s), pa.array(n), pa.array(pos), pa.array(np.full(len(c), piv[1][0]))], names=names)

        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if pivots is not None:
                mine = int((rows[0] == pivots[0][0]).sum())
                if mine:
                    yield from stars([x[:mine] for x in rows], pivots)
                rows = [x[mine:] for x in rows]
                if not len(rows[0]):
                    continue
                pivots = None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            fresh = np.ones(len(rows[0]), dtype=bool)
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[3][1:] != rows[3][:-1])
            rows = [x[fresh] for x in rows]
            starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            last = starts[-1]
            yield from done([x[:last] for x in rows], starts[:-1])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > SMALL:
                    yield from stars([x[a:b] for x in rows], [x[a : a + PIVOTS] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > SMALL:
                pivots = [x[:PIVOTS] for x in held]
                yield from stars(held, pivots)
                held = None
        if held is not None and len(held[0]):
            yield from done(held, np.zeros(1, np.int64))

    return run


def _bitmap(s: np.ndarray) -> bytes:
    """Which of about 4 to 8 places a member are taken; a place taken by one set only is a member that the other lacks."""
    places = 1 << max(6, int(4 * len(s)).bit_length())
    bits = np.zeros(places, np.uint8)
    bits[(s & U(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _may_link(percent: int):
    """Pairs that their bitmaps don't rule out: a bound on the intersection, never below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes, (left, i_), (right, j_) = (batch.column(m).to_numpy() for m in (2, 3)), text_bytes(batch.column(4)), text_bytes(batch.column(5))
            for i, (na, nb) in enumerate(zip(*(n.tolist() for n in sizes), strict=True)):
                x, y = left[i_[i] : i_[i + 1]], right[j_[i] : j_[i + 1]]
                while len(x) > len(y):
                    x = x[: len(x) // 2] | x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] | y[len(y) // 2 :]
                both = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
                if both * (100 + percent) >= percent * (na + nb):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _asked(k: int, flags, whole: bool):
    """The sets of texts whose id may be asked for, or their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if flags is not None:
                batch = batch.filter(pa.array(may_have(flags.value, batch.column("id").to_numpy())))
            for i, j in pieces(batch, "text"):
                part = batch.slice(i, j - i)
                sets = list(sets_of(part.column("text"), k))
                own = pa.array([set_mark(s) for s in sets], pa.int64())
                data = pa.array([s.tobytes() if whole else _bitmap(s) for s in sets], pa.binary())
                yield pa.record_batch([own, part.column("id"), pa.array(map(len, sets), pa.int64()), data], names=["c", "rep", "n", "members" if whole else "bits"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, counts = [], []
            (left, i_), (right, j_) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            for i in range(batch.num_rows):
                x, y = left[i_[i] : i_[i + 1]].view(U), right[j_[i] : j_[i + 1]].view(U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if 100 * both >= percent * either:
                    keep.append(i)
                    counts.append((both, either))
            near = batch.select(["repa", "repb"]).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*near.columns, *(pa.array([c[m] for c in counts], pa.int64()) for m in range(2))], names=["a", "b", "both", "either"])

    return run


def _sets_asked(classes: DataFrame, docs: DataFrame, reps: DataFrame, k: int, whole: bool) -> DataFrame:
    """c, rep, n and the members, or the bitmaps, of the classes (c). Texts are read again where they lie; only what is asked for moves."""
    asked = cut(reps.join(classes.distinct(), "c", "left_semi"), reps.count())
    flags = key_filter(asked.select("rep"), lambda batch: batch.column(0).to_numpy())
    texts = docs.where("id is not null")
    if flags is None:
        texts = texts.join(asked.select(F.col("rep").alias("id")), "id", "left_semi")
    schema = f"c long, rep long, n long, {'members' if whole else 'bits'} binary"
    out = cut(in_batches(texts, _asked(k, flags, whole), schema).join(asked, ["c", "rep"], "left_semi"))
    release(asked)
    return out


def _links(pairs: DataFrame, maps: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of classes that are near enough, by their representatives, with both sizes; exact on whole sets. Sets are made and moved only for pairs that their bitmaps don't rule out."""
    side = lambda df, end, *columns: df.select(F.col("c").alias(end), *(F.col(c).alias(c + end) for c in columns))
    close = pairs.join(side(maps, "a", "n", "bits"), "a").join(side(maps, "b", "n", "bits"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    close = cut(in_batches(close, _may_link(percent), "a long, b long").distinct())
    sets = _sets_asked(close.select(F.col("a").alias("c")).union(close.select("b")), docs, reps, k, True)
    both = close.join(side(sets, "a", "rep", "members"), "a").join(side(sets, "b", "rep", "members"), "b").select("repa", "repb", "membersa", "membersb")
    links = cut(in_batches(both, _verify(percent), "a long, b long, both long, either long").distinct(), close.count())
    release(close, sets)
    return links


def jaccard_join(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with the component of near copies that each is in, and the links that were verified.

    Points are the sets of distinct k-word shingles under the Jaccard distance; texts with equal sets are one point, stood for by the smallest id. The first pivots are single shingles, ordered from rare to frequent: a set lies in the Voronoi region of its first shingle, and the distance to the region of a later shingle is at least the share of shingles before it, so a set is copied to the regions within the threshold of it and to no other. Regions of up to SMALL sets are joined outright. In a larger one the sets nearest its centre (those with the fewest rare shingles) become pivots, and the region is joined with them; what that links is one component and needs no more pairs. Then the region is joined again for sets of different components. Each pair is verified on whole sets.

    With all_links, every linked pair of points is looked at, so that the links are complete; without, the links are those that connect the components.

    Returns (id, text_key, n_shingles, component_id) for each row, text_key telling rows of one id apart, and (a, b, both, either) with ids a < b. A null or wordless text has an empty set, component_id is its own id, and it links with nothing. Repeated rows come out as often as they came in. An empty table gives empty results. Other columns are not read."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = df.sparkSession
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    described = cut(in_batches(keyed, _describe(k), "id long, text_key long, n long, h1 long, h2 long, block int, counts binary"))
    told = described.where("block is null").select("id", "text_key", "n", "h1", "h2")
    reps = cut(told.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")), described.count())
    levels = spark.sparkContext.broadcast(_levels(described).tobytes())
    spread = in_batches(docs, _windows(k, percent, levels), "s long, c long, n int, pos int")
    dealt = spread.repartition("s").sortWithinPartitions("s", "pos", "c")
    found = cut(in_batches(dealt, _regions(percent), "a long, b long, s long, n int, pos int, family long"))
    by_class = reps.select(F.col("h1").alias("c"), "rep")
    pairs = found.where("b is not null").select("a", "b").distinct()
    classes = found.select(F.col("a").alias("c")).union(found.where("b is not null").select("b"))
    maps = _sets_asked(classes, docs, by_class, k, False)
    links = _links(pairs, maps, docs, by_class, k, percent)
    large = found.where("b is null")
    if not large.isEmpty():
        # Regions that one passage makes hold much the same sets, and go by one family, named by the region's first pivot. A pair that shares a small region is among pairs; another one shares large regions only, so these alone count for it.
        part = components(links, links.count())
        own = F.transform(F.array_sort(F.collect_set(F.struct("pos", "s"))), lambda x: x["s"])
        per = large.groupBy(F.col("a").alias("c")).agg(F.first("n").cast("long").alias("n"), F.min("pos").alias("pos"), own.alias("own"), F.collect_set("family").alias("families"))
        per = per.join(by_class, "c").join(part, F.col("rep") == F.col("node"), "left").select("c", "n", "pos", "own", "families", F.coalesce("component", "rep").alias("k"))
        per = cut(per.withColumn("size", F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")))  # sets near enough are at most one step apart
        rows = per.withColumn("f", F.explode("families")).drop("families")
        main = rows.groupBy("f", "k").agg(F.count("*").alias("m")).groupBy("f").agg(F.max_by("k", F.struct("m", "k")).alias("main"), F.count("*").alias("parts"))
        rows = rows.join(main if all_links else main.where("parts > 1"), "f")
        outer = rows if all_links else rows.where("k <> main")
        side = lambda df, end: df.select("f", "size", F.col("c").alias(end), *(F.col(v).alias(v + end) for v in ("n", "pos", "k", "own")))
        x = side(outer.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))), "a")
        enough = lambda most: most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
        shared = F.size(F.array_intersect("owna", "ownb"))
        beyond = lambda p, q: F.least(F.ceil(F.col(f"n{p}") * percent / 100) - 1, F.col(f"n{q}") - F.col(f"pos{q}") - shared)  # noqa: E731 # members after p's window
        near = (F.col("a") != F.col("b")) & enough(F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")))
        near = near if all_links else near & (F.col("ka") != F.col("kb"))
        near = near & (shared > 0) & enough(shared + F.greatest(beyond("a", "b"), beyond("b", "a")))
        rest = x.join(side(rows, "b"), ["f", "size"]).where(near)
        rest = cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.union(_links(rest, maps, docs, by_class, k, percent))
        release(per, rest)
    release(found, maps)
    part = components(links, links.count())
    named = told.join(reps, ["h1", "h2"], "left").join(part, F.col("rep") == F.col("node"), "left")
    out = named.select("id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))
    return out, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", "either")
