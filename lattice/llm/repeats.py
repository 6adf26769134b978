"""Passages that occur more than once: windows of W symbols (words or bytes), found through content-defined anchors.

Each window is anchored at its least gram, so equal windows have equal anchors. Neighbouring windows with one anchor form a run, whose whole stretch of text has a key. Runs meet by anchor: equal stretches are counted and kept once, and the different stretches of an anchor are compared with each other, by factors (words) or by intervals of suffixes (bytes). Where an anchor has too many different stretches for one task, it grows by the symbols beside it, so that its windows fall into smaller groups, again and again up to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import BATCH, IS_SPACE, SYMBOLS, Prefix, U, cut, in_batches, key_filter, may_have, mix, pieces, release, shingles, text_bytes, words


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w neighbouring hashes, the leftmost among equals."""
    packed = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)
    width = 1
    while width * 2 <= w:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if width < w:
        packed = np.minimum(packed[: len(packed) - (w - width)], packed[w - width :])
    return (packed & U(0xFFFFFFFF)).astype(np.int64)


def runs_of(symbols: np.ndarray, prefix: Prefix, base: int, grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, key, first window, number of windows and anchor place of each run of one text, whose symbols begin at base."""
    n = len(symbols) - window + 1
    place = least_places(grams, window - gram + 1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(first, n))
    return grams[place[first]], prefix.of(base + first, base + first + count - 1 + window), first, count, place[first]


def each_run(batch: pa.RecordBatch, by: str, window: int, gram: int) -> Iterator[tuple]:
    """For each text with a window: its row, its runs, and what gives the text from one symbol up to another."""
    for i, j in pieces(batch, "text"):
        column = batch.column("text").slice(i, j - i)
        raw, first = text_bytes(column)
        if by == "word":
            symbols, start, end, first = words(column, lower=False)
            stretch = lambda a, b: b" ".join(raw[start[a] : end[b - 1]].tobytes().split())  # noqa: E731 # bytes split at the same white space
        else:
            symbols = SYMBOLS[raw]
            stretch = lambda a, b: raw[a:b].tobytes()
        if len(symbols) < window:
            continue
        prefix = Prefix(symbols)
        grams = shingles(symbols, gram) if gram < 9 else prefix.grams(gram)
        for row in np.flatnonzero(np.diff(first) >= window):
            a, b = int(first[row]), int(first[row + 1])
            yield i + int(row), runs_of(symbols[a:b], prefix, a, grams[a : b - gram + 1], window, gram), lambda x, y, a=a, stretch=stretch: stretch(a + x, a + y)


#: Rows that a task compares with each other before they are dealt out, and copies of a run among them that make it worth it.
LOCALLY, OFTEN = 200_000, 8


def _spare(m: np.ndarray, key: np.ndarray, who: np.ndarray, what: np.ndarray, keep: int) -> np.ndarray:
    """Rows whose run also begins at `keep` earlier places among these rows; only frequent runs are looked at."""
    spare = np.zeros(len(m), bool)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] >= OFTEN)
    if len(often):
        o = often[np.lexsort((what[often], who[often], key[often], m[often]))]
        new = np.ones(len(o), bool)
        new[1:] = (m[o][1:] != m[o][:-1]) | (key[o][1:] != key[o][:-1]) | (who[o][1:] != who[o][:-1]) | (what[o][1:] != what[o][:-1])
        o = o[new]  # a repeated row is no other place
        first = np.ones(len(o), bool)
        first[1:] = (m[o][1:] != m[o][:-1]) | (key[o][1:] != key[o][:-1])
        nth = np.arange(len(o)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        spare[o[nth >= keep]] = True
    return spare


def _runs(by: str, window: int, gram: int, every: bool):
    """Each run, to be dealt out by its anchor. Where a task alone sees that a run is covered, its row is done, and goes to any task instead of the anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return run_batch(*(np.concatenate(x) for x in zip(*held, strict=True)), every)

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, (m, key, first, count, _), _ in each_run(batch, by, window, gram):
                held.append((m.view(np.int64), key.view(np.int64), np.full(len(m), ids[row], np.int64), (first << 20) | count))
                size += len(m)
                if size > LOCALLY:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def run_batch(m: np.ndarray, key: np.ndarray, who: np.ndarray, what: np.ndarray, every: bool) -> pa.RecordBatch:
    done = _spare(m, key, who, what, 2 if every else 1)
    m = np.where(done, run_identity(who, what).view(np.int64), m)
    return pa.record_batch([pa.array(x) for x in (m, key, who, what, done)], names=["m", "key", "id", "run", "done"])


RUN = "m long, key long, id long, run long, done boolean"
STATE = "m long, id long, run long, state int"


#: What is known of a run: all its windows are covered; its stretch is to be compared with others of its anchor.
COVERED, OPEN = 1, 2


def _settle(every: bool):
    """Rows come ordered by anchor, key, id, run. A run is covered if its key came before (or comes again, if every occurrence counts); the first run of each key is open if its anchor has other keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the row held back, for its successor is needed
        before = None  # anchor and key of the row before that
        waiting = None  # the first row of the open anchor, if it isn't open yet: (id, run, state)

        def emit(m, who, what, state):
            return pa.record_batch([pa.array(np.asarray(m, np.int64)), pa.array(np.asarray(who, np.int64)), pa.array(np.asarray(what, np.int64)), pa.array(np.asarray(state, np.int32))], names=["m", "id", "run", "state"])

        def work(rows, end):
            nonlocal before, waiting
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)  # a repeated row is the same run
            m, key, who, what = (x[new] for x in rows)
            fresh_m, fresh = np.ones(len(m), bool), np.ones(len(m), bool)
            fresh_m[1:] = m[1:] != m[:-1]
            fresh[1:] = fresh_m[1:] | (key[1:] != key[:-1])
            if before is not None:
                fresh_m[0] = m[0] != before[0]
                fresh[0] = fresh_m[0] or key[0] != before[1]
            again = np.zeros(len(m), bool)
            again[:-1] = ~fresh[1:]
            n = len(m) if end else len(m) - 1  # the last row waits for its successor
            fresh_m, fresh, again = fresh_m[:n], fresh[:n], again[:n]
            if not n:
                return
            state = np.where(~fresh | (again & every), COVERED, 0)
            group = np.cumsum(fresh_m)
            other = fresh & ~fresh_m
            many = np.zeros(group[-1] + 1, bool)
            many[group[other]] = True
            if waiting is not None and many[0]:
                yield emit([waiting[0]], [waiting[1]], [waiting[2]], [OPEN])
                waiting = None
            state = np.where(other | (fresh_m & many[group]), state | OPEN, state)
            if fresh_m.any():
                tail = np.flatnonzero(fresh_m)[-1]
                waiting = None if state[tail] & OPEN else (m[tail], who[tail], what[tail])
            keep = state > 0
            if keep.any():
                yield emit(m[:n][keep], who[:n][keep], what[:n][keep], state[keep])
            before = (m[n - 1], key[n - 1])

        for batch in batches:
            rows, done = [batch.column(i).to_numpy() for i in range(4)], batch.column(4).to_numpy(zero_copy_only=False)
            if done.any():
                yield emit(*(rows[i][done] for i in (0, 2, 3)), np.full(int(done.sum()), COVERED))
                rows = [x[~done] for x in rows]
                if not len(rows[0]):
                    continue
            if last is not None:
                rows = [np.concatenate(x) for x in zip(last, rows, strict=True)]
            yield from work(rows, False)
            last = [x[-1:] for x in rows]
        if last is not None:
            yield from work(last, True)

    return run


def run_identity(ids: np.ndarray | int, first: np.ndarray) -> np.ndarray:
    return mix(np.asarray(ids, dtype=np.int64).view(U) * U(0xC2B2AE3D27D4EB4F) + first.astype(U))


def open_runs(docs: DataFrame, opened: DataFrame, produce, schema: str) -> DataFrame:
    """produce(batch, test) over the texts; test(id, first windows) holds for every open run, and may hold for others."""
    flags = key_filter(opened, lambda batch: run_identity(batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 20))
    if flags is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = lambda who, first: may_have(flags.value, run_identity(np.full(len(first), who, np.int64), first))
            for batch in batches:
                yield from produce(batch, test)

        return in_batches(docs, run, schema)
    asked = opened.groupBy("id").agg(F.collect_set(F.shiftright("run", 20)).alias("first"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: dict[int, set] = {}
            for who, firsts in zip(batch.column("id").to_pylist(), batch.column("first").to_pylist(), strict=True):
                per.setdefault(who, set()).update(firsts)
            yield from produce(batch, lambda who, first: np.isin(first, list(per[int(who)])))

    return in_batches(docs.join(asked, "id"), told, schema)


SEGMENT = "m long, id long, first long, count int, place int, gram int, text binary"
KEYED = f"{SEGMENT}, key long"
#: Different stretches of an anchor that meet in one task; of an anchor with more, longer anchors are made.
TOGETHER = 4096


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [(x.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split(" ")[1]]) for x in KEYED.split(", ")][: len(rows[0])]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _in_parts(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about BATCH bytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 100 + len(r[6])
        if size > BATCH:
            yield _segment_batch(out)
            out, size = [], 0
    if out:
        yield _segment_batch(out)


def _segments(by: str, window: int, gram: int):
    """The stretches of text of the runs asked for, with the place of their anchor."""

    def produce(batch: pa.RecordBatch, test) -> Iterator[pa.RecordBatch]:
        ids = batch.column("id").to_numpy(zero_copy_only=False)

        def rows() -> Iterator[tuple]:
            for row, (m, _, first, count, place), text in each_run(batch, by, window, gram):
                for i in np.flatnonzero(test(ids[row], first)).tolist():
                    f, c = int(first[i]), int(count[i])
                    yield int(m[i].view(np.int64)), int(ids[row]), f, c, int(place[i]) - f, gram, text(f, f + c - 1 + window)

        yield from _in_parts(rows())

    return produce


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    raw, at = text_bytes(batch.column("text"))
    for i, head in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
        yield *head, raw[at[i] : at[i + 1]].tobytes()


#: Parts that the places of an anchor within its windows are split into, where the anchor is too frequent.
SPLIT = 8


def longer_anchors(rows: Iterator[tuple], by: str, window: int) -> Iterator[tuple]:
    """Each stretch in SPLIT at most, by how much of a window lies before its anchor: in each part the anchor grows by what all the part's windows have before and after it. Equal windows have their anchor at one place, so they still meet; what windows have beside the longer anchor is a SPLITth of what it was."""
    for _, who, first, count, place, gram, text in rows:
        symbols = text.split(b" ") if by == "word" else text
        room = window - gram
        step = -(-(room + 1) // SPLIT)
        for least in range(0, room + 1, step):
            most = min(least + step - 1, room)  # symbols before the anchor
            a, b = max(place - most, 0), min(place - least, count - 1)  # windows
            if a <= b:
                part = symbols[a : b + window]
                at, size = place - least - a, gram + least + room - most
                anchor, part = part[at : at + size], part if by == "byte" else b" ".join(part)
                m = xxhash.xxh64_intdigest(anchor if by == "byte" else b" ".join(anchor), seed=least << 20 | size)
                yield m - (1 << 63), who, first + a, b - a + 1, at, size, part, xxhash.xxh64_intdigest(part, seed=1) - (1 << 63)


def _longer(by: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _in_parts(longer_anchors(_rows(batch), by, window))

    return run


def _as_runs(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, key, who, first, count = (batch.column(n).to_numpy().astype(np.int64) for n in ("m", "key", "id", "first", "count"))
            yield run_batch(m, key, who, (first << 20) | count, every)

    return run


def covered_runs(texts: DataFrame, by: str, window: int, gram: int, every: bool, meet) -> DataFrame:
    """(id, run, state): the runs whose windows all begin earlier as well (or, with every, anywhere else as well).

    meet gets the different stretches of an anchor, in order of anchor, id and place, TOGETHER of each at most."""
    deal = lambda runs: cut(in_batches(runs.repartition("m").sortWithinPartitions("m", "key", "id", "run"), _settle(every), STATE))
    settled = deal(in_batches(texts, _runs(by, window, gram, every), RUN))
    found = settled.select("id", "run", "state")
    opened = settled.where(F.col("state").bitwiseAND(OPEN) > 0).select("id", "run")
    segments = cut(open_runs(texts, opened, _segments(by, window, gram), SEGMENT))
    while True:
        crowded = cut(segments.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("m"), segments.count() // TOGETHER)
        some = not crowded.isEmpty()
        few = segments.join(crowded, "m", "left_anti") if some else segments
        found = found.union(cut(in_batches(few.repartition("m").sortWithinPartitions("m", "id", "first"), meet(window), STATE)).select("id", "run", "state"))
        if not some:
            release(segments, crowded)
            return found
        longer = cut(in_batches(segments.join(crowded, "m", "left_semi"), _longer(by, window), KEYED))
        settled = deal(in_batches(longer, _as_runs(every), RUN))
        found = found.union(settled.select("id", "run", "state"))
        opened = settled.where(F.col("state").bitwiseAND(OPEN) > 0).select("id", F.shiftright("run", 20).alias("first"), F.col("run").bitwiseAND((1 << 20) - 1).cast("int").alias("count"))
        release(segments, crowded)
        segments = cut(longer.join(opened.distinct(), ["id", "first", "count"], "left_semi").select(*(x.split(" ")[0] for x in SEGMENT.split(", "))))
        release(longer)


def state_batch(m: int, ids: list[int], first: list[int], count: list[int]) -> pa.RecordBatch:
    runs = [(f << 20) | c for f, c in zip(first, count, strict=True)]
    return pa.record_batch([pa.array([m] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(runs, pa.int64()), pa.array([COVERED] * len(ids), pa.int32())], names=["m", "id", "run", "state"])


def covered_mask(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols the windows of runs cover."""
    first, count = runs >> 20, runs & 0xFFFFF
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + count - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(gone: np.ndarray) -> list[list[int]]:
    return np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist()


def _apply_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch, "text"):
                part = batch.slice(i, j - i)
                _, start, end, first = words(part.column("text"), lower=False)
                raw, offsets = text_bytes(part.column("text"))
                gone = np.zeros(len(start), bool)
                runs = part.column("runs").to_pylist()
                for row, own in enumerate(runs):
                    if own:
                        a, b = first[row], first[row + 1]
                        gone[a:b] = covered_mask(int(b - a), np.asarray(own, np.int64), window)
                # each word that stays keeps the white space after it, as one space
                keep = np.zeros(len(raw) + 1, np.int8)
                keep[start[~gone]] += 1
                np.add.at(keep, np.minimum(end[~gone] + 1, np.repeat(offsets[1:], np.diff(first))[~gone]), -1)
                keep = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
                plain = np.where(IS_SPACE[raw], np.uint8(32), raw)
                rows = []
                for row, own in enumerate(runs):
                    a, b, x, y = int(first[row]), int(first[row + 1]), int(offsets[row]), int(offsets[row + 1])
                    kept = plain[x:y][keep[x:y]].tobytes()
                    kept = kept.removesuffix(b" ")
                    lost = gone[a:b]
                    rows.append((b - a, int(lost.sum()) if own else 0, hashlib.sha256(kept).hexdigest(), _spans(lost) if own else [], kept.decode()))
                yield _result(part, rows)

    return run


def _apply_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch, "text"):
                part = batch.slice(i, j - i)
                raw, first = text_bytes(part.column("text"))
                rows = []
                for row, runs in enumerate(part.column("runs").to_pylist()):
                    own = raw[first[row] : first[row + 1]]
                    gone = covered_mask(len(own), np.asarray(runs, np.int64), window) if runs else np.zeros(len(own), bool)
                    keep = own[~gone].tobytes() if runs else own.tobytes()
                    rows.append((len(own), int(gone.sum()), hashlib.sha256(keep).hexdigest(), _spans(gone) if runs else [], keep.decode(errors="ignore")))
                yield _result(part, rows)

    return run


RESULT = "id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept string"


def _result(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    n, removed, digest, spans, kept = ([r[m] for r in rows] for m in range(5))
    return pa.record_batch(
        [part.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())],
        names=["id", "n_symbols", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
    )


def without(df: DataFrame, flags: DataFrame, apply, columns: str) -> DataFrame:
    """The texts without what the covered runs cover; columns: which of RESULT to return."""
    names = [x.strip() for x in columns.split(",")]
    kinds = {x.split(" ")[0]: x for x in RESULT.split(", ")}

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in apply(batches):
            yield out.select(names)

    per = flags.where(F.col("state").bitwiseAND(COVERED) > 0).groupBy("id").agg(F.collect_list("run").alias("runs"))
    return in_batches(df.join(per, "id", "left"), pruned, ", ".join(kinds[n] for n in names))


class Block:
    """The reference that later stretches of an anchor are parsed against: windows of earlier ones, and where each first began."""

    def __init__(self, window: int) -> None:
        self.window, self.held = window, {}

    def parse(self, words_: list[bytes]) -> list[tuple[int, int]]:
        """Factors of a stretch as (first window, windows), greedily from left to right: each is as long as its reference goes on alike. The window after a factor crosses the factor's end, and is looked up like any other. Then the stretch joins the block."""
        n = self.window
        windows = [b" ".join(words_[s : s + n]) for s in range(len(words_) - n + 1)]
        out, s = [], 0
        while s < len(windows):
            if (at := self.held.get(windows[s])) is None:
                s += 1
                continue
            reference, r = at
            size = 1
            while s + size < len(windows) and r + size + n <= len(reference) and reference[r + size + n - 1] == words_[s + size + n - 1]:
                size += 1
            out.append((s, size))
            s += size
        for s, w in enumerate(windows):
            self.held.setdefault(w, (words_, s))
        return out


def _factored(window: int):
    """Rows come ordered by anchor, id, place; each anchor has a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, block = None, None, Block(window)
        for batch in batches:
            ids, firsts, counts = [], [], []
            for m, who, first, _, _, _, text in _rows(batch):
                if m != here:
                    here, block = m, Block(window)
                elif (who, first) == last:  # a repeated row is the same run
                    continue
                last = (who, first)
                for s, n in block.parse(text.split(b" ")):
                    ids.append(who)
                    firsts.append(first + s)
                    counts.append(n)
            if ids:
                yield state_batch(0, ids, firsts, counts)

    return run


def substring_dedup(df: DataFrame, window: int = 20, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", columns: str = "id, n_symbols, n_removed, n_spans, kept_sha256, spans, kept") -> DataFrame:
    """Each text without the words of every window of `window` words that also begins earlier (smaller id, or earlier in the same text).

    A relative Lempel-Ziv parse against reference blocks that are dealt out by anchor: a factor that is long enough holds a window, and a window can only match within the block of its anchor, so each stretch of a text is parsed against that one block. A stretch that equals an earlier one is one factor, and is settled where stretches are counted. The others are factored greedily against the earlier stretches of their block (Block); windows across the ends of factors are looked up too. Factors of at least `window` words become spans; neighbouring ones join.

    Returns id, n_symbols (words), n_removed, n_spans, kept_sha256, spans ([first, end) in words), kept (words joined by a space). Null or empty texts have no words, and texts are read whole, however long. Rows that repeat an id are taken as one text would be: their windows at equal places count as one. A row without an id is no reference and stays as it is. An empty table gives an empty result. Other columns are not read. gram is at most window."""
    if not 0 < gram <= window:
        raise ValueError("a gram has at most as many words as a window")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = covered_runs(docs.where("id is not null"), "word", window, gram, False, _factored)
    return without(docs, found, _apply_words(window), columns)


#: Occurrences that one expansion takes at once.
AT_ONCE = 8192


def _context_lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows; 0 fills up a row."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def expand_intervals(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For anchors with what stands before (nearest first) and after them, symbols above 0 and 0 beyond the end: which windows recur.

    Out: a row for each anchor; column l says whether the window that begins l symbols before it is also around another anchor of its group. Rows stand in suffix order, as in a Burrows-Wheeler transform, so an interval of rows with one left context is extended by the symbol before it with a stable sort; common prefixes of neighbours are kept as minima. Breadth first, the left context grows by one symbol in each turn, and the right one that a window of fixed length still needs shrinks by one; intervals of one row end. The last turn is the one where the left context alone is as long as a window."""
    n, width = left.shape
    out = np.zeros((n, width + 1), bool)
    rows = np.ascontiguousarray(right).view(f"S{width}").ravel() if width else np.zeros(n, "S1")
    order = np.lexsort((rows, group))
    same = np.append(False, group[order][1:] == group[order][:-1])
    common = np.zeros(n, np.int64)
    pick = np.flatnonzero(same)
    common[pick] = _context_lcp(right[order[pick]], right[order[pick - 1]])
    interval = np.cumsum(~same)
    for depth in range(width + 1):
        if not len(order):
            break
        inner = np.append(interval[1:] == interval[:-1], False)  # has a successor in its interval
        need = width - depth
        hit = np.append(False, inner[:-1]) & (common >= need)
        hit[:-1] |= inner[:-1] & (common[1:] >= need)
        out[order[hit], depth] = True
        if depth == width:
            break
        symbol = left[order, depth].astype(np.int64)
        key = interval * 256 + symbol
        perm = np.argsort(key, kind="stable")
        perm = perm[symbol[perm] > 0]
        if not len(perm):
            break
        fresh = np.append(True, key[perm][1:] != key[perm][:-1])
        lone = fresh & np.append(fresh[1:], True)
        lows = np.zeros(len(perm), np.int64)
        follow = np.flatnonzero(~fresh)
        if len(follow):
            bounds = np.stack([perm[follow - 1] + 1, perm[follow] + 1], axis=1).ravel()
            lows[follow] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
        order, common, interval = order[perm][~lone], lows[~lone], np.cumsum(fresh)[~lone]
    return out


def _contexts(texts: list[bytes], place: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.zeros((len(texts), width), np.uint8), np.zeros((len(texts), width), np.uint8)
    for i, (t, p) in enumerate(zip(texts, place.tolist(), strict=True)):
        raw = np.frombuffer(t, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        left[i, :p] = raw[:p][::-1][:width]
        tail = raw[p + gram :][:width]
        right[i, : len(tail)] = tail
    return left, right


def _expanded(window: int):
    """Rows come ordered by anchor, id, place: the windows of each that recur in its group."""

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [r for i, r in enumerate(rows) if not i or r[:3] != rows[i - 1][:3]]  # a repeated row is the same run
        for gram in sorted({r[5] for r in rows}):
            yield from expand(gram, [r for r in rows if r[5] == gram])

    def expand(gram: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        m, ids, first, count, place = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        left, right = _contexts([r[6] for r in rows], place, gram, window - gram)
        group = np.cumsum(np.append(True, m[1:] != m[:-1]))
        seen = expand_intervals(group, left, right)
        at, depth = np.nonzero(seen)
        start = place[at] - depth
        fine = (start >= 0) & (start < count[at])
        at, start = at[fine], start[fine]
        if len(at):
            by = np.lexsort((start, at))
            at, start = at[by], start[by]
            fresh = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
            n = np.diff(np.append(fresh, len(at)))
            who = at[fresh]
            yield state_batch(0, ids[who].tolist(), (first[who] + start[fresh]).tolist(), n.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in _rows(batch):
                if len(held) >= AT_ONCE and r[0] != held[-1][0]:
                    yield from work(held)
                    held = []
                held.append(r)
        if held:
            yield from work(held)

    return run


def byte_dedup(df: DataFrame, window: int = 400, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", columns: str = "id, n_symbols, n_removed, n_spans, kept_sha256, spans, kept") -> DataFrame:
    """Each text without the bytes of every string of `window` bytes that also begins anywhere else.

    Suffixes are dealt out by anchor, so that equal strings meet, and stretches that are equal throughout are counted and kept once, as an interval that needs no expansion. The other occurrences of an anchor are put in suffix order and their intervals expanded backwards, breadth first, up to the length of a window (expand_intervals). An anchor with more than TOGETHER different stretches is first grown by the symbols beside it, which splits its interval over tasks.

    Returns id, n_symbols (bytes), n_removed, n_spans (maximal removed stretches), kept_sha256 (of the remaining bytes), spans, kept (where a span cut a character, its remaining bytes are left out of this text). Null counts as empty, and texts are read whole, however long. Rows that repeat an id count as different texts only where their places differ. A row without an id matches nothing and stays as it is. An empty table gives an empty result. Other columns are not read. gram is at most window."""
    if not 0 < gram <= window:
        raise ValueError("a gram has at most as many bytes as a window")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = covered_runs(docs.where("id is not null"), "byte", window, gram, True, _expanded)
    return without(docs, found, _apply_bytes(window), columns)
