"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattice.llm.common import IS_SPACE, SYMBOLS, Prefix, U, in_batches, mix, pieces, text_bytes

#: Labelled documents that a model is fitted on at most, and bytes of their texts; the rest of the labels stay unused. Texts are taken whole.
SAMPLE, SAMPLE_BYTES = 8000, 24 << 20
#: Features are hashed to so many weights, which is all that is broadcast.
BITS = 18
SEED = 11
#: Scores from here on are predicted to be of good quality.
THRESHOLD = 0.3

_CLASS = np.full(256, ord("a"), np.uint8)
_CLASS[:128] = np.arange(128)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[48:58] = ord("0")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every word, word pair, word shape and shape pair of all rows, and where each row's begin.

    A shape is the word with runs of capitals, of other letters and of digits each as one character."""
    raw, offsets = text_bytes(column)
    rows = len(offsets) - 1
    inside = ~IS_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = _CLASS[raw]
    kept = inside.copy()
    kept[1:] &= (kind[1:] != kind[:-1]) | begins[1:]
    place = np.append(0, np.cumsum(kept))
    word = Prefix(SYMBOLS[raw]).of(start, end)
    shape = Prefix(SYMBOLS[kind[kept]]).of(place[start], place[end])
    first = np.searchsorted(start, offsets)
    last = np.zeros(len(word), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    out = np.empty((len(word), 4), U)
    out[:, 0], out[:, 1] = mix(word ^ U(1)), mix(shape ^ U(2))
    after = lambda x: np.where(last, U(0), np.append(x[1:], U(0)))
    out[:, 2], out[:, 3] = mix(word * U(31) + after(word) + U(3)), mix(shape * U(37) + after(shape) + U(4))
    return (out >> U(64 - BITS)).astype(np.int64).ravel(), first * 4


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each sampled text and their shares."""
    for batch in batches:
        for i, j in pieces(batch, "text"):
            part = batch.slice(i, j - i)
            f, first = features(part.column("text"))
            at, share = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                u, n = np.unique(f[a:b], return_counts=True)
                at.append(u.astype(np.int32).tobytes())
                share.append((n * (4.0 / max(1, b - a))).astype(np.float32).tobytes())
            yield pa.record_batch([part.column("mark"), part.column("label"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["mark", "label", "at", "share"])


@dataclass
class Learner:
    """FTRL-proximal, one rate for each weight; z sums gradients, n their squares."""

    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, share: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ share, -35, 35)))
        g = (p - label) * share
        n = self.n[at]
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def _fit(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]  # 8 bytes a feature of SAMPLE_BYTES of text
        rows.sort()  # rows that are the same throughout may change places
        learner, bias = Learner(), 1 << BITS
        for epoch in range(epochs):
            for i in np.random.default_rng(SEED + epoch).permutation(len(rows)):
                _, label, at, share = rows[i]
                learner.learn(np.append(np.frombuffer(at, np.int32), bias), np.append(np.frombuffer(share, np.float32).astype(np.float64), 1.0), label)
        yield pa.record_batch([pa.array([learner.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    return run


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, epochs: int = 4) -> np.ndarray:
    """The weights learnt from at most `sample` labelled documents of at most `sample_bytes` in all, chosen by a hash of their ids, none of them held out.

    docs: (id, text); labels: (id, label). Rows without id or label are left out; of several labels of an id, the largest counts. Documents are taken in the order of the hash up to the first that would exceed the bytes, each as a whole. Without any labels every weight is 0."""
    chosen = labels.where("id is not null and label is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.join(docs.select("id").distinct(), "id", "left_semi").withColumn("mark", F.xxhash64("id", F.lit(SEED))).orderBy("mark", "id").limit(sample)
    joined = docs.join(F.broadcast(chosen), "id").select("id", "mark", "label", F.coalesce("text", F.lit("")).alias("text"))  # at most `sample` small rows
    sizes = joined.groupBy("mark", "id").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("sofar", F.sum("bytes").over(W.orderBy("mark", "id")))
    within = sizes.where(F.col("sofar") <= sample_bytes).select("mark", "id")  # one row for each of at most `sample` ids
    texts = joined.join(F.broadcast(within), ["mark", "id"], "left_semi").select("mark", "label", "text")
    ready = in_batches(texts, _weighed, "mark long, label int, at binary, share binary")
    fitted = in_batches(ready.coalesce(1), _fit(epochs), "weights binary").collect()  # at most sample rows of sample_bytes of text
    return np.frombuffer(fitted[0]["weights"], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def fit_named(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """fit() for tables whose columns have other names."""
    return fit(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), sample=sample)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col after its columns: the probability of label 1 for each row, from its whole text. A null text counts as empty and gets the score of the bias alone. docs has no column score_col."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for batch in batches:
            for i, j in pieces(batch, text_col):
                part = batch.slice(i, j - i)
                f, first = features(part.column(text_col))
                n = np.diff(first)
                total = np.zeros(len(n))
                if len(f):  # each row's own sum, so that a score doesn't depend on the rows beside it
                    total[n > 0] = np.add.reduceat(w[f], first[:-1][n > 0])
                x = total * 4.0 / np.maximum(n, 1) + w[-1]
                yield pa.record_batch([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=[*part.schema.names, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return in_batches(docs, run, schema)


def classify(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Every document's quality by a model fitted on a bounded sample of the labelled ones.

    Returns (id, held_out, score, predicted) for each row; held_out rows (crc32 of the id mod 5 is 0) are never learnt from. Null or empty texts are scored by the bias alone. A null id is not held out. Repeated rows are scored alike. An empty table gives an empty result. No other column of df is read."""
    docs, weights = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fit_named(df, labels, id_col, text_col, label_col, sample)
    out = score(docs, weights).drop("text")
    return out.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
