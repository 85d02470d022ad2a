"""Quality classifier: a factorisation machine.

A document's features are its hashed words, weighted by log frequency and scaled to
length 1, and one bin for each structure statistic and each size (the metadata). The
machine adds to a linear score the interaction of every pair of features through K
factors, in linear time: half the sum over factors of the square of the sum less the sum
of squares. It is trained by AdaGrad on a bounded sample of labelled documents, which is
the only data that reaches the driver; every document is scored in sparse numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, words

#: The most labelled rows that the machine is trained on, those of the least MD5 of their id.
SAMPLE = 4000
WORD_BUCKETS = 1 << 13
BINS = 12
K = 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 1e-4
ACCEPT = 0.7
#: (name, low, high) of each statistic; it is put into one of BINS equal bins.
STATISTICS = (
    ("log_bytes", 0.0, 18.0),
    ("log_words", 0.0, 16.0),
    ("log_lines", 0.0, 12.0),
    ("bytes_per_word", 0.0, 16.0),
    ("words_per_line", 0.0, 60.0),
    ("upper_share", 0.0, 0.6),
    ("digit_share", 0.0, 0.3),
    ("symbol_share", 0.0, 0.2),
    ("exclamation_share", 0.0, 0.15),
    ("punctuation_share", 0.0, 0.2),
    ("beyond_ascii_share", 0.0, 0.5),
    ("distinct_share", 0.0, 1.0),
    ("repeat_share", 0.0, 0.6),
)
FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[[ord(c) for c in characters]] = 1
    return out


_CLASSES = (
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#*$%&|<>"), _class("!"), _class(".,;:?'\"()-"), _class("\n"),
    np.array([0.0] * 128 + [1.0] * 128, np.float32),
)


@dataclass
class Sparse:
    """Rows of features: row j has index[first[j]:first[j + 1]] with value."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray


def features(w: words.Words) -> Sparse:
    """The features of the texts of a slice."""
    n = len(w.first) - 1
    counts = w.counts
    sums = [np.concatenate([[0.0], np.cumsum(c[w.data], dtype=np.float64)]) for c in _CLASSES]
    upper, digit, symbol, exclamation, punctuation, lines, beyond = (s[w.offsets[1:]] - s[w.offsets[:-1]] for s in sums)
    size = np.diff(w.offsets).astype(np.float64)
    owner = w.owner()
    key = owner * WORD_BUCKETS + (w.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    found, tf = np.unique(key, return_counts=True)
    row, bucket = found // WORD_BUCKETS, found % WORD_BUCKETS
    distinct = np.bincount(row, minlength=n)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    at_least_1 = lambda x: np.maximum(x, 1)
    stats = np.stack(
        [np.log1p(size), np.log1p(counts), np.log1p(lines), size / at_least_1(counts), counts / (lines + 1)]
        + [x / at_least_1(size) for x in (upper, digit, symbol, exclamation, punctuation, beyond)]
        + [distinct / at_least_1(counts), np.bincount(owner[again], minlength=n) / at_least_1(counts)],
        axis=1,
    )
    low, high = (np.array([s[k] for s in STATISTICS]) for k in (1, 2))
    bins = np.clip((stats - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
    bins += WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS
    x = np.log1p(tf)
    norm = np.sqrt(np.bincount(row, weights=x * x, minlength=n))
    index = np.concatenate([bucket, bins.ravel()])
    value = np.concatenate([x / norm[row], np.full(bins.size, len(STATISTICS) ** -0.5)])
    rows = np.concatenate([row, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(rows, kind="stable")
    return Sparse(index[order], value[order].astype(np.float32), np.searchsorted(rows[order], np.arange(n + 1)))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, x: Sparse) -> np.ndarray:
        """Probability of label 1 for each row; every row has features."""
        first = x.first[:-1]
        weighted = self.factors[x.index] * x.value[:, None]
        total = np.add.reduceat(weighted, first)
        squares = np.add.reduceat(weighted * weighted, first)
        y = self.bias + np.add.reduceat(self.linear[x.index] * x.value, first) + 0.5 * (total * total - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))


def train(x: Sparse, labels: np.ndarray, seed: int = 1) -> Machine:
    """A machine fitted to the rows; without rows it scores 0.5, pairs aside."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, K)).astype(np.float32))
    seen_linear, seen_factors, seen_bias = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, K), 1e-3, np.float32), 1e-3
    sizes = np.diff(x.first)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            rows = order[low : low + BATCH]
            first = np.concatenate([[0], np.cumsum(sizes[rows])])
            take = np.concatenate([np.arange(x.first[j], x.first[j + 1]) for j in rows])
            batch = Sparse(x.index[take], x.value[take], first)
            error = ((m.scores(batch) - labels[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(error, sizes[rows])
            weighted = m.factors[batch.index] * batch.value[:, None]
            total = np.repeat(np.add.reduceat(weighted, first[:-1]), sizes[rows], axis=0)
            touched, inverse = np.unique(batch.index, return_inverse=True)
            grad = np.zeros((len(touched), K + 1), np.float32)
            np.add.at(grad, inverse, np.column_stack([(each * batch.value)[:, None] * (total - weighted), each * batch.value]))
            grad[:, :K] += DECAY * m.factors[touched]
            grad[:, K] += DECAY * m.linear[touched]
            seen_factors[touched] += grad[:, :K] ** 2
            seen_linear[touched] += grad[:, K] ** 2
            m.factors[touched] -= RATE * grad[:, :K] / np.sqrt(seen_factors[touched])
            m.linear[touched] -= RATE * grad[:, K] / np.sqrt(seen_linear[touched])
            seen_bias += float(error.sum()) ** 2
            m.bias -= RATE * float(error.sum()) / seen_bias**0.5
    return m


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text is ``fold`` modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(native.quoted(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine trained on at most ``sample`` labelled documents outside the held-out fold.

    An id with several labels counts once, with the least, and one with several texts with the
    least text; null labels are passed over. Without labels the machine knows no words.
    """
    known = labels.select(native.quoted(id_col).alias("_id"), native.quoted(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.filter(~held_out("_id")).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = F.broadcast(known.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample))
    rows = docs.select(native.quoted(id_col).alias("_id"), native.quoted(text_col).alias("_text")).join(chosen, "_id")
    rows = rows.groupBy("_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")).select("_id", "_label", "_text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, w in words.slices(batch.column(2), lower=True):
                x = features(w)
                parts = [(x.index[i:j].astype(np.int32).tobytes(), x.value[i:j].tobytes()) for i, j in zip(x.first[:-1], x.first[1:])]
                yield pa.record_batch(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                    ["_id", "_label", "index", "value"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    found = {r._id: r for r in rows.mapInArrow(sparse, f"_id {kind}, _label int, index binary, value binary").collect()}
    found = [found[k] for k in sorted(found)]
    index = np.concatenate([np.frombuffer(r["index"], np.int32) for r in found]).astype(np.int64) if found else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in found]) if found else np.zeros(0, np.float32)
    first = np.concatenate([[0], np.cumsum([len(r["index"]) // 4 for r in found])]).astype(np.int64)
    return train(Sparse(index, value, first), np.array([r["_label"] for r in found], np.float64))


def _scored(texts: pa.Array, machine: Machine) -> np.ndarray:
    parts = [machine.scores(features(w)) for _, _, w in words.slices(texts, lower=True)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row for each row of ``docs``: the id, held_out, score, predicted (1 if score >= ``accept``).

    A null text counts as an empty one, which is scored from its statistics. Ids are passed
    on, null or repeated; only the text is an input of the score, and all of it: features of a
    very long text take memory in proportion to its words. An empty table gives no rows. Other
    columns are not read.
    """
    own = docs.select(native.quoted(id_col).alias("_id"), held_out(id_col).alias("held_out"), native.quoted(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scored(batch.column(2), shared.value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= accept).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(rows, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def keep_quality(docs: DataFrame, machine: Machine, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the machine accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(place), shared.value) >= accept))

    return docs.mapInArrow(rows, docs.schema)
