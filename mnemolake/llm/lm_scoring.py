"""Language-model scoring by a hashed maximum-entropy model.

The probability of a token is the product of those of the choices on its path. The first
choice is a class. The FREQUENT * SLOTS commonest tokens are dealt to classes by rank and
chosen there by slot. Every other token, known or not, belongs to one of TAIL classes by its
form and is chosen by digits of its hash, as many as leave about LEAF tokens of the
vocabulary together; among these it has its smoothed unigram share. Each choice is a softmax
over sums of weight rows, one row for each hashed feature: for classes the token before, the
two before, and the tokens two and three before (skips); for slots and digits the path so
far with the token before and with that two before. The number of rows follows the square
root of the training tokens.

Token counts come from all training documents. Weights start at the unigram distribution.
In each round every training document of the round is passed once under the weights of all:
observed and expected counts of each weight, whose difference is its gradient, are summed by
shuffle, and the weight moves by the logarithm of their ratio over the number of features,
as in iterative scaling. The sums, and so the model, don't depend on how documents are dealt.
Documents are scored in sparse numpy batches: those of a group together with the counts of
the group's distinct tokens, which come by a join, so that the vocabulary is never broadcast
and a common token is sent once for each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, words
from .store import checkpoint, freeing

FREQUENT, SLOTS, TAIL, DIGITS = 16, 64, 16, 32
CLASSES = FREQUENT + TAIL
#: Tokens of the vocabulary that share a leaf, about; at most so many digits, which bounds what the driver holds.
LEAF, MOST_LEVELS = 2048, 3
#: Bits of the number of weight rows of each kind of choice: half of those of the training tokens, and one, within these bounds.
LEAST_BITS, MOST_BITS = 8, 17
ROUNDS = 2
STEP_TOKENS = 1 << 15
#: Observations that a weight is given beforehand, spread as expected.
PRIOR = 10.0
#: Bytes of texts that one task passes in a round, at least, where there are more than two tasks for each core.
ROUND_BYTES = 128 << 20
#: Weights in one block of the exchange of sums; blocks of this many tasks are summed first.
BLOCK, FAN_IN = 1 << 14, 64
END = np.uint64(0x5BD1E995A5C3B7D1)
START = np.uint64(0x2545F4914F6CDD1D)
_SALTS = np.random.default_rng(11).integers(1, 1 << 63, 12, dtype=np.uint64) | np.uint64(1)
_LAST = np.full(256, 3, np.int64)
_LAST[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 0
_LAST[ord(".")], _LAST[ord(",")] = 1, 2


@dataclass
class Tokens:
    """Tokens of a slice, each text followed by its end: hash, form (tail class), text, and three tokens before."""

    hashes: np.ndarray
    form: np.ndarray
    owner: np.ndarray
    before: np.ndarray

    @property
    def n(self) -> int:
        return len(self.hashes)


def tokens(w: words.Words) -> Tokens:
    n_texts, owner = len(w.first) - 1, w.owner()
    at, ends = np.arange(len(owner)) + owner, w.first[1:] + np.arange(n_texts)
    total = len(owner) + n_texts
    hashes, form, of = np.empty(total, np.uint64), np.zeros(total, np.int64), np.empty(total, np.int64)
    beyond = np.concatenate([[0], np.cumsum(w.data >= 128)])
    hashes[at], hashes[ends] = w.hashes, END
    form[at] = (beyond[w.ends] > beyond[w.starts]) * 8 + _LAST[w.data[w.ends - 1]] * 2 + (w.ends - w.starts > 8)
    of[at], of[ends] = owner, np.arange(n_texts)
    place = np.arange(total) - (w.first[:-1] + np.arange(n_texts))[of]
    before = np.full((3, total), START)
    for k in range(1, 4):
        before[k - 1, k:] = np.where(place[k:] >= k, hashes[:-k], START)
    return Tokens(hashes, form, of, before)


@dataclass
class Model:
    """Frequent tokens (sorted hashes, and the rank of each); of each kind of choice the biases by node and the weights, a row for each outcome."""

    frequent: np.ndarray
    rank: np.ndarray
    levels: int
    biases: list[np.ndarray]  # (outcomes, nodes) of classes, of slots, and of each level of digits
    weights: list[np.ndarray]  # (outcomes, rows) of classes, of slots, and of all digits
    leaf: np.ndarray  # tokens + distinct tokens + 1 of each leaf

    def choices(self, t: Tokens, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind of weights, kind of bias, tokens, node, outcome, features) of the choices of tokens low:high; tokens count from low."""
        h = t.hashes[low:high]
        rank = words.Lookup(self.frequent, self.rank).get(h, -1)
        one, two, three = (b[low:high] for b in t.before)
        mask = np.uint64(self.weights[0].shape[1] - 1)
        row = lambda x: (words.mix(x) & mask).astype(np.intp)
        s = _SALTS
        every, common = np.arange(high - low), rank >= 0
        classes = np.where(common, rank // SLOTS, FREQUENT + t.form[low:high])
        yield 0, 0, every, np.zeros(len(every), np.intp), classes, np.stack([row(one * s[0]), row(one * s[1] + two * s[2]), row(two * s[3]), row(three * s[4])])
        at = np.flatnonzero(common)
        path = (classes[at] + 1).astype(np.uint64) * s[5]
        yield 1, 1, at, classes[at], rank[at] % SLOTS, np.stack([row(one[at] * s[6] + path), row(two[at] * s[7] + path)])
        at = np.flatnonzero(~common)
        node = t.form[low:high][at]
        for level in range(self.levels):
            path = (node + 1).astype(np.uint64) * s[8 + level]
            digit = _digit(h[at], level)
            yield 2, 2 + level, at, node, digit, np.stack([row(one[at] * s[6] + path), row(two[at] * s[7] + path)])
            node = node * DIGITS + digit

    def leaves(self, t: Tokens, low: int, high: int) -> np.ndarray:
        """The leaf of each of the tokens low:high, as if it were not frequent."""
        return leaf_of(t.hashes[low:high], t.form[low:high], self.levels)


def _digit(h: np.ndarray, level: int) -> np.ndarray:
    return (h >> np.uint64(20 + 5 * level) & np.uint64(DIGITS - 1)).astype(np.intp)


def leaf_of(h: np.ndarray, form: np.ndarray, levels: int) -> np.ndarray:
    leaf = form.astype(np.intp)
    for level in range(levels):
        leaf = leaf * DIGITS + _digit(h, level)
    return leaf


def _softmax(bias: np.ndarray, weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One column of probabilities for each token; weights lie in columns, so that each sum runs along memory."""
    y = np.take(weights, features[0], axis=1, mode="clip")
    y += bias
    for f in features[1:]:
        y += np.take(weights, f, axis=1, mode="clip")
    np.minimum(y, 60, out=y)
    np.exp(y, out=y)
    y /= y.sum(axis=0)
    return y


def log_probabilities(m: Model, t: Tokens, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each token given the tokens before it in its text; counts: of each in training."""
    out = np.empty(t.n)
    for low in range(0, t.n, STEP_TOKENS):
        high = min(t.n, low + STEP_TOKENS)
        p = np.ones(high - low)
        tail = np.zeros(0, np.intp)
        for kind, level, at, node, outcome, features in m.choices(t, low, high):
            p[at] *= _softmax(np.take(m.biases[level], node, axis=1), m.weights[kind], features)[outcome, np.arange(len(at))]
            tail = at if kind == 2 else tail
        p[tail] *= (counts[low:high][tail] + 1) / m.leaf[m.leaves(t, low, high)[tail]]
        out[low:high] = np.log10(np.maximum(p, 1e-300))
    return out


def new_sums(m: Model) -> list[np.ndarray]:
    """Zeros for the observed and expected counts of every weight."""
    return [np.zeros((2, *w.shape)) for w in m.weights]


def add_counts(m: Model, sums: list[np.ndarray], t: Tokens) -> None:
    """Add what a slice observes, and what the model expects of it."""
    for low in range(0, t.n, STEP_TOKENS):
        high = min(t.n, low + STEP_TOKENS)
        for kind, level, at, node, outcome, features in m.choices(t, low, high):
            if not len(at):
                continue
            p = _softmax(np.take(m.biases[level], node, axis=1), m.weights[kind], features)
            outcomes, rows = m.weights[kind].shape
            flat = features.ravel()
            np.add.at(sums[kind][0].reshape(-1), (features + outcome * rows).ravel(), 1.0)
            for k in range(outcomes):
                sums[kind][1][k] += np.bincount(flat, np.tile(p[k], len(features)), minlength=rows)


def update(m: Model, sums: list[np.ndarray]) -> None:
    """Move every weight by the log ratio of observed and expected counts over its number of features."""
    for w, (observed, expected), n in zip(m.weights, sums, (4, 2, 2)):
        given = PRIOR * expected / np.maximum(expected.sum(axis=0), 1e-30)
        w += np.where(expected > 0, np.log(np.maximum(observed + given, 1e-6) / np.maximum(expected + given, 1e-6)) / n, 0).astype(np.float32)


def start_model(top: list[tuple[int, int]], leaves: dict[int, tuple[int, int]], levels: int, bits: int) -> Model:
    """The unigram model: the commonest (hash, count), commonest first, and {leaf: (tokens, distinct)} of the others."""
    h = np.array([x for x, _ in top], np.int64).view(np.uint64)
    n = np.array([x for _, x in top], np.float64)
    order = np.argsort(h)
    mass = np.full((FREQUENT, SLOTS), 1e-9)
    mass.reshape(-1)[: len(n)] += n
    leaf = np.ones(TAIL * DIGITS**levels)
    for k, (tokens_in, distinct) in leaves.items():
        leaf[k] += tokens_in + distinct
    by_level = [leaf.reshape(TAIL * DIGITS**level, DIGITS, -1).sum(axis=2) for level in range(levels)]
    of_class = np.concatenate([mass.sum(axis=1), leaf.reshape(TAIL, -1).sum(axis=1)])
    shares = [of_class[None], mass, *by_level]
    biases = [np.log(x / x.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() for x in shares]
    return Model(h[order], order.astype(np.int64), levels, biases, [np.zeros((k, 1 << bits), np.float32) for k in (CLASSES, SLOTS, DIGITS)], leaf)


def sizes_for(n: int, v: int) -> tuple[int, int]:
    """(levels of digits, bits of the number of rows) for n training tokens, v of them distinct."""
    levels = next((k for k in range(1, MOST_LEVELS) if TAIL * DIGITS**k * LEAF >= v), MOST_LEVELS)
    return levels, min(MOST_BITS, max(LEAST_BITS, n.bit_length() // 2 + 1))


def _round_sums(docs: DataFrame, model: Model) -> list[np.ndarray] | None:
    """Observed and expected counts of every weight over the documents (_text); none without documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums, n = new_sums(m), 0
        for batch in batches:
            for _, _, w in words.slices(batch.column(0), lower=True):
                t = tokens(w)
                add_counts(m, sums, t)
                n += t.n
        if n:
            flat = np.concatenate([x.ravel() for x in sums]).astype(np.float32)
            blocks = range(0, len(flat), BLOCK)
            part = TaskContext.get().partitionId() // FAN_IN
            yield pa.record_batch([pa.array(list(range(len(blocks))), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([flat[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("sums")[0].as_py()) // 4)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_py(), np.float32)
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, sums binary"
    sent = docs.select("_text").mapInArrow(partial, "block int, part int, sums binary")
    with freeing(docs.sparkSession):
        rows = sent.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect()
    shared.unpersist()
    if not rows:
        return None
    flat = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows, key=lambda r: r["block"])])
    cuts = np.cumsum([2 * w.size for w in model.weights])
    return [x.reshape(2, *w.shape) for x, w in zip(np.split(flat, cuts[:-1]), model.weights)]


def token_counts(train: DataFrame) -> DataFrame:
    """h, form, n: occurrences of each token, ends included, in the column _text of training documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, w in words.slices(batch.column(0), lower=True):
                t = tokens(w)
                h, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                parts.append((h, t.form[first], n))
            if parts:
                h, form, n = (np.concatenate(x) for x in zip(*parts))
                found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                total = np.bincount(inverse, weights=n).astype(np.int64)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(form[first].astype(np.int32)), pa.array(total)], ["h", "form", "n"])

    return train.select("_text").mapInArrow(rows, "h long, form int, n long").groupBy("h").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text is ``fold`` modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(native.quoted(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_model(train: DataFrame, counts: DataFrame, n: int, v: int, tasks: int, rounds: int = ROUNDS) -> Model:
    """The model of training documents (_id, _text) with their token counts (h, form, n): n tokens, v of them distinct."""
    levels, bits = sizes_for(n, v)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT * SLOTS)
    frequent = [(r.h, r.n) for r in top.select("h", "n").collect()]
    leaf = F.col("form")
    for level in range(levels):
        leaf = leaf * DIGITS + F.shiftrightunsigned("h", 20 + 5 * level).bitwiseAND(F.lit(DIGITS - 1).cast("long"))
    rest = counts.join(F.broadcast(top.select("h")), "h", "left_anti").groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    model = start_model(frequent, {r.leaf: (r.n, r.v) for r in rest.collect()}, levels, bits)
    for k in range(rounds):
        part = train.filter(F.pmod(F.xxhash64("_id", F.lit("round")), F.lit(rounds)) == k)
        if sums := _round_sums(part.coalesce(tasks), model):
            update(model, sums)
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-case (A-Z) words and one end for each text; a null text is an empty one,
    of which the end is the only token. The model learns from rows outside the held-out fold.
    base_score is the add-one unigram log10 probability of the text, score that of the model;
    among unknown tokens of a form, both give one share to all. Without training rows both
    scores are those of an empty vocabulary. Rows that repeat are scored alike; null ids stay
    null. A very long text is scored whole, in slices. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(native.quoted(id_col).alias("_id"), held_out(id_col).alias("_held"), native.quoted(text_col).alias("_text"))
    groups, size = native.groups_by_bytes(own, "_text", partitions)
    train = own.filter(~F.col("_held"))
    counts = checkpoint(token_counts(train))
    n, v = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = n or 0
    model = fit_model(train, counts, n, v, max(2 * spark.sparkContext.defaultParallelism, -(-size // ROUND_BYTES)))
    shared = spark.sparkContext.broadcast(model)
    unit = np.log10(n + v + 1)
    dealt = own.withColumn("group", F.pmod(F.xxhash64("_id", "_text"), F.lit(groups)).cast("int"))

    def distinct(table: pa.Table) -> pa.Table:
        parts = [np.unique(w.hashes) for _, _, w in words.slices(table.column("_text"), lower=True)]
        h = np.unique(np.concatenate([*parts, np.array([END])]))
        return pa.table({"group": pa.array(np.full(len(h), table.column("group")[0].as_py(), np.int32)), "h": pa.array(h.view(np.int64))})

    def score(key, table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([table.column("_id"), table.column("_held"), *(pa.array([], x) for x in _TYPES)], names=_NAMES)
        h = known.column("h").to_numpy().view(np.uint64)
        known_counts = words.Lookup(h, known.column("n").to_numpy())
        columns = [[], [], [], []]
        for low, high, w in words.slices(table.column("_text"), lower=True):
            t, size = tokens(w), high - low
            times = known_counts.get(t.hashes)
            base = np.bincount(t.owner, np.log10(times + 1.0), minlength=size)
            n_tokens = np.bincount(t.owner, minlength=size)
            for column, x in zip(columns, (n_tokens, np.bincount(t.owner[times > 0], minlength=size), base - n_tokens * unit, np.bincount(t.owner, log_probabilities(shared.value, t, times), minlength=size))):
                column.append(x)
        n_tokens, n_known, base, model_score = (np.concatenate(x) for x in columns)
        values = [table.column("_id"), table.column("_held"), n_tokens, n_known, np.full(table.num_rows, n), base, model_score]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in values], names=_NAMES)

    kind = own.schema["_id"].dataType.simpleString()
    known = dealt.groupBy("group").applyInArrow(distinct, "group int, h long").join(counts.select("h", "n"), "h").select("group", "h", "n")
    out = dealt.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(
        score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("_id", id_col)


_NAMES = ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
