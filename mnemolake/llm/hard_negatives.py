"""Hard negatives by distributed radix selection.

Every anchor gets its nearest rows of the same label as positives, and each (anchor,
positive) opens a window of scores in which negatives are hard. The best scores of a window
are found without gathering it: each pair of a block of anchors and a block of rows gives
an integer histogram of the window's scores, the histograms of all blocks are added up, the
bucket that holds the k-th score is found, and the next round cuts that bucket into finer
ones, until it is one score wide. Only then are rows gathered: those above the k-th score, of
which there are fewer than k, and of those with just that score at most as many as are
missing, by id, from each block.

A histogram is cut off, in its block, below the bucket in which the block's own count reaches
what is missing: the k-th score of all blocks lies in that bucket or above it, so nothing
that is cut off could be chosen. So a block gives at most k buckets for each window, and
ties, however many, never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import native
from .store import Scratch, written

POSITIVES, NEGATIVES = 5, 10
#: Negatives score between these shares, in percent, of what their positive scores.
LOW, HIGH = 30, 90
#: Buckets of a round are this many bits finer than those of the round before.
DIGIT = 8
#: Rows and components of one block of anchors or of rows, about, and scores that a worker holds at once.
BLOCK_ROWS, BLOCK_COMPONENTS, PRODUCT = 16384, 1 << 20, 1 << 21
#: Whole numbers up to here are exact as doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long, within 9.2e18; null if the vector or a component is null or not finite."""
    double = F.transform(vector, lambda x: x.cast("double"))
    whole = vector.isNotNull() & F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    edge = F.lit(9.2e18)  # so that it fits a long
    return F.when(whole, F.transform(double, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x, edge), -edge))))


def _blocks(rows: DataFrame, anchor: Column, block_rows: int) -> tuple[int, int]:
    """Numbers of blocks of anchors and of rows, by counted rows and components; the rows make as many as there are shuffle partitions, if there are enough."""
    size = F.size("v")
    n, components, anchors, own = rows.agg(F.count(F.lit(1)), F.sum(size), F.count_if(anchor), F.sum(F.when(anchor, size))).first()
    blocks = lambda n, components: max(1, -(-n // block_rows), -(-(components or 0) // BLOCK_COMPONENTS))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks(anchors, own), max(blocks(n, components), min(tasks, -(-n // 256)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), dim)


def _products(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, inner products) of slices of a with all of b, as whole numbers; beyond a long's range, its ends."""
    step = max(1, PRODUCT // max(1, len(b)))
    # in floats: the magnitude of the least long is none
    bound = (np.abs(a.astype(np.float64)).max(initial=0.0) * np.abs(b.astype(np.float64)).max(initial=0.0)) * max(1, a.shape[1])
    x, y = (a.astype(np.float64), b.astype(np.float64).T) if bound < _EXACT else (a.astype(object), b.astype(object).T)
    for low in range(0, len(a), step):
        s = x[low : low + step] @ y if a.shape[1] else np.zeros((len(x[low : low + step]), len(b)))
        yield low, s.astype(np.int64) if s.dtype != object else np.clip(s, -_LONG - 1, _LONG).astype(np.int64)


def _paired(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], work, schema: str) -> DataFrame:
    """``work(anchors, rows)`` for every pair of a block of anchors and a block of rows with vectors of one length."""
    n_anchors, n_rows = blocks
    # named anew, as both sides come from one table
    a = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumns({"dim": F.size("v"), "i": F.pmod("key", F.lit(n_anchors)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))})
    b = rows.withColumns({"dim": F.size("v"), "i": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))), "j": F.pmod("key", F.lit(n_rows)).cast("int")})
    out = StructType.fromDDL(schema)
    names = [f.name for f in out]

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        dim = key[0].as_py()
        parts = list(work(left, right, _matrix(left["v"], dim), _matrix(right["v"], dim)))
        return pa.table({n: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, (n, t) in enumerate(zip(names, kinds))})

    kinds = [pa.int64() for _ in names]
    count = max(n_anchors * n_rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return a.repartition(count, "dim", "i", "j").groupBy("dim", "i", "j").cogroup(b.repartition(count, "dim", "i", "j").groupBy("dim", "i", "j")).applyInArrow(one, out)


def _best_of_label(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], k: int) -> DataFrame:
    """anchor, anchor_id, label, positive_id, positive_key, positive_score: the first k rows of each anchor's label but itself; a block gives at most k for an anchor."""

    def work(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        keys = right["key"].to_numpy()
        order = np.lexsort((keys, ids))  # equal scores are then in order of the id
        ids, labels, keys, b = ids[order], labels[order], keys[order], b[order]
        own, own_id, own_label = left["key"].to_numpy(), left["vec_id"].to_numpy(), left["label"].to_numpy()
        for low, scores in _products(a, b):
            for r in range(len(scores)):
                at = np.flatnonzero((labels == own_label[low + r]) & (ids != own_id[low + r]))
                at = at[np.argsort(~scores[r][at], kind="stable")[:k]]  # ~ turns the order round and doesn't overflow
                if len(at):
                    yield np.full(len(at), own[low + r]), np.full(len(at), own_id[low + r]), ids[at], keys[at], scores[r][at]

    found = _paired(anchors.select("vec_id", "label", "key", "v"), rows, blocks, work, "anchor long, anchor_id long, positive_id long, positive_key long, positive_score long")
    rank = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    return found.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k).drop("_rank")


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """The anchors that have windows, each with its own as an array: there are at most as many as positives."""
    state = ("positive_key", "low", "high", "need")
    own = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(*state))).alias("w")).select(F.col("anchor").alias("key"), *(F.col(f"w.{c}").alias(c) for c in state))
    return anchors.join(own, "key")


def _histograms(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], shift: int) -> DataFrame:
    """anchor, positive_key, bucket, n: counts of the scores of rows of other labels by window and bucket, from its high end; a bucket is 2 ** shift scores."""

    def work(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        labels = right["label"].to_numpy()
        own, own_label = left["key"].to_numpy(), left["label"].to_numpy()
        state = [left[c].to_pylist() for c in ("positive_key", "low", "high", "need")]
        for low, scores in _products(a, b):
            for r in range(len(scores)):
                s = np.sort(scores[r][labels != own_label[low + r]])
                for positive, lo, hi, need in zip(*(c[low + r] for c in state)):
                    end = np.searchsorted(s, hi, "right")
                    start = max(np.searchsorted(s, lo, "left"), end - need)
                    if start < end:
                        bucket, n = np.unique((hi - s[start:end]).astype(np.uint64) >> np.uint64(shift), return_counts=True)
                        yield np.full(len(n), own[low + r]), np.full(len(n), positive), bucket.astype(np.int64), n

    return _paired(anchors, rows, blocks, work, "anchor long, positive_key long, bucket long, n long")


def _refined(windows: DataFrame, histograms: DataFrame, shift: int) -> DataFrame:
    """The windows, each cut to the bucket that holds its k-th score, with what is still missing there.

    A window with fewer rows than are missing stays as it is and is closed: it is gathered whole.
    """
    total = histograms.groupBy("anchor", "positive_key", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("anchor", "positive_key").orderBy("bucket")
    total = total.withColumn("upto", F.sum("n").over(upto))
    joined = windows.join(total, ["anchor", "positive_key"], "left")
    hit = F.col("upto") >= F.col("need")
    cut = joined.groupBy(*windows.columns).agg(F.min(F.when(hit, F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")))).alias("at"))
    width = F.lit(1 << shift)
    high = F.col("high") - F.col("at.bucket") * width
    return cut.select(
        *(c for c in windows.columns if c not in ("low", "high", "need", "open")),
        F.when(F.col("at").isNotNull(), F.greatest(F.col("low"), high - width + 1)).otherwise(F.col("low")).alias("low"),
        F.when(F.col("at").isNotNull(), high).otherwise(F.col("high")).alias("high"),
        F.when(F.col("at").isNotNull(), F.col("need") - F.col("at.before")).otherwise(F.col("need")).alias("need"),
        (F.col("open") & F.col("at").isNotNull()).alias("open"),
    )


def _gathered(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """anchor, positive_key, negative_id, negative_key, negative_score: of each window, rows over ``low``, and of those at ``low`` the ``need`` of the least ids of a block."""

    def work(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        ids, labels, keys = right["vec_id"].to_numpy(), right["label"].to_numpy(), right["key"].to_numpy()
        order = np.lexsort((keys, ids))
        ids, labels, keys, b = ids[order], labels[order], keys[order], b[order]
        own, own_label = left["key"].to_numpy(), left["label"].to_numpy()
        state = [left[c].to_pylist() for c in ("positive_key", "low", "high", "need")]
        for low, scores in _products(a, b):
            for r in range(len(scores)):
                s, other = scores[r], labels != own_label[low + r]
                for positive, lo, hi, need in zip(*(c[low + r] for c in state)):
                    at = np.concatenate([np.flatnonzero(other & (s > lo) & (s <= hi)), np.flatnonzero(other & (s == lo))[:need]])
                    if len(at):
                        yield np.full(len(at), own[low + r]), np.full(len(at), positive), ids[at], keys[at], s[at]

    return _paired(anchors, rows, blocks, work, "anchor long, positive_key long, negative_id long, negative_key long, negative_score long")


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has whole-number ids and labels and arrays of numbers, quantised to floor(256 * x);
    ``anchor`` is a condition on the columns ``vec_id`` and ``label``. Scores are integer inner
    products. An anchor's positives are its ``positives`` best other rows of its label; for each,
    the ``negatives`` best rows of other labels with low * p <= 100 * n <= high * p are returned.
    Ties go to the smaller id.

    Rows with a null id, label or vector, or a component that is null or not finite, take no
    part. Only vectors of the same length are compared; empty ones score 0. Rows that are equal
    in id, label and quantised vector count once; rows of one id that differ are separate, and
    ties between them go by a hash of both. A row is never the positive of another of its id. An
    empty table, and an anchor without positives or negatives, gives no rows. Components beyond
    9.2e18 become that, scores beyond a long's range its ends. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(native.whole_number(vectors, id_col).alias("vec_id"), native.whole_number(vectors, label_col).alias("label"), quantised(native.quoted(vector_col)).alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct()
    rows = scratch.written(rows.withColumn("key", F.xxhash64("vec_id", "label", "v")))
    blocks = _blocks(rows, anchor, block_rows)
    anchors = rows.filter(anchor)
    best = scratch.written(_best_of_label(anchors, rows, blocks, positives))
    p = F.col("positive_score").cast("decimal(38,0)")
    bounds = {"low": F.ceil(p * low / 100), "high": F.floor(p * high / 100)}
    windows = best.select("anchor", "positive_key", *(x.cast("long").alias(c) for c, x in bounds.items()), F.lit(negatives).cast("long").alias("need"), F.lit(True).alias("open"))
    # a window that no score fits has no rows; one that fits is 1 wide at least
    windows = scratch.written(windows.filter("low <= high"))
    widest = windows.agg(F.max((F.col("high").cast("decimal(38,0)") - F.col("low")))).first()[0]
    bits = int(widest).bit_length() if widest is not None else 0
    while bits > 0:
        shift = max(0, bits - DIGIT)
        open_windows = _with_windows(anchors, windows.filter("open"))
        refined = scratch.written(_refined(windows.filter("open"), _histograms(open_windows, rows, blocks, shift), shift).unionByName(windows.filter("NOT open")))
        scratch.drop(windows)
        windows, bits = refined, shift
    original = best.withColumn("high", bounds["high"].cast("long"))
    gather = windows.select("anchor", "positive_key", "low", "need").join(original.select("anchor", "positive_key", "high"), ["anchor", "positive_key"])
    found = _gathered(_with_windows(anchors, gather), rows, blocks)
    rank = Window.partitionBy("anchor", "positive_key").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    ranked = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= negatives)
    out = ranked.join(original, ["anchor", "positive_key"])
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    scratch.drop()
    return out


ORACLE_SQL = f"""WITH rows AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM scored WHERE same) WHERE k <= {POSITIVES}
), negatives AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
) SELECT * FROM negatives WHERE rank <= {NEGATIVES}"""
