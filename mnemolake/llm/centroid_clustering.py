"""Centroid clustering with weighted deduplication.

Vectors are quantised to whole numbers, and identical ones become one row with their number.
Lloyd's rounds run over those rows alone: each task assigns its rows to the nearest centroid
and gives one row of integer sums, weighted by the numbers, for each cluster and dimension,
which are added up by a partial aggregate. Only centroids, of a fixed number, pass through
the driver. At the end the assignments are joined back to the ids. All sums are of whole
numbers, so the outcome does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native
from .hard_negatives import quantised
from .store import Scratch

CLUSTERS, ROUNDS, DIMENSIONS, SEED = 40, 5, 64, 2
#: Distances that a worker holds at once.
_SLICE = 1 << 20
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number on ties, computed in whole numbers."""
    most = max(np.abs(x.astype(np.float64)).max(initial=0.0), np.abs(centroids.astype(np.float64)).max(initial=0.0))
    kind = np.float64 if 4 * most * most * x.shape[1] < _EXACT else object
    a, c = x.astype(kind), centroids.astype(kind)
    squares = (c * c).sum(axis=1)
    step = max(1, _SLICE // len(c))
    numbers, distances = [], []
    for low in range(0, len(a), step):
        own = a[low : low + step]
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + squares[None, :]
        at = np.argmin(d, axis=1)
        numbers.append(at)
        distances.append(np.minimum(d[np.arange(len(at)), at], _LONG if kind is object else np.inf).astype(np.int64))
    return (np.concatenate(numbers), np.concatenate(distances)) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (number of vectors, sums of components) over distinct vectors v with their number n; of clusters that have any."""
    k, dimensions = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), object)  # whole numbers of any size, one table for each task
        for batch in batches:
            x = _matrix(batch, dimensions)
            n = batch.column(1).to_numpy()
            cluster, _ = _nearest(x, centroids)
            whole = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            small = np.abs(whole.astype(np.float64)).max(initial=0.0) * float(n.sum()) < _LONG / 2
            weighted = whole * n[:, None] if small else whole.astype(object) * n.astype(object)[:, None]
            part = np.zeros((k, dimensions + 1), weighted.dtype)
            np.add.at(part, cluster, weighted)
            total += part.astype(object)
        held = [(c, d, total[c, d]) for c in range(k) if total[c, dimensions] for d in range(dimensions + 1)]
        yield pa.record_batch([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array([Decimal(x[2]) for x in held], pa.decimal128(38, 0))], ["cluster", "dim", "part"])

    found: dict[int, list[int]] = {}
    parts = vectors.select("v", "n").mapInArrow(rows, "cluster int, dim int, part decimal(38,0)")
    for r in parts.groupBy("cluster", "dim").agg(F.sum("part").alias("total")).collect():  # clusters times dimensions
        found.setdefault(r["cluster"], [0] * (dimensions + 1))[r["dim"]] = int(r["total"])
    return {c: (x[-1], x[:-1]) for c, x in found.items()}


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = _nearest(_matrix(batch, centroids.shape[1]), centroids)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["v", "n", "cluster", "distance"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("v", "n").mapInArrow(rows, f"v {kind}, n long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """One row for each vector that is kept: id, cluster, distance, cluster_inertia, inertia, centroid (array of whole numbers).

    Kept are those with ``dimensions`` components, none null or not finite, quantised to
    floor(256 * x). The first centroids are the kept vectors of the least SHA-256 of
    ``seed:id``, ties by the vector; repeated rows count each, and where there are fewer vectors
    than ``clusters``, or none with an id, there are as many centroids as there are. A vector
    with a null id is assigned like others but starts no cluster; if there is no centroid at all,
    there are no rows. Components beyond 9.2e18 become that, distances and sums of them beyond a
    long's range its end. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(native.quoted(id_col).alias("_id"), quantised(native.quoted(vector_col)).alias("v")).filter(F.size("v") == dimensions)
    # the narrowest type that holds every component, as vectors are what is shuffled
    most = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    rows = rows.withColumn("v", F.col("v").cast("array<smallint>" if most is not None and most < 1 << 15 else "array<bigint>"))
    text = F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string"))
    first = rows.filter("_id IS NOT NULL").select(F.sha2(text.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    distinct = scratch.written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dimensions)
    for _ in range(rounds if first else 0):
        for c, (n, sums) in _sums(distinct, centroids).items():
            centroids[c] = [x // n for x in sums]
    if not first:
        distinct = distinct.limit(0)
        centroids = np.zeros((1, dimensions), np.int64)
    assigned = scratch.written(_assigned(distinct, centroids))
    by_cluster = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("total")).collect()}
    number = lambda x: F.lit(min(x, _LONG)).cast("long")
    held = native.join_split(rows, assigned, "v", "n")
    lookup = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return held.select(
        F.col("_id").alias(id_col), "cluster", "distance",
        lookup([number(by_cluster.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"),
        number(sum(by_cluster.values())).alias("inertia"),
        lookup([F.lit(",".join(map(str, c))) for c in centroids.tolist()]).alias("centroid"),
    )


def _sql_oracle() -> str:
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        "vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = "
        f"{DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v FROM vectors WHERE vec_id IS NOT NULL ORDER BY k LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS best FROM (SELECT v.rowid AS id, v.vec_id, v.v, {distance} AS d, c.k FROM numbered v CROSS JOIN c{r} c) GROUP BY id, vec_id)")
        if r < ROUNDS:
            # floor of a quotient: what is left over is never negative
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(
                f"s{r} AS (SELECT k, list({mean} ORDER BY dim) AS v FROM (SELECT best.k AS k, dim, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT best, unnest(v) AS x, unnest(range(len(v))) AS dim FROM a{r}) GROUP BY best.k, dim) GROUP BY k)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} ON s{r}.k = c{r}.k)")
    parts.insert(1, "numbered AS MATERIALIZED (SELECT row_number() OVER () AS rowid, * FROM vectors)")
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, a.best.k::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.k))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.best.k"
    )


ORACLE_SQL = _sql_oracle()
