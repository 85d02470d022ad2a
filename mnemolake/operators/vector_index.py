"""A vector index on storage: cells around k-means centroids, of which a search reads those nearest to its queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import PART_ROWS, batch_topk, nearest, units

#: Most cells, which bounds the centroids that are broadcast; rows of a larger table make larger cells.
MAX_CELLS = 1 << 14
#: Rows of the sample that centroids are fitted on, for each cell, and queries of the sample that recall is measured with.
SAMPLE_ROWS, SAMPLE_QUERIES = 64, 256
#: The share of the true neighbours that the number of probed cells is chosen for.
RECALL = 0.95


def _units(column: pa.Array) -> np.ndarray:
    return units(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


class VectorIndex:
    """An index under a folder: ``centroids`` (cell, centroid), ``cells`` (id, vector, in a folder for each cell) and ``settings`` (probes).

    Rows without a vector are not indexed; the others have vectors of one length. Centroids are
    fitted on a bounded sample, but every row is dealt to its nearest centroid. How many cells a
    search reads is measured when the index is built: so many that they hold ``RECALL`` of the
    nearest rows, by brute force over all rows, of a sample of queries. Scores are computed from
    the whole vectors, so what is found is ranked exactly.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, df: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL) -> int:
        """Index these rows alone; returns the number of cells that a search for the ``k`` nearest reads."""
        rows = self._rows(df, id_col, vector_col)
        n = rows.count()
        cells = max(1, min(MAX_CELLS, math.isqrt(n)))
        sample = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells * SAMPLE_ROWS)
        self._fit(sample, cells).write.mode("overwrite").parquet(f"{self.path}/centroids")
        self._write(rows, "overwrite")
        asked = sample.orderBy(F.md5(F.concat(F.lit("q"), F.col("id").cast("string"))), "id").limit(SAMPLE_QUERIES)
        probes = self._probes(asked.select(F.col("id").alias("query_id"), "vector"), rows, k, recall)
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/settings")
        return probes

    def add(self, df: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
        """More rows, dealt to the cells that are there; an id that the index has already is not replaced."""
        self._write(self._rows(df, id_col, vector_col), "append")

    @staticmethod
    def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return df.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))

    def _fit(self, sample: DataFrame, cells: int) -> DataFrame:
        points = sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")).filter(F.exists("vector", lambda x: x != 0))
        centres = KMeans(k=cells, maxIter=10, seed=1, distanceMeasure="cosine").fit(points).clusterCenters() if cells > 1 else [np.zeros(1)]
        return self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centroid array<double>").coalesce(1)

    def _centroids(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # at most MAX_CELLS
        c = np.array([r["centroid"] for r in found], np.float64)
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    def _ranked_cells(self, df: DataFrame, columns: list[str], most: int) -> DataFrame:
        """The rows (columns, vector) with the ``most`` cells nearest to each, as an array ``cells``, nearest first."""
        shared = self.spark.sparkContext.broadcast(self._centroids())

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                v = _units(batch.column(len(columns)))
                if len(c) == 1:
                    order = np.zeros((len(v), 1), np.int32)
                else:
                    scores = v @ c.T
                    m = min(most, len(c))
                    near = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                    order = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(scores, near, axis=1)), axis=1), axis=1)
                ends = pa.array(np.arange(len(v) + 1) * order.shape[1], pa.int32())
                yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(order.ravel(), pa.int32()))], [*columns, "vector", "cells"])

        kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*columns, "vector"])
        return df.select(*columns, "vector").mapInArrow(rows, f"{kinds}, cells array<int>")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = self._ranked_cells(rows, ["id"], 1).select("id", "vector", F.get("cells", F.lit(0)).alias("cell"))
        # a large cell is written by several tasks
        dealt.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(8))).repartition("cell", "_part").drop("_part").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def _probes(self, queries: DataFrame, rows: DataFrame, k: int, recall: float) -> int:
        """The fewest cells that hold ``recall`` of the queries' true neighbours."""
        every = len(self._centroids())
        true = batch_topk(queries, rows.withColumnRenamed("vector", "embedding"), k + 1).filter("query_id <> id").select("query_id", "id")
        near = true.join(self.spark.read.parquet(f"{self.path}/cells").select("id", "cell"), "id")
        ranked = near.join(self._ranked_cells(queries, ["query_id"], every), "query_id").select(F.array_position("cells", F.col("cell")).alias("place"))
        seen = ranked.groupBy("place").count().orderBy("place").collect()  # at most a row for each cell
        total, so_far = sum(r["count"] for r in seen), 0
        for r in seen:
            so_far += r["count"]
            if so_far >= recall * total:
                return int(r["place"])
        return every

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank: of the rows in the cells nearest to each query (query_id, vector), the k of the highest cosine, ties by id.

        Only the folders of probed cells are read. A cell's rows are dealt to parts of about
        ``PART_ROWS``, so that no task holds a large cell.
        """
        probes = probes or self.spark.read.parquet(f"{self.path}/settings").first()["probes"]
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
        asked = self._ranked_cells(asked, ["query_id"], probes).select("query_id", "vector", F.explode("cells").alias("cell"))
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        held = self.spark.read.parquet(f"{self.path}/cells").filter(F.col("cell").isin(wanted))
        parts = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # a row for each cell
        rows = held.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "id", "vector")
        asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "vector")

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf["side"].to_numpy() == 0
            q, x = pdf[own], pdf[~own]
            if not len(q) or not len(x):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            a, b = (units(np.stack(side["vector"].to_numpy())) for side in (q, x))
            return pd.DataFrame(dict(zip(("query_id", "id", "score"), nearest(q["id"].to_numpy(), a, x["id"].to_numpy(), b, k))))

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found = rows.unionByName(asked).repartition(n, "cell", "part").groupBy("cell", "part").applyInPandas(best, "query_id long, id long, score double")
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
