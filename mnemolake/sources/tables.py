"""Tables on storage, and the memory relation over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The central relation; vectors are arrays of one length for a table.
MEMORY_SCHEMA = (
    "id BIGINT, user_id STRING, session_id STRING, content STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "last_accessed_at TIMESTAMP, importance DOUBLE, access_count INT, type INT, content_hash STRING, topics ARRAY<STRING>, "
    "entities ARRAY<STRING>, metadata MAP<STRING, STRING>, is_deleted BOOLEAN"
)
TYPES = ("episodic", "semantic", "procedural", "fact")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True, tombstones: bool = True) -> DataFrame:
    """Documents as memories: their source is the tenant, embeddings and labels come by id.

    Without ``vectors`` or ``tombstones`` their joins, and columns, are left out: a scan of
    the texts then needs no shuffle.
    """
    rows = table(spark, sf_dir, "documents")
    if vectors:
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    if tombstones:
        rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    columns = {
        "id": F.col("doc_id"),
        "user_id": F.col("source"),
        "session_id": F.concat(F.lit("s"), F.floor(F.col("doc_id") / 50).cast("bigint").cast("string")),
        "content": F.col("text"),
        "embedding": F.col("embedding") if vectors else None,
        "created_at": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60),
        "access_count": (F.col("doc_id") % 101).cast("int"),
        "importance": (F.col("doc_id") % 11) / F.lit(10.0),
        "type": (F.floor(F.col("doc_id") / 20).cast("bigint") % 4).cast("int"),
        "is_deleted": F.coalesce("toxic", F.lit(0)) == 1 if tombstones else None,
        "lang": F.col("lang"),
    }
    return rows.select(*(c.alias(k) for k, c in columns.items() if c is not None))


#: The same relation for DuckDB, as the body of a common table expression.
MEMORIES_SQL = """memories AS (
  SELECT d.doc_id AS id, d.source AS user_id, 's' || CAST(CAST(floor(d.doc_id / 50) AS BIGINT) AS VARCHAR) AS session_id, d.text AS content,
    e.embedding, make_timestamp((1704067200 + d.doc_id * 60) * 1000000) AS created_at, CAST(d.doc_id % 101 AS INTEGER) AS access_count,
    (d.doc_id % 11) / 10.0::DOUBLE AS importance, CAST(CAST(floor(d.doc_id / 20) AS BIGINT) % 4 AS INTEGER) AS type,
    coalesce(l.toxic, 0) = 1 AS is_deleted, d.lang
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The last version of each key: a read-time upsert over appended rows."""
    every = F.struct(*version, *(c for c in df.columns if c not in version))
    return df.groupBy(key).agg(F.max_by(every, F.struct(*version)).alias("row")).select("row.*").select(*df.columns)
