"""Corpus pipeline: five operators over ``documents``, each on all that the one before kept.

Every stage takes null and empty texts, null ids and sources, repeated rows, texts of any
length, an empty table and further columns, and returns the columns that it was given; what
becomes of such rows is stated with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.decontamination import remove_leaks
from mnemolake.llm.line_dedup import line_dedup
from mnemolake.llm.minhash_dedup import keep_one_of_each
from mnemolake.llm.mixing import mix_sources
from mnemolake.llm.native import WORD
from mnemolake.llm.quality_classifier import fit, keep_quality
from mnemolake.llm.store import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the labels, accepts.

    Null and empty texts are scored by their statistics; equal texts are kept or dropped alike.
    """
    return keep_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line windows; ``n_chars`` follows the text.

    One that had words and loses them all goes; null and empty texts stay. Of equal windows
    that of the least id, null first, stays.
    """
    out = line_dedup(docs).filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates.

    Documents without words stay; repeated rows stay once, and of those without an id each text.
    """
    return keep_one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source, and documents of one id and source draw alike."""
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_windows),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained machine and a search have no SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
