"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering as _centroid_clustering
from . import hard_negatives as _hard_negatives
from . import line_dedup as _line_dedup
from . import mixing as _mixing
from . import quality_rules as _quality_rules
from . import secret_scan as _secret_scan
from .decontamination import find_leaks
from .lm_scoring import score_documents
from .minhash_dedup import near_duplicates
from .pii_surrogates import replace_pii
from .quality_classifier import fit, score_quality
from .quality_rules import MEASURES, apply_policy, rule_ledger
from .secret_scan import scan_secrets, spans_text
from .store import written
from .substring_dedup import substring_dedup
from .url_filters import judge_urls, mine_rules


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(written(rule_ledger(_documents(spark, sf_dir))))
    first = ["doc_id", *MEASURES[:5], "base_failed", "kept"]
    return judged.select(*first, *(c for c in judged.columns if c not in first))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup.line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed_lines", "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix_report(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_documents(spark, sf_dir)).select("doc_id", "n_entities", "text")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))
    base = F.sha2(F.encode(spans_text(F.col("base_spans")), "utf-8"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base, spans_text(F.col("spans")).alias("spans"), "n_entropy")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    noisy = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    found = _hard_negatives.mine_hard_negatives(noisy, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _centroid_clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    rules = mine_rules(pages, labels, (F.col("quality") == 0) | (F.col("toxic") == 1), whole=True)
    return judge_urls(pages, rules)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_url_filters": op13_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality_rules.ORACLE_SQL,
    "op2_line_dedup": _line_dedup.ORACLE_SQL,
    "op3_mixing": _mixing.ORACLE_SQL,
    "op8_secret_scan": _secret_scan.ORACLE_SQL,
    "op11_hard_negatives": _hard_negatives.ORACLE_SQL,
    "op12_centroid_clustering": _centroid_clustering.ORACLE_SQL,
}
