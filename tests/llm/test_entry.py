"""The queries, the pipeline and their SQL as the driver sees them."""

import __spark_entry__
import corpus_pipeline
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_dedup", "decontamination", "mixing"]


def test_sql_of_the_operators(spark):
    con = connect(SF)
    sql = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("op")}
    assert sorted(sql) == ["op11_hard_negatives", "op12_centroid_clustering", "op1_quality_rules", "op2_line_dedup", "op3_mixing", "op8_secret_scan"]
    for name, text in sql.items():
        got, want = compare(spark, con, __spark_entry__.queries()[name], text, SF)
        assert got == want, name


def test_contract_columns(spark):
    """The stated columns come first, in order and of their types."""
    want = {
        "op1_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
        "op3_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
        "op4_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
        "op5_lm_scoring": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        "op7_minhash_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
        "op8_secret_scan": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
        "op9_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int",
        "op11_hard_negatives": "anchor_id:bigint positive_id:bigint rank:int negative_id:bigint positive_score:bigint negative_score:bigint",
        "op12_centroid_clustering": "vec_id:bigint cluster:int distance:bigint cluster_inertia:bigint inertia:bigint centroid_sha256:string",
        "op13_url_filters": "page_id:bigint host:string path:string rule:string verdict:string",
    }
    for name, columns in want.items():
        kinds = [f"{c}:{t}" for c, t in __spark_entry__.queries()[name](spark, SF).dtypes]
        assert kinds[: len(columns.split())] == columns.split(), name
