"""Every registered query of the library against its SQL, at the smallest scale."""

import pytest

from mnemolake import plans
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    got, want = compare(spark, con, plans.QUERIES[name], plans.ORACLE_SQL[name], SF)
    assert got == want


#: Queries without SQL that other tests compare, as queries, with loops or by recall.
ELSEWHERE = {
    "budget_trim", "dup_leader_clusters", "pii_spans", "rate_limit", "working_memory", "working_memory_managed", "mmr_rerank", "hybrid_reordered", "summaries", "topic_segments", "needle_ranks",
    "compress_sentences", "compress_stop_words", "pii_redacted", "content_validation", "archival_search", "term_stems", "stemmed_topk", "ann_topk", "near_dup_hashed",
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - ELSEWHERE))
def test_other_queries_have_rows(spark, name):
    """The operators of these have loops or cases of their own."""
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
