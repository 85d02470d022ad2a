import duckdb
import pytest

from mnemolake.llm.mixing import ORACLE_SQL, mix_report, mix_sources, targets
from tests.llm.common import documents, sample, words


def fill(sizes, weights, repeats=3):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes), {}
    while True:
        left = total - sum(capped.values())
        share = sum(w for k, w in enumerate(weights) if k not in capped)
        now = {k: left * w / share for k, w in enumerate(weights) if k not in capped}
        above = {k: repeats * sizes[k] for k, t in now.items() if t > repeats * sizes[k] * (1 + 1e-12)}
        if not above:
            return [float(capped.get(k, now.get(k))) for k in range(len(sizes))]
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 5, 900, 1, 0, 30], [10], [7, 7, 7], [0, 0, 5], [1000, 1, 1, 1]])
def test_targets_by_water_filling(spark, sizes):
    weights = [k % 3 + 1 for k in range(len(sizes))]
    df = spark.createDataFrame([(f"s{k}", n, weights[k]) for k, n in enumerate(sizes)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(fill(sizes, weights))


def test_report_is_the_sql(spark):
    got = sorted(map(tuple, mix_report(sample(spark)).collect()))
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL).fetchall())


def test_taken_words_come_near_the_targets(spark):
    rows = mix_report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    taken, target = {}, {}
    for r in rows:
        assert r.taken <= 3 * r.size
        key = (r.source_size, r.target)
        taken[key], target[key] = taken.get(key, 0) + r.taken, r.target
    assert all(abs(taken[k] - target[k]) <= 0.03 * target[k] for k in taken)
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.01)


def test_edges(spark):
    docs = documents(spark, [None, "", "a b", "a b", "c " * 50, "d"], ids=[None, 1, 2, 2, 3, 4], sources=[None, "b", "b", "b", None, "a"])
    rows = mix_report(docs.selectExpr("*", "1 AS size", "2 AS target", "3 AS weight")).collect()
    assert len(rows) == 6 and sum(r.size for r in rows) == 55
    assert len({(r.copies) for r in rows if r.doc_id == 2}) == 1
    assert mix_report(documents(spark, [])).count() == 0
    assert mix_sources(documents(spark, [])).count() == 0


def test_copies_are_the_plan(spark):
    docs = sample(spark)
    plan = {r.doc_id: r.copies for r in mix_report(docs).collect()}
    out = mix_sources(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in plan.items() if n}
    assert got == {r.doc_id: r["count"] for r in mix_sources(docs.repartition(3)).groupBy("doc_id").count().collect()}


def test_given_weights(spark):
    docs = documents(spark, ["a b c d"] * 40, sources=["x", None] * 20)
    weights = spark.createDataFrame([("x", 3), (None, 1)], "source string, weight long")
    rows = mix_report(docs, weights=weights).collect()
    assert {r.target for r in rows} == {40.0, 120.0} and len(words("a b")) == 2
