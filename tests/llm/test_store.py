"""Tables kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.llm.store import CLEANUP, shared_folder, written


def test_written_returns_the_rows_and_leaves_the_setting(spark):
    before = spark.conf.get(CLEANUP, "false")
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("none"))
    out = written(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert spark.conf.get(CLEANUP, "false") == before
    folder = shared_folder(spark).rstrip("/").rpartition("/")[2]
    assert out.inputFiles() and all(f"/{folder}/" in x for x in out.inputFiles())


def test_written_keeps_an_empty_table(spark):
    out = written(spark.createDataFrame([], "a long, b string"))
    assert out.count() == 0 and out.columns == ["a", "b"]
