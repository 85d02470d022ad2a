"""Indexes against the exact ways: what they find, and what they need not read."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from mnemolake import plans
from mnemolake.operators import dedup, search, term_index
from mnemolake.operators.vector_index import VectorIndex
from mnemolake.plans import memory_queries

SF = "/root/testdata/sf0.1"


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id long, embedding array<float>")


def clustered(rng, n, centres=40, dim=16):
    c = rng.normal(size=(centres, dim)) * 4
    return [(k, c[k % centres] + rng.normal(size=dim)) for k in range(n)]


def test_recall_of_the_query(spark):
    """At least 0.9 of what brute force finds for every row whose id is divisible by 100."""
    pairs = lambda name: {(r["query_id"], r["id"]) for r in plans.QUERIES[name](spark, SF).collect()}
    true, found = pairs("batch_topk"), pairs("ann_topk")
    assert len(true & found) >= 0.9 * len(true) and len(found) == len(true)


def test_only_probed_cells_are_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = vectors(spark, clustered(rng, 2000))
    index = VectorIndex(spark, str(tmp_path / "v"))
    probes = index.build(df, k=10)
    cells = {p.name for p in Path(index.path, "cells").glob("cell=*")}
    assert probes <= len(cells) / 4
    asked = df.filter("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    true = {(r["query_id"], r["id"], r["rank"]) for r in search.batch_topk(asked, df, 10).collect()}
    probed = {f"cell={c}" for r in index._ranked_cells(asked, ["query_id"], probes).collect() for c in r["cells"]}
    away = tmp_path / "away"
    away.mkdir()
    for name in cells - probed:
        Path(index.path, "cells", name).rename(away / name)
    assert len({(r["query_id"], r["id"], r["rank"]) for r in index.search(asked, 10).collect()} & true) >= 27 and len(probed) <= 3 * probes
    for name in cells - probed:
        (away / name).rename(Path(index.path, "cells", name))
    # with all cells it is exact
    assert {(r["query_id"], r["id"], r["rank"]) for r in index.search(asked, 10, probes=len(cells)).collect()} == true
    index.add(vectors(spark, [(9000, clustered(rng, 1)[0][1])] + [(9001 + k, [1.0] * 16) for k in range(30)]))
    own = vectors(spark, [(0, [1.0] * 16)]).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert {r["id"] for r in index.search(own, 30).collect()} == set(range(9001, 9031))


def test_vector_index_edges(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0])] + [(10 + k, [0.0, 1.0]) for k in range(60)]
    df = vectors(spark, rows).unionByName(spark.createDataFrame([(99, None), (None, [1.0, 1.0])], "id long, embedding array<float>"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(df, k=3)
    asked = df.filter("id IN (1, 2, 10)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = sorted((r["query_id"], r["rank"], r["id"]) for r in index.search(asked, 3, probes=8).collect())
    assert found[3:6] == [(2, 1, 2), (2, 2, 1), (2, 3, 10)] and found[6:] == [(10, 1, 10), (10, 2, 11), (10, 3, 12)]
    assert index.search(asked.limit(0), 3).count() == 0
    one = VectorIndex(spark, str(tmp_path / "one"))
    one.build(df.filter("id = 2"))
    assert [r["id"] for r in one.search(asked.filter("query_id = 10"), 3).collect()] == [2]


def test_hashed_pairs(spark):
    """The same pairs as of all rows, within the stated recall, with the exact scores."""
    rows = memory_queries._with_copies(spark, "/root/testdata/sf0.01")
    for threshold in (0.8, 0.95):
        all_pairs = {(r["tenant"], r["a"], r["b"], round(r["score"], 9)) for r in dedup.near_pairs(rows, threshold).collect()}
        hashed = {(r["tenant"], r["a"], r["b"], round(r["score"], 9)) for r in dedup.near_pairs_hashed(rows, threshold).collect()}
        assert hashed <= all_pairs and len(hashed) >= 0.97 * len(all_pairs) > 100


def test_hashed_pairs_edges(spark):
    schema = "id long, user_id string, embedding array<double>"
    rng = random.Random(2)
    near = [1.0, 2.0, 3.0]
    rows = [(k, "a:b\nc", [x + rng.uniform(-0.01, 0.01) for x in near]) for k in range(40)] + [(100, "d", near), (101, "e", near), (102, None, near), (103, "d", None), (104, "d", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    got = dedup.near_pairs_hashed(df, 0.99)
    assert {(r["tenant"], r["a"], r["b"]) for r in got.collect()} == {("a:b\nc", a, b) for a in range(40) for b in range(a + 1, 40)}
    assert dedup.near_pairs_hashed(df.limit(0), 0.9).count() == 0
    bits, tables = dedup.hash_tables(1 << 20, 0.9, 0.99)
    assert bits == 15 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 0.01


def test_counted_words(spark):
    rows = [(["b", "a", "b", "c", "b"],), ([],), (["x"],)]
    got = [[tuple(t) for t in r["t"]] for r in spark.createDataFrame(rows, "w array<string>").select(term_index.counted(F.col("w")).alias("t")).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_best_rows_read_few_blocks(spark, tmp_path):
    """The best rows are those of all scores, in every state of the index, and most blocks are not needed for them."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 20, 60])]) for _ in range(rng.choice([5, 40, 300])))
    df = spark.createDataFrame([(k, text()) for k in range(3000)], "id long, content string")
    index = term_index.TermIndex(spark, str(tmp_path / "t"))
    index.rebuild(df)

    def check():
        for query in ("w0 w1", "w50", "w7 w59 zzz", "w2 w3 w30 w31"):
            scores = sorted(((-round(r["score"], 9), r["id"]) for r in index.scores(query).collect()))[:10]
            assert [(-round(r["score"], 9), r["id"]) for r in index.best(query, 10).orderBy(F.desc("score"), "id").collect()] == scores
            strict = sorted(((-round(r["score"], 9), r["id"]) for r in index.scores(query, require_all=True).collect()))[:10]
            assert [(-round(r["score"], 9), r["id"]) for r in index.best(query, 10, require_all=True).orderBy(F.desc("score"), "id").collect()] == strict

    check()
    wanted = ["w50", "w41"]
    mean, idf = index._rarity(wanted)
    bounds = index.bounds(wanted, mean, idf)
    tenth = index.best("w50 w41", 10).agg(F.min("score")).first()[0]
    assert bounds.filter(F.col("bound") >= tenth).agg(F.sum("n")).first()[0] < 0.5 * bounds.agg(F.sum("n")).first()[0]
    # texts ten times as long raise the mean, and with it all impacts of the first version
    index.add(spark.createDataFrame([(k, text() * 10) for k in range(2900, 3300)], "id long, content string"), 1)
    index.remove(spark.createDataFrame([(k,) for k in range(0, 3000, 3)], "id long"), 2)
    check()
    assert index.best("zzz", 5).count() == 0
