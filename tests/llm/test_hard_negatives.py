import math
import random

import pytest
from pyspark.sql import functions as F

from mnemolake.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"
LONG = (1 << 63) - 1


def brute(rows, positives=5, negatives=10):
    kept = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, label, tuple(math.floor(min(max(256 * x, -9.2e18), 9.2e18)) for x in v)))
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, w)))), j, k) for j, k, w in kept if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(i, j, n + 1, x[1], p, x[0]) for n, x in enumerate(hard)]
    return sorted(out)


def check(spark, rows, block_rows=16384):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mine_hard_negatives(df, F.col("vec_id") % 100 == 0, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == (want := brute(rows))
    return want


def vectors(rng, n, dim, spread=1.0, labels=4):
    return [(k * 10, rng.randrange(labels), [rng.gauss(0.3, 1) * spread for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("block_rows", [16384, 37])
def test_random(spark, block_rows):
    assert len(check(spark, vectors(random.Random(3), 300, 6), block_rows)) > 500


def test_ties_in_many_blocks(spark):
    """A third of all rows is one vector, so the k-th score is shared by far more rows than are asked for."""
    rng = random.Random(4)
    rows = vectors(rng, 60, 3) + [(5000 + k, k % 3, [0.5, 0.5, 0.5]) for k in range(200)]
    assert check(spark, rows, 25)


def test_edges(spark):
    rng = random.Random(5)
    rows = vectors(rng, 40, 3) + vectors(rng, 40, 2) + [(0, 1, []), (100, 1, []), (200, 2, [])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (300, None, [1.0, 1.0, 1.0]), (7, 1, None), (8, 1, [1.0, None, 1.0]), (9, 1, [1.0, float("nan"), 2.0]), (11, 1, [float("inf"), 1.0, 1.0])]
    rows += [rows[3]] * 4
    check(spark, rows)
    check(spark, [])
    check(spark, [(0, 1, [1.0]), (1, 1, [1.0])])


def test_large_components(spark):
    rng = random.Random(6)
    check(spark, vectors(rng, 40, 3, 1e7))
    check(spark, vectors(rng, 40, 3, 1e17))


def test_other_columns_and_types(spark):
    rows = vectors(random.Random(7), 50, 4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "label", "cast(embedding AS array<float>) AS embedding", "1 AS key", "2 AS V", "3 AS anchor")
    got = mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
    floats = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, got.collect())) == brute(floats)
