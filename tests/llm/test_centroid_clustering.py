import hashlib
import math
import random

import pytest

from mnemolake.llm.centroid_clustering import cluster_vectors

SCHEMA = "vec_id long, embedding array<double>"
LONG = (1 << 63) - 1


def brute(rows, clusters, rounds, dim):
    kept = [(i, tuple(math.floor(min(max(256 * x, -9.2e18), 9.2e18)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [list(v) for _, v in start]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, own in groups.items():
            centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + min(d, LONG)
    return sorted(((i, k, min(d, LONG), min(inertia[k], LONG), min(sum(inertia.values()), LONG), ",".join(map(str, centroids[k]))) for i, k, d in found), key=str)


def check(spark, rows, clusters=5, rounds=5, dim=3):
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA), clusters=clusters, rounds=rounds, dimensions=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    want = brute(rows, clusters, rounds, dim)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def points(rng, n, dim=3, spread=1.0):
    return [(k, [rng.gauss(0, 1) * spread for _ in range(dim)]) for k in range(n)]


def test_random(spark):
    assert len({r[1] for r in check(spark, points(random.Random(1), 400), 8)}) == 8


def test_copies_count_by_their_number(spark):
    """A third of all rows is one vector; its weight draws its centroid."""
    rng = random.Random(2)
    rows = points(rng, 200) + [(1000 + k, [3.0, 3.0, 3.0]) for k in range(100)]
    assert len(check(spark, rows, 4)) == 300


def test_edges(spark):
    rng = random.Random(3)
    rows = points(rng, 30) + [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 1.0]), (5, [1.0, float("nan"), 1.0]), (6, [float("-inf"), 1.0, 1.0]), (None, [0.1, 0.2, 0.3])]
    rows += [(7, [9.0, 9.0, 9.0])] * 3 + [(8, [-0.5, -0.001, -9.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, [1.0, 1.0, 1.0])])
    check(spark, points(rng, 3), 5)


@pytest.mark.parametrize("spread", [1e3, 1e9, 1e17])
def test_large_components(spark, spread):
    check(spark, points(random.Random(4), 30, 3, spread), 4)


def test_empty_clusters_stay(spark):
    rows = [(k, [float(k % 2)] * 3) for k in range(12)]
    check(spark, rows, 6)


def test_other_columns(spark):
    rows = points(random.Random(5), 20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS cluster", "3 AS _ID")
    assert sorted(map(tuple, cluster_vectors(df, clusters=3, dimensions=3).collect()), key=str) == brute(rows, 3, 5, 3)
