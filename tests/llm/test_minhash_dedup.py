import random
import string

import numpy as np
import pyarrow as pa
import pytest

from mnemolake.llm import minhash_dedup as M
from mnemolake.llm.components import connected_components
from mnemolake.llm.store import Scratch
from tests.llm.common import documents, sample, words

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(t, n):
    w = words((t or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n=4, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and x and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_sample(spark):
    docs = sample(spark, "sf0.01")
    got = sorted(map(tuple, M.near_duplicates(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(not r[3] for r in got) > 20


@pytest.mark.parametrize("percent,n", [(80, 4), (60, 2)])
def test_chains_and_large_groups(spark, percent, n):
    """Copies that drift: links hold between neighbours, not with the first of all."""
    rng = random.Random(percent)
    texts = []
    for _ in range(3):
        w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(40):
            texts.append(" ".join(w))
            w = list(w)
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    got = sorted(map(tuple, M.near_duplicates(documents(spark, texts), shingle=n, percent=percent).collect()))
    assert got == brute(list(enumerate(texts)), n, percent)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(M, "SPLIT", 3)
    test_chains_and_large_groups(spark, 80, 4)


@pytest.mark.parametrize("split", [2, 7, 1000])
def test_every_member_outside_the_largest_component_meets_all(spark, monkeypatch, split):
    """Each pair of a bucket that two components share is compared, even if it shares no other bucket."""
    monkeypatch.setattr(M, "SPLIT", split)
    rng = random.Random(split)
    rows = [(key, 100 * key + k, 100 * key + min(rng.randrange(9), k)) for key in range(4) for k in range(1 + 13 * key)]
    dealt = M._dealt(M._open(spark.createDataFrame(rows, "key long, id long, comp long"), "key"), "key", []).collect()
    met, groups = set(), {}
    for r in dealt:
        groups.setdefault((r.key, r.i, r.j), []).append(r)
    for g in groups.values():
        others = g if g[0].alone else [r for r in g if not r.moves]
        met |= {frozenset((x.id, y.id)) for x in g if x.moves for y in others if x.comp != y.comp}
    assert met == {frozenset((x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2]}
    if split > 100:
        assert len(groups) == 3


def test_pairs_of_a_frequent_end(spark, monkeypatch):
    monkeypatch.setattr(M, "SPLIT", 4)
    table = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "id long, x string")
    pairs = {(0, k) for k in range(1, 30)} | {(5, 6), (5, 7)}
    got = M._spread(spark.createDataFrame(sorted(pairs), "a long, b long"), table, ["x"]).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, f"t{a}", f"t{b}") for a, b in pairs)


def test_rows_without_an_id(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z w v", "p q r s t u", None]
    got = sorted(map(tuple, M.near_duplicates(documents(spark, texts, ids=[None, 3, None, 4, None])).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (3, 3, None, False), (None, 2, None, True), (4, 3, 4, True), (None, 0, None, True)], key=str)
    with pytest.raises(TypeError):
        M.near_duplicates(documents(spark, ["a"]).selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_one_of_each_keeps_columns_and_repeats_once(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = documents(spark, [long, long + " x", "a b", "a b", "c", None, None], ids=[1, 2, 3, 3, None, 6, None]).selectExpr("*", "1 AS _times", "2 AS _keeps", "3 AS _text_hash", "4 AS _gone_id")
    out = M.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, long), (3, "a b"), (None, "c"), (6, None), (None, None)], key=str)


def test_tables_go_at_the_end(spark):
    scratch = Scratch(spark)
    a, b = scratch.written(spark.range(3)), scratch.written(spark.range(4))
    scratch.drop(a)
    assert b.count() == 4
    scratch.drop()
    with pytest.raises(Exception):
        b.count()


def test_edges(spark):
    long = " ".join(f"x{k}" for k in range(200000))
    docs = documents(spark, [None, "", " \n", "A b", "a B", "a b c", "a b c", long, long + " y", "a b c d e"], ids=[1, 2, 3, 4, 5, 6, 6, 8, 7, None])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs.selectExpr("*", "1 AS key", "2 AS component_id")).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (8, 199997, 7, False), (7, 199998, 7, True), (None, 2, None, True)}
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_estimate_is_close(spark):
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        common = rng.integers(0, 1 << 60, 1000, dtype=np.uint64)
        rest = int(1000 * (1 / share - 1) / 2)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, rest, dtype=np.uint64)])) for _ in range(2)]
        h, offsets = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        sig = M.pack(M.minima(h, offsets))
        assert abs(float(M.estimate(sig[0], sig[1])) - share) < 0.15


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_edges_of_one_task_settle_without_rounds(spark):
    chain = [(k, k + 1) for k in range(200)]
    random.Random(5).shuffle(chain)
    for parts, most in ((1, 1), (7, 9)):
        scratch = Scratch(spark)
        found = connected_components(spark.createDataFrame(chain, "a long, b long").repartition(parts), scratch)
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(201)}
        assert len(scratch.tables) <= most


def test_shingle_sets_over_slices():
    texts = pa.chunked_array([["a b c d e"], ["A B c d", None]])
    got = [(low, high, np.diff(o).tolist()) for low, high, _, o in M.shingle_sets(texts)]
    assert got == [(0, 1, [2]), (1, 3, [1, 0])]
