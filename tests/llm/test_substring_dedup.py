import random

import pytest

from mnemolake.llm.substring_dedup import COVERS, choose_cover, substring_dedup
from tests.llm.common import documents, sample, words


def brute(rows, window):
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("v,cover", COVERS)
def test_covers_hold_every_difference(v, cover):
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_default_cover():
    assert choose_cover(13) == (7, (0, 1, 3), 7)


def test_matches_brute_force_on_sample(spark):
    docs = sample(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(substring_dedup(docs)) == brute(rows, 13)


@pytest.mark.parametrize("window", [3, 5, 13])
def test_random_texts(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    assert result(substring_dedup(documents(spark, texts), window=window)) == brute(list(enumerate(texts)), window)


def test_edges(spark):
    p = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"x{k % 50000}" for k in range(300000))
    docs = documents(spark, [p, None, "", "a b\tc\n\x0bd", p, p + " é", long, long], ids=[5, 1, 2, 3, 5, 9, 20, 21])
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {(5, 40, 0), (1, 0, 0), (2, 0, 0), (3, 4, 0), (9, 41, 40), (20, 300000, 0), (21, 300000, 300000)}


def test_null_id_counts_as_smallest(spark):
    p = " ".join(f"w{k}" for k in range(20))
    docs = documents(spark, [p, p], ids=[None, -7])
    assert {(r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()} == {(None, 0), (-7, 20)}


def test_empty_table_and_clashing_columns(spark):
    docs = documents(spark, [])
    assert substring_dedup(docs).count() == 0
    docs = documents(spark, ["a b"]).selectExpr("*", "1 AS `group`", "2 AS _text", "3 AS bucket")
    assert result(substring_dedup(docs)) == [(0, 2, 0, "a b")]
