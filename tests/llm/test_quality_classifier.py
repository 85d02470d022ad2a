import zlib

import numpy as np
import pytest

from mnemolake.llm import quality_classifier as Q
from mnemolake.llm import words as W
from tests.llm.common import documents, sample


def sparse(*texts):
    data = "".join(texts).encode()
    return Q.features(W.of_bytes(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]), True))


def test_linear_time_identity():
    x = sparse("a b c", "", "d é d f")
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=Q.FEATURES).astype(np.float32), rng.normal(size=(Q.FEATURES, Q.K)).astype(np.float32))
    for j, got in enumerate(m.scores(x)):
        i, v = x.index[x.first[j] : x.first[j + 1]], x.value[x.first[j] : x.first[j + 1]]
        y = m.bias + m.linear[i] @ v + sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(1 / (1 + np.exp(-y)), rel=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    machine = Q.fit(docs, labels)
    rows = Q.score_quality(docs, machine).join(labels, "doc_id").collect()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    tested = [r for r in rows if r.held_out]
    good, bad = [r for r in tested if r.quality == 1], [r for r in tested if r.quality == 0]
    print(len(good), len(bad), sum(r.predicted for r in good) / len(good), sum(r.predicted for r in bad) / len(bad))
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(r.predicted for r in bad) <= 0.1 * len(bad)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    kept = Q.keep_quality(docs, machine)
    assert kept.columns == docs.columns and kept.count() == Q.score_quality(docs, machine).filter("predicted = 1").count()


def test_edges(spark):
    docs = documents(spark, [None, "", "word " * 200000, "a", "a"], ids=[1, None, 2, 3, 3]).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS quality")
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score_quality(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in rows)
    none = Q.fit(docs.limit(0), labels.limit(0))
    assert Q.score_quality(docs, none).count() == 5 and Q.score_quality(docs.limit(0), none).count() == 0
