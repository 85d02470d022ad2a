import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from mnemolake.llm import quality_classifier as Q
from mnemolake.llm.mixing import DRAWS
from tests.llm.common import sample, words
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_minhash_dedup import brute as near
from tests.llm.test_mixing import fill

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """docs before and after each stage, by name."""
    docs, out = sample(spark), {}
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        after = f(spark, docs, SF)
        after.write.parquet(path)
        out[name] = (docs, after := spark.read.parquet(path))
        assert after.columns == docs.columns
        docs = after
    return out


def test_quality(spark, stages):
    before, after = stages["quality_classifier"]
    machine = Q.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = {r.doc_id for r in Q.score_quality(before, machine).collect() if r.score >= 0.7}
    assert texts(after) == [x for x in texts(before) if x[0] in accepted] and 0 < after.count() < before.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = [(i, t) for i, _, n, t in lines(texts(before)) if not n or t.split()]
    assert texts(after) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages["minhash_dedup"]
    kept = {i for i, _, _, kept in near(texts(before), 5) if kept}
    assert texts(after) == [x for x in texts(before) if x[0] in kept]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaks(texts(before), items)}
    assert gone and texts(after) == [x for x in texts(before) if x[0] not in gone]


def copies(rows, repeats=3):
    """{(id, text): copies} by sharing the excess again and again and trying every seed."""
    by = {}
    for i, text, source in rows:
        by.setdefault(source, []).append((i, text, len(words(text))))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for *_, n in by[s]) for s in order]
    targets = fill(sizes, [k % 3 + 1 for k in range(len(order))], repeats)
    out = {}
    for s, size, target in zip(order, sizes, targets):
        rate = target / size if size else 0.0
        whole = math.floor(rate)

        def draw(i, seed, rate=rate, whole=whole):
            digest = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13]
            return whole + (int(digest, 16) / (1 << 52) < rate - whole)

        misses = [(abs(sum(n * draw(i, f"mix{k}") for i, _, n in by[s]) - target), k) for k in range(DRAWS)]
        seed = f"mix{min(misses)[1]}"
        out |= {(i, t): draw(i, seed) for i, t, _ in by[s]}
    return out


def test_mixing_and_run(spark, stages):
    before, after = stages["mixing"]
    want = copies([(r.doc_id, r.text, r.source) for r in before.collect()])
    got = Counter((r.doc_id, r.text) for r in after.collect())
    assert got == {k: n for k, n in want.items() if n} and max(want.values()) <= 3
    assert texts(corpus_pipeline.run(spark, SF)) == texts(after)


def test_nulls_ties_and_long_texts(spark):
    """Null texts, ids and sources, repeated rows and a long text pass every stage with the table's columns."""
    long = " ".join(f"w{k % 5000}" for k in range(60000))
    kept = sample(spark).filter("lang = 'en'").limit(20).collect()
    rows = [tuple(r) for r in kept] + [tuple(kept[0]), (None, "a b", "en", None, 3), (900, None, None, "x", None), (901, "", "en", "x", 0), (902, long, "en", None, len(long))]
    docs = spark.createDataFrame(rows, sample(spark).schema).selectExpr("*", "1 AS _pos", "2 AS _times", "3 AS _mix_rate")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = {r.doc_id for r in out.collect()}
        assert found <= {r[0] for r in rows}, name
        assert name in ("quality_classifier", "mixing") or {900, 901, 902} <= found, name


def test_empty(spark):
    docs = sample(spark).limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
