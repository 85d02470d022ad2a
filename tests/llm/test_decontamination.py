import math
import random
import re
from collections import Counter

import pytest

from mnemolake.llm import decontamination as D
from tests.llm.common import documents, sample

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(t or "")]


def brute(rows, items, threshold=D.THRESHOLD):
    """Every passage against every item."""
    parts = [(i, t, terms(t)) for i, t in items if terms(t)]
    n, mean = len(parts), sum(len(x) for *_, x in parts) / max(1, len(parts))
    df = Counter(t for *_, x in parts for t in set(x))
    stride = max((len(x) for *_, x in parts), default=1)
    out = {}
    for i, text, x in parts:
        w = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, k in Counter(x).items()}
        total = sum(w.values())
        cut = D._answer_start(text, len(x))
        runs = lambda y: {tuple(y[k : k + min(3, len(y))]) for k in range(len(y) - min(3, len(y)) + 1)}
        halves = runs(x[:cut]) or runs(x), runs(x[cut:])
        for d, t in rows:
            y = terms(t)
            for low in range(0, len(y), stride):
                p = y[low : low + 2 * stride]
                score = sum(w[t] for t in set(p) if t in w) / total
                if score < threshold:
                    continue
                found = {tuple(p[k : k + m]) for m in (1, 2, 3) for k in range(len(p) - m + 1)}
                held = [len(h & found) / len(h) for h in halves]
                if min(held) >= D.OVERLAP:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, *held))
    return out


def result(df):
    return {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_sample(spark):
    docs = sample(spark, "sf0.01")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = result(D.find_leaks(docs, bench))
    rows, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]
    same(got, brute(rows, items))
    assert {(d, i) for d, t in rows for i, x in items if x in t} == set(got)
    assert D.remove_leaks(docs, bench).count() == len(rows) - len({d for d, _ in got})


def test_random_passages_near_the_threshold(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"t{int(rng.paretovariate(0.7)) % 3000}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(4, 40))) + ". " + " ".join(word() for _ in range(rng.randrange(1, 8)))) for k in range(150)]
    texts = []
    for _ in range(150):
        x = [word() for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            y = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else word() for w in rng.choice(items)[1].split()]
            at = rng.randrange(len(x) + 1)
            x[at:at] = y
        texts.append(" ".join(x))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = result(D.find_leaks(documents(spark, texts), bench))
    same(got, brute(list(enumerate(texts)), items))
    assert len(got) > 50
    monkeypatch.setattr(D, "INDEX_BYTES", 5000)  # in several indexes, with the same scores
    assert len(list(D.indexes(bench))) >= 3
    same(result(D.find_leaks(documents(spark, texts), bench)), got)


def test_edges(spark, monkeypatch):
    item = "what is the colour of the sky in the evening? it is mostly red"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x y"), (4, item)], "item_id long, text string")
    docs = documents(spark, [None, "", "a " * 60000 + item.upper(), item, item, "what is the colour of the sky in the evening?"], ids=[1, 2, None, 4, 4, 5]).selectExpr("*", "1 AS item_id", "2 AS score")
    for size in (D.INDEX_BYTES, 70):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        rows = sorted(((r.doc_id or -1, r.item_id) for r in D.find_leaks(docs, bench).collect()))
        assert rows == [(-1, 1), (-1, 4), (4, 1), (4, 1), (4, 4), (4, 4)]
        left = D.remove_leaks(docs, bench)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert D.find_leaks(documents(spark, []), bench).count() == 0
    assert D.find_leaks(docs, bench.filter("item_id > 9")).count() == 0


def test_long_items_are_held_whole(spark):
    rng = random.Random(5)
    word = lambda k: f"q{k}x{rng.randrange(10**6)}"
    items = []
    for k, n in enumerate((20, 256, 257, 513, 515, 1300)):
        x = [word(k) for _ in range(n - 5)] + ["tail", *(word(k) for _ in range(3)), "end"]
        items.append((k, " ".join(x[:-20]) + ". " + " ".join(x[-20:])))
    parts = {k: t.split() for k, t in items}
    texts = ["the end", "tail end", "end"] + [" ".join(x[-1:]) for x in parts.values()] + [" ".join(x[-8:]) for k, x in parts.items() if k]
    texts += [" ".join(x[:-20]) for k, x in parts.items() if k]  # questions without answers
    clean = len(texts)
    texts += [" ".join([word(9) for _ in range(rng.randrange(700))] + x + [word(9) for _ in range(rng.randrange(700))]) for x in parts.values()]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = result(D.find_leaks(docs, bench))
    assert set(got) == {(clean + k, k) for k in parts} and all(v == pytest.approx((1, 1, 1)) for v in got.values())
    assert sorted(r.doc_id for r in D.remove_leaks(docs, bench).collect()) == list(range(clean))


def test_classes_of_lengths_are_found_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "LONGEST", 400)
    rng = random.Random(8)
    word = lambda: f"t{int(rng.paretovariate(0.6)) % 4000}"
    items = [(k, " ".join(word() for _ in range(700 + 5 * k)) + ". " + " ".join(word() for _ in range(30))) for k in range(12)]
    texts = []
    for _ in range(60):
        x = [word() for _ in range(rng.randrange(900))]
        y = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else word() for w in rng.choice(items)[1].split()]
        at = rng.randrange(len(x) + 1)
        x[at:at] = y[: rng.randrange(300, 800)]
        texts.append(" ".join(x))
    got = result(D.find_leaks(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")))
    same(got, brute(list(enumerate(texts)), items))
    assert got
