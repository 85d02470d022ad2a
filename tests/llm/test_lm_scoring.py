import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemolake.llm import lm_scoring as L
from mnemolake.llm import words as W
from tests.llm.common import documents, sample, words


def parts(i, t):
    held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    return held, [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)] + [None]


def check_base(rows, got):
    all_parts = [parts(i, t) for i, t in rows]
    c = Counter(x for held, tokens in all_parts if not held for x in tokens)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held, len(x), sum(c[y] > 0 for y in x), n, sum(math.log10((c[y] + 1) / (n + v + 1)) for y in x)) for (i, _), (held, x) in zip(rows, all_parts)), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want])


def test_base_and_held_out_gain(spark):
    docs = sample(spark, "sf0.1")
    got = L.score_documents(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("held-out gain", gain)
    assert gain > 0.15
    assert all(r.score < 0 for r in got)


def model(rng, levels=1):
    h = [int(x) for x in rng.integers(1, 1 << 62, 40)]
    m = L.start_model([(x, 50 - k) for k, x in enumerate(h)], {k: (5, 3) for k in range(L.TAIL * L.DIGITS**levels)}, levels, 6)
    for w in m.weights:
        w[:] = rng.normal(0, 0.3, w.shape)
    return m, h


def test_probabilities_sum_to_one():
    """Over the frequent tokens, and in each leaf three known tokens of counts 5 in all and one unknown."""
    m, h = model(np.random.default_rng(3))
    known = [np.uint64(x) for x in h]
    tail = [(form, digit, n) for form in range(L.TAIL) for digit in range(L.DIGITS) for n in (3, 1, 1, 0)]
    hashes = known + [np.uint64((digit << 20) + 1 + k % 4) for k, (_, digit, _) in enumerate(tail)]
    t = L.Tokens(np.array(hashes), np.array([0] * len(known) + [f for f, *_ in tail]), np.zeros(len(hashes), int), np.tile(np.array([[5], [6], [7]], np.uint64), len(hashes)))
    logs = L.log_probabilities(m, t, np.array([0] * len(known) + [n for *_, n in tail]))
    assert (10.0**logs).sum() == pytest.approx(1, abs=1e-4)


MASK = (1 << 64) - 1


def mixed(x):
    x &= MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def choices(m, h, form, before):
    """(weights, bias of the node, outcome, rows) of a token's choices, one after another."""
    s, rows = [int(x) for x in L._SALTS], m.weights[0].shape[1]
    one, two, three = before
    row = lambda x: mixed(x) % rows
    ranks = {int(x): int(r) for x, r in zip(m.frequent, m.rank)}
    rank = ranks.get(h)
    c = rank // L.SLOTS if rank is not None else L.FREQUENT + form
    out = [(m.weights[0], m.biases[0][:, 0], c, [row(one * s[0]), row(one * s[1] + two * s[2]), row(two * s[3]), row(three * s[4])])]
    if rank is not None:
        return [*out, (m.weights[1], m.biases[1][:, c], rank % L.SLOTS, [row(one * s[6] + (c + 1) * s[5]), row(two * s[7] + (c + 1) * s[5])])], None
    node = form
    for level in range(m.levels):
        p, digit = (node + 1) * s[8 + level], h >> 20 + 5 * level & L.DIGITS - 1
        out.append((m.weights[2], m.biases[2 + level][:, node], digit, [row(one * s[6] + p), row(two * s[7] + p)]))
        node = node * L.DIGITS + digit
    return out, node


def share(weights, bias, rows):
    y = [math.exp(b + sum(float(w[r]) for r in rows)) for w, b in zip(weights, bias)]
    return [x / sum(y) for x in y]


def slice_of(text):
    return L.tokens(W.of_bytes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), True))


@pytest.mark.parametrize("levels", [1, 2])
def test_score_is_the_product_of_the_choices(levels):
    m, h = model(np.random.default_rng(levels), levels)
    t = slice_of("the quick brown fox, jumps over the lazy dog. é and the end".encode())
    m.frequent, m.rank = np.sort(np.unique(t.hashes)[:5]), np.arange(5)
    counts = np.arange(t.n) % 4
    got = L.log_probabilities(m, t, counts)
    for k in range(t.n):
        steps, leaf = choices(m, int(t.hashes[k]), int(t.form[k]), [int(x) for x in t.before[:, k]])
        want = sum(math.log10(share(w, b, rows)[outcome]) for w, b, outcome, rows in steps)
        want += 0 if leaf is None else math.log10((counts[k] + 1) / m.leaf[leaf])
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_training_round_against_loops(spark):
    """Weights after a round: the log ratio of observed and expected counts, summed token by token."""
    texts = ["a b c d. a b c", "b c a, é d a b", "zz a b", "c d. zz é", ""] * 3
    docs = documents(spark, texts).selectExpr("doc_id AS _id", "text AS _text")
    counts = L.token_counts(docs).collect()
    n, v = sum(r.n for r in counts), len(counts)
    fitted = L.fit_model(docs, spark.createDataFrame(counts), n, v, 3, rounds=1)
    levels, bits = L.sizes_for(n, v)
    start = L.start_model(sorted(((r.h, r.n) for r in counts), key=lambda x: (-x[1], x[0]))[: L.FREQUENT * L.SLOTS], {}, levels, bits)
    seen, expected = [np.zeros(w.shape) for w in start.weights], [np.zeros(w.shape) for w in start.weights]
    for text in texts:
        t = slice_of(text.encode())
        for k in range(t.n):
            for w, b, outcome, rows in choices(start, int(t.hashes[k]), int(t.form[k]), [int(x) for x in t.before[:, k]])[0]:
                at = next(i for i, x in enumerate(start.weights) if x is w)
                p = share(w, b, rows)
                for r in rows:
                    seen[at][outcome, r] += 1
                    expected[at][:, r] += p
    for w, o, e, f in zip(fitted.weights, seen, expected, (4, 2, 2)):
        total = e.sum(axis=0)
        want = np.zeros(w.shape)
        for k, r in np.argwhere(e > 0):
            given = L.PRIOR * e[k, r] / total[r]
            want[k, r] = math.log(max(o[k, r] + given, 1e-6) / max(e[k, r] + given, 1e-6)) / f
        assert w == pytest.approx(want, abs=1e-3)
    again = L.fit_model(docs.repartition(5), spark.createDataFrame(counts), n, v, 5, rounds=1)
    assert all(a == pytest.approx(b, abs=1e-4) for a, b in zip(again.weights, fitted.weights))


def test_rounds_raise_the_likelihood():
    t = slice_of(("a b c d. " * 400).encode())
    h, n = np.unique(t.hashes, return_counts=True)
    m = L.start_model([(int(x), int(k)) for x, k in zip(h.view(np.int64), n)], {}, 1, 10)
    likelihood = [L.log_probabilities(m, t, np.zeros(t.n)).sum()]
    for _ in range(6):
        sums = L.new_sums(m)
        L.add_counts(m, sums, t)
        L.update(m, sums)
        likelihood.append(L.log_probabilities(m, t, np.zeros(t.n)).sum())
    assert likelihood == sorted(likelihood) and likelihood[-1] > 0.3 * likelihood[0]


def test_model_grows_with_the_corpus():
    assert L.sizes_for(0, 0) == (1, L.LEAST_BITS) and L.sizes_for(10**10, 10**9) == (3, 17) and L.sizes_for(10**15, 10**11) == (3, L.MOST_BITS)
    assert L.sizes_for(72 * 10**6, 10**6) == (1, 14)


def test_contexts_stay_within_a_text():
    data = b"a bc"
    t = L.tokens(W.of_bytes(np.frombuffer(data, np.uint8), np.array([0, 1, 1, 4]), True))
    assert t.owner.tolist() == [0, 0, 1, 2, 2]
    s, a, bc = L.START, t.hashes[0], t.hashes[3]
    assert t.before.T.tolist() == [[s, s, s], [a, s, s], [s, s, s], [s, s, s], [bc, s, s]] and t.hashes[1] == t.hashes[2] == L.END


def test_edges(spark):
    rows = [(None, "A b"), (1, None), (2, ""), (3, "x é " * 100000), (4, "a b"), (4, "a b"), (16, "zz new")]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "1 AS `group`", "2 AS h", "3 AS score", "4 AS n")
    got = L.score_documents(docs).collect()
    check_base(rows, got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert L.score_documents(docs.limit(0)).count() == 0
    only = documents(spark, ["a b"], ids=[next(i for i in range(99) if parts(i, "")[0])])
    check_base([(only.first().doc_id, "a b")], L.score_documents(only).collect())


def test_lookup():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(1 << 20))
    asked = np.concatenate([keys, keys + np.uint64(1), np.zeros(2, np.uint64)])
    got = W.Lookup(keys, np.arange(len(keys)) + 1).get(asked)
    known = {int(k): i + 1 for i, k in enumerate(keys)}
    assert got.tolist() == [known.get(int(a), 0) for a in asked]
    assert W.Lookup(keys[:0], np.zeros(0, np.int64)).get(asked[:3], -1).tolist() == [-1] * 3
