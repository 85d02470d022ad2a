from collections import Counter

from mnemolake.llm.quality_rules import BIT, POLICIES, ablations, apply_policy, rule_ledger
from tests.llm.common import documents, sample, words


def brute(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    n = len(covered)
    failed = len(w) < 20 or 100 * n > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(docs):
    got = apply_policy(rule_ledger(docs)).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute(r.text)) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in COLUMNS)) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_sample(spark):
    check(sample(spark))


def test_edges(spark):
    many = " ".join(f"w{k % 30}" for k in range(500))
    texts = [None, "", " \t\n\x0b\f\r", "a b c\n\na b c\r\n| # é", many, "x " * 40, "\n".join(["one line"] * 9), " ".join(f"é{k}" for k in range(200000)), "same one", "same one"]
    got = check(documents(spark, texts, ids=[None, 1, 2, 3, 4, 5, 6, 7, 8, 8]))
    assert {type(r.n_words) for r in got} == {int}


def test_empty_and_clashing_columns(spark):
    assert apply_policy(rule_ledger(documents(spark, []))).count() == 0
    check(documents(spark, ["a b c " * 9]).selectExpr("*", "7 AS n_words", "8 AS _w", "9 AS fail_bits", "1 AS `a.b`"))


def test_good_documents_stay_and_junk_goes(spark):
    docs = sample(spark, "sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = apply_policy(rule_ledger(docs)).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


def test_policies_and_ablations(spark):
    ledger = rule_ledger(sample(spark))
    kept = {p: apply_policy(ledger, p).filter("kept").count() for p in POLICIES}
    assert kept["base-1"] >= kept["standard-1"] >= kept["strict-1"]
    rows = {r.rule: r for r in ablations(ledger).collect()}
    bits = [r.fail_bits & POLICIES["standard-1"] for r in ledger.collect()]
    for name, bit in BIT.items():
        bit &= POLICIES["standard-1"]
        assert rows[name].n_failed == sum(b & bit != 0 for b in bits)
        assert rows[name].n_failed_alone == sum(b == bit != 0 for b in bits)
        assert rows[name].n_kept_without == sum(b & ~bit == 0 for b in bits)
