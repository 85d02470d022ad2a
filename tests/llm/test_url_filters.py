import itertools
import random
import re

from pyspark.sql import functions as F

from mnemolake.llm import url_filters as U
from mnemolake.llm.queries import op13_url_filters

PAGES, LABELS = "page_id long, url string", "doc_id long, quality int, toxic int"
BAD = "quality = 0 OR toxic = 1"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(url):
    if url is None or "://" not in url:
        return frozenset()
    own = lower(url)
    scheme, rest = own.split("://", 1)
    host, path = parts(own)
    query = rest[len(host) + len(path) :].split("#", 1)[0]
    words = [("scheme", [scheme]), ("host", re.split("[.-]", host)), ("path", path.split("/")), ("query", [x.split("=", 1)[0] for x in query[1:].split("&")] if query.startswith("?") else [])]
    return frozenset(f"{kind}:{'0' if re.fullmatch('[0-9]+', w) else w}" for kind, all_words in words for w in all_words if w)


def fixed(url):
    host, path = parts(url)
    fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[1]), default=(None, None))


def bound(hits, n, z=U.DEVIATE):
    p = hits / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def brute_rules(pages, labels, support, confidence, mined=U.MINED):
    marks = {}
    for i, q, t in labels:
        bad = True if q == 0 or t == 1 else None if q is None or t is None else False
        if i is not None and bad is not None:
            marks.setdefault(i, []).append(bad)
    rows = [(tokens(url), bad) for i, url in pages for bad in marks.get(i, []) if tokens(url)]
    n_of = {}
    for own, _ in rows:
        for t in own:
            n_of[t] = n_of.get(t, 0) + 1
    counts = {}
    for own, bad in rows:
        own = sorted(own, key=lambda t: (n_of[t], t))[:mined]
        for r in range(1, len(own) + 1):
            for c in itertools.combinations(sorted(own), r):
                seen = counts.setdefault(c, [0, 0])
                seen[0] += 1
                seen[1] += bad
    good = {c: x for c, x in counts.items() if x[1] >= support * len(rows) and x[1] and bound(x[1], x[0]) >= confidence}
    return {(c, *x) for c, x in good.items() if not any(set(d) < set(c) for d in good)}


def brute(pages, rules):
    out = []
    for i, url in pages:
        verdict, rule = fixed(url)
        mined = any(set(r[0]) <= tokens(url) for r in rules)
        out.append((i, *parts(url), rule, verdict or ("block" if mined else "allow")))
    return sorted(out, key=str)


def check(spark, pages, labels, support=0.01, confidence=0.5):
    p, q = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    rules = U.mine_rules(p, q, F.expr(BAD), support=support, confidence=confidence)
    got = {(tuple(r["tokens"]), r["n"], r["hits"]) for r in rules.collect()}
    assert got == (want := brute_rules(pages, labels, support, confidence))
    judged = U.judge_urls(p, rules)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, judged.collect()), key=str) == brute(pages, want)
    return want


def made(rng, n):
    hosts = ["a.example.com", "spam-farm.example.info", "b.example.info", "cheap-pills.example.com", "Www.Example.NET", "x.org"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?page=2&ref=x', '#top', '.html'])}"
    return [(k, url()) for k in range(n)]


def test_mined_rules_and_verdicts(spark):
    rng = random.Random(1)
    pages = made(rng, 400)
    labels = [(i, 0 if "spam" in u and "/de/" in u or "page" in u and "pills" in u else int(rng.random() > 0.1), 0) for i, u in pages if i % 2]
    rules = check(spark, pages, labels)
    assert any("host:spam" in r[0] or "host:farm" in r[0] for r in rules)


def test_edges(spark):
    pages = [
        (1, None), (2, ""), (3, "no scheme/net/"), (4, "http://"), (5, "http://NET/"), (6, "http://net"), (7, "ftp://u@x.net:80/a"), (8, "http://a.example.net/en/x"), (9, "http://EXAMPLE.com/de/"),
        (10, "http://example.com/DE/"), (11, "http://org/fr/?a"), (12, "x://y://net/"), (13, "http://badexample.net/en/"), (14, "http://a.net?q=/"), (15, "http://É.Net/\nü"), (None, "http://a.net/"),
        (5, "http://NET/"), (16, "http://h.example.com/" + "seg/" * 50000 + "?" + "&".join(f"k{j}=v" for j in range(3000))), (17, "http://" + "a" * 300000 + ".net/"),
    ]
    labels = [(i, i % 2, 0) for i in range(1, 18)] + [(None, 0, 1), (5, None, None), (6, None, 1), (1, 0, 0)]
    p = spark.createDataFrame(pages, PAGES)
    rules = U.mine_rules(p, spark.createDataFrame(labels, LABELS), F.expr(BAD), support=0.2)
    want = brute(pages, [(tuple(r["tokens"]),) for r in rules.collect()])
    assert sorted(map(tuple, U.judge_urls(p, rules).collect()), key=str) == want
    clashing = U.judge_urls(p.selectExpr("*", "1 AS host", "2 AS _ID", "3 AS tokens"), rules)
    assert sorted(map(tuple, clashing.collect()), key=str) == want


def test_nothing_to_learn_from(spark):
    pages = [(1, "http://a.example.com/de/"), (2, "http://a.b/")]
    assert check(spark, pages, []) == set()
    assert check(spark, [], [(1, 0, 0)]) == set()
    assert check(spark, pages, [(None, 0, 0), (1, None, None)]) == set()


def test_many_common_tokens(spark):
    """Only the rarest tokens of a long labelled URL are mined, so its combinations stay bounded; all are matched."""
    long = "http://bad.example.com/" + "/".join(f"s{k}" for k in range(60))
    pages = [(k, long) for k in range(40)] + [(100 + k, f"http://good.example.com/{k}") for k in range(40)]
    rules = check(spark, pages, [(i, int(i >= 100), 0) for i, _ in pages])
    assert rules and all(r[1] == 40 for r in rules)


def test_long_urls_are_mined_whole(spark, tmp_path):
    """What tells unwanted pages lies beyond the rarest tokens of long URLs."""
    rare = lambda k: "/".join(f"r{k % 20}x{j}" for j in range(U.MINED))
    bad = [(k, f"http://a.example.info/{rare(k)}/cheap/pills") for k in range(200)]
    good = [(1000 + k, f"http://a.example.info/{rare(k)}/{('cheap', 'pills')[k % 2]}/{'/'.join('s%d' % j for j in range(40))}") for k in range(400)]
    new = [(5000, "https://new.example.org/pills/of/cheap"), (5001, "https://new.example.org/cheap"), (5002, "https://new.example.org/pills")]
    spark.createDataFrame(bad + good + new, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i >= 1000), 0) for i, _ in bad + good], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {r.page_id: r.verdict for r in op13_url_filters(spark, str(tmp_path)).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {i for i, _ in bad} | {5000}


def test_rules_by_size_are_those_of_all_combinations(spark):
    rng = random.Random(4)
    for seed in range(3):
        pages = made(rng, 300) + [(1000 + k, "http://x.org/" + "/".join(rng.sample("abcdefgh", rng.randrange(1, 7)) + ["z"])) for k in range(300)]
        labels = [(i, 0 if "a" in u[12:] and "b" in u[12:] and rng.random() < 0.95 else int(rng.random() > 0.2), 0) for i, u in pages if i % 3]
        p, q = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
        got = U.mine_rules(p, q, F.expr(BAD), support=0.01, mined=3, whole=True)
        want = brute_rules(pages, labels, 0.01, 0.5, mined=99)
        assert {(tuple(r["tokens"]), r["n"], r["hits"]) for r in got.collect()} == want
        assert any(len(r[0]) > 1 for r in want)
