"""URL filters: fixed host and path rules, and association rules mined from labelled pages.

A URL's tokens are its scheme, the words of its host, the segments of its path and the keys
of its query; segments of digits are alike. FP-growth mines combinations of tokens that go
with unwanted pages. A combination becomes a rule if enough labelled pages hold it and if
the lower bound of its confidence, as of a sample of that size, is high enough; combinations
that hold a smaller rule are left out, as they match nothing more. Where a labelled URL has
too many tokens for FP-growth, which makes every common combination, the same rules are found
size by size, each size from combinations that neither are rules nor equal a smaller one in
the pages that hold them.

Rules are matched by an inverted index: each is posted under its rarest token, so a URL meets
only rules whose rarest token it holds, and those are compared as sets. Only distinct sets of
tokens are matched, since many pages share one, and the outcome is joined back to the pages,
the commonest sets by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native
from .store import written

#: The least share of the labelled pages that hold a rule's tokens and are unwanted.
SUPPORT = 0.0005
#: The least confidence, and the normal deviate of its lower bound (one in 200 on one side).
CONFIDENCE, DEVIATE = 0.5, 2.58
#: Most tokens of a labelled URL for FP-growth: sets of n common tokens have 2 ** n combinations. What becomes of longer ones is said at ``mine_rules``; matching knows no such bound.
MINED = 12
#: What marks an unwanted page among tokens; no token of a URL begins like it.
UNWANTED = "!"


@dataclass(frozen=True)
class Rule:
    """A fixed rule: a host with its subdomains, and how the path begins."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


# The rules of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null, and for urls without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*+", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*+([^?#]*+)", 1)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; none for null and for urls without ``://``."""
    own = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    rest = _after_scheme(own)
    marked = lambda kind, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind + ":"), F.when(w.rlike("^[0-9]++$"), "0").otherwise(w)))
    query = F.regexp_extract(rest, "^[^?#]*+\\?([^#]*+)", 1)
    parts = [
        marked("scheme", F.array(F.substring_index(own, "://", 1))),
        marked("host", F.split(F.regexp_extract(rest, "^[^/?#]*+", 0), "[.-]")),
        marked("path", F.split(F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), "/")),
        marked("query", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    ]
    none = F.array().cast("array<string>")
    return F.when(F.locate("://", own) > 0, F.array_sort(F.array_distinct(F.concat(*parts)))).otherwise(none)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = rule.fits(host, path)
        text, verdict = text.when(fits, F.lit(rule.text)), verdict.when(fits, F.lit(rule.verdict))
    return text, verdict


def lower_bound(hits: Column, n: Column, deviate: float = DEVIATE) -> Column:
    """Wilson's lower bound of a share of which ``hits`` of ``n`` were seen."""
    p, z = hits / n, deviate * deviate
    return (p + z / (2 * n) - deviate * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def mine_rules(
    pages: DataFrame, labels: DataFrame, unwanted: Column, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE, mined: int = MINED, whole: bool = False,
) -> DataFrame:
    """tokens (array), n, hits of the rules that ``labels`` give: combinations of tokens, how many labelled pages hold them, and how many of those are unwanted.

    ``unwanted`` is a condition on ``labels``; rows for which it is null are passed over. Every
    row of ``pages`` counts with every label of its id. With ``whole``, all tokens of every
    labelled URL are mined, size by size if one has over ``mined``; else such a URL gives its
    ``mined`` rarest tokens.
    """
    marks = labels.select(native.quoted(label_id_col).alias("_id"), unwanted.alias("_bad")).filter("_id IS NOT NULL AND _bad IS NOT NULL")
    rows = pages.select(native.quoted(id_col).alias("_id"), url_tokens(native.quoted(url_col)).alias("tokens"))
    # one row for each set of tokens and label, with its number
    sets = rows.join(marks, "_id").groupBy("tokens", "_bad").agg(F.count(F.lit(1)).alias("k"))
    sets = written(sets.filter(F.size("tokens") > 0))
    long = sets.filter(F.size("tokens") > mined)
    by_size = not long.isEmpty()
    if by_size and not whole:
        counts = sets.select(F.explode("tokens").alias("token"), "k").groupBy("token").agg(F.sum("k").alias("n"))
        ranked = long.select("tokens", "_bad", "k", F.explode("tokens").alias("token")).join(counts, "token")
        rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, mined)
        cut = ranked.groupBy("tokens", "_bad", "k").agg(F.transform(rarest, lambda x: x["token"]).alias("_own")).select(F.col("_own").alias("tokens"), "_bad", "k")
        sets = sets.filter(F.size("tokens") <= mined).unionByName(cut)
    total = sets.agg(F.sum("k")).first()[0]
    schema = "tokens array<string>, n long, hits long"
    if not total:
        return pages.sparkSession.createDataFrame([], schema)
    if by_size and whole:
        return _rules_by_size(sets, total, support, confidence)
    item = F.when(F.col("_bad"), F.array(F.lit(UNWANTED))).otherwise(F.array().cast("array<string>"))
    baskets = sets.select(F.concat("tokens", item).alias("items"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("_copy")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(UNWANTED)))
    hits = F.round(F.col("support") * total).cast("long")
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.round(hits / F.col("confidence")).cast("long").alias("n"), hits.alias("hits"))
    found = written(found.filter(lower_bound(F.col("hits"), F.col("n")) >= confidence))
    larger = matched(found.select("tokens"), found, proper=True)
    return found.join(larger, "tokens", "left_anti")


def _rules_by_size(sets: DataFrame, total: int, support: float, confidence: float) -> DataFrame:
    """tokens, n, hits of the rules of ``sets`` (tokens, _bad, k; k sums up to ``total``) that hold no smaller one.

    A combination is grown only while it has the support, is no rule, and each token less would
    add pages: where one less has the same pages, it has the same confidence and is grown instead.
    All these hold for every part of a combination that they hold for, so no rule is passed over.
    """
    n, hits = F.col("n"), F.col("hits")
    rows = written(sets.withColumn("row", F.monotonically_increasing_id()))
    held = rows.select("row", "_bad", "k", F.explode("tokens").alias("token")).select("row", "_bad", "k", F.array("token").alias("tokens"))
    rules, grown = [], None
    while True:
        counts = held.groupBy("tokens").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("_bad"), F.col("k")).otherwise(0)).alias("hits"))
        # a bound that all hits could not pass is out of reach of any part of them
        counts = counts.filter((hits >= support * total) & (lower_bound(hits, hits) >= confidence))
        if grown is not None:
            parts = counts.select("tokens", n, F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
            free = parts.join(grown.select(F.col("tokens").alias("part"), F.col("n").alias("more")), "part").filter("n < more").groupBy("tokens").agg(F.count(F.lit(1)).alias("parts"))
            counts = counts.join(free.filter(F.col("parts") == F.size("tokens")).select("tokens"), "tokens", "left_semi")
        counts = written(counts)
        good = lower_bound(hits, n) >= confidence
        rules.append(counts.filter(good))
        grown = counts.filter(~good & (n < total))
        if grown.isEmpty():
            return reduce(DataFrame.unionByName, rules)
        held = written(held.join(grown.select("tokens"), "tokens", "left_semi"))
        start, last = F.slice("tokens", F.lit(1), F.size("tokens") - 1), F.element_at("tokens", -1)
        one, other = held.select("row", "_bad", "k", "tokens", start.alias("start"), last.alias("last")), held.select("row", start.alias("start"), last.alias("next"))
        held = one.join(other, ["row", "start"]).filter("last < next").select("row", "_bad", "k", F.concat("tokens", F.array("next")).alias("tokens"))


def matched(sets: DataFrame, rules: DataFrame, proper: bool = False) -> DataFrame:
    """tokens of the ``sets`` (distinct, tokens) that hold all tokens of a rule; with ``proper``, and others besides."""
    each = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token"))
    common = sets.select(F.explode("tokens").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # a rule with a token that no set holds matches nothing
    index = each.join(common, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count(F.lit(1)).alias("held")).filter(F.col("held") == F.size("rule"))
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index.select("rule", "token"), "token")
    holds = F.size(F.array_except("rule", "tokens")) == 0
    return met.filter(holds & (F.size("tokens") > F.size("rule")) if proper else holds).select("tokens").distinct()


def judge_urls(pages: DataFrame, mined_rules: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``pages``: the id, host, path, rule and verdict (allow or block).

    The longest fixed rule that fits decides; without one, a URL that holds all tokens of a mined
    rule is blocked and others are allowed. A null URL, and one without ``://``, has an empty host
    and path, no tokens and is allowed. Ids are passed on, null or repeated; URLs are read whole,
    however long. An empty table gives no rows, and without mined rules nothing more is blocked.
    Other columns are not read.
    """
    url = native.quoted(url_col)
    rows = pages.select(native.quoted(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_fixed"), F.when(rule.isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"))
    sets = rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    sets = written(sets)
    bad = matched(sets.select("tokens"), mined_rules).withColumn("bad", F.lit(True))
    judged = written(sets.join(bad, "tokens", "left").fillna(False, ["bad"]))
    out = native.join_split(rows, judged, "tokens", "n")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_fixed", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
