"""Compression of prompts: token pruning, sentence pruning, both, or by stop words.

Each strategy is a projection of the text that gives a struct: compressed, n_tokens, n_kept,
retention, removed (distinct tokens, where the strategy knows them) and achieved.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from .chunking import hashed_embedding

# Words that compression drops first, and words that it keeps.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "than", "too", "very", "just",
    "also", "now", "and", "but", "or",
)
KEPT_WORDS = (
    "error", "exception", "fail", "failed", "success", "critical", "important", "warning", "note", "remember", "always", "never", "must", "required",
    "essential", "key", "main", "primary", "password", "secret", "credential", "token", "api", "endpoint", "database", "server", "client", "user",
    "admin", "root",
)
# Patterns of numbers and of code, and the retention that the heuristic reports.
NUMERIC = "^\\p{Nd}+\\.?\\p{Nd}*$"
CODE = "[{}\\[\\]();=>]|->|::|//"
HEURISTIC_RETENTION = 0.8
VECTOR_SIZE = 32


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def _stop(t: Column) -> Column:
    return F.lower(t).isin(*STOP_WORDS)


def _kept(t: Column) -> Column:
    return F.lower(t).isin(*KEPT_WORDS)


def _capital(t: Column) -> Column:
    return t.rlike("^\\p{Lu}") & ~_stop(t)


def _share(n: Column, ratio: Column | float) -> Column:
    """The whole part of a number times a ratio, in single precision."""
    ratio = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    return F.floor((n.cast("float") * ratio.cast("float")).cast("float")).cast("int")


def _cut(x: Column) -> Column:
    """A score to nine digits, cut where short decimals don't lie, so that the last bit of a sum never decides an order."""
    return F.floor(x * 1e9 + 0.3719) / 1e9


def token_scores(words: Column) -> Column:
    """Importance of each token of an array, by place, kind, form and length."""
    n = F.size(words)

    def one(t: Column, i: Column) -> Column:
        place = 1 - F.abs(i.cast("double") / n - 0.5) * 0.3 + F.when((i < 3) | (i > n - 3), F.lit(0.2)).otherwise(F.lit(0.0))
        kind = F.when(_kept(t), F.lit(1.0)).when(_stop(t), F.lit(0.1)).when(_capital(t), F.lit(0.8)).when(t.rlike(NUMERIC), F.lit(0.7)).otherwise(F.lit(0.5))
        kind = F.when(_capital(t), F.greatest(kind, F.lit(0.9))).when(t.rlike(NUMERIC), F.greatest(kind, F.lit(0.85))).otherwise(kind)
        form = F.when(t.rlike("^\\p{P}$"), F.lit(0.6)).otherwise(F.lit(0.4))
        length = F.when(F.char_length(t) > 4, F.lit(0.6)).otherwise(F.lit(0.4))
        return _cut(F.least(F.lit(1.0), 0.2 * place + 0.1 * kind + 0.3 * form + 0.4 * length))

    return F.transform(words, one)


def _total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)


def _result(compressed, n_tokens, n_kept, retention, removed, achieved) -> Column:
    return F.struct(
        compressed.alias("compressed"), n_tokens.cast("long").alias("n_tokens"), n_kept.cast("long").alias("n_kept"), F.round(retention.cast("double"), 6).alias("retention"),
        removed.cast("array<string>").alias("removed"), achieved.alias("achieved"),
    )



def prune_tokens(text: Column, ratio: Column | float = 0.5) -> Column:
    """The best of the tokens, as many as the ratio of them, ties first, in order; retention is their share of the score."""

    def pruned(words: Column) -> Column:
        def scored(scores: Column) -> Column:
            order = F.sort_array(F.transform(scores, lambda s, i: F.struct((-s).alias("less"), i.alias("i"))))
            best = F.sort_array(F.transform(F.slice(order, F.lit(1), F.greatest(_share(F.size(words), ratio), F.lit(0))), lambda x: x["i"]))

            def chosen(places: Column) -> Column:
                kept = F.transform(places, lambda i: F.get(words, i))
                total = _total(scores)
                share = F.when(total > 0, _total(F.transform(places, lambda i: F.get(scores, i))) / total).otherwise(F.lit(1.0))
                return _result(F.array_join(kept, " "), F.size(words), F.size(places), share, F.array_except(words, kept), F.lit(True))

            return vx.let(best, chosen)

        return vx.let(token_scores(words), scored)

    return vx.let(tokens(text), pruned)


def sentence_scores(sentences: Column) -> Column:
    """Importance of each sentence of an array, by likeness to all, place and content."""
    n = F.size(sentences)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def content(s: Column) -> Column:
        def counted(words: Column) -> Column:
            count = lambda test: F.size(F.filter(words, test))
            code = F.when(s.rlike(CODE), F.lit(0.3)).otherwise(F.lit(0.0))
            return F.least(F.lit(1.0), 0.5 + 0.1 * count(_kept) + 0.05 * count(_capital) + 0.05 * count(lambda t: t.rlike(NUMERIC)) + code)

        return vx.let(tokens(s), counted)

    def with_vectors(vectors: Column) -> Column:
        centre = F.aggregate(vectors, F.array_repeat(F.lit(0.0), VECTOR_SIZE), add)

        def with_centre(c: Column) -> Column:
            place = lambda i: F.when(i < F.floor(n / 4), F.lit(0.8)).when(i > F.floor(3 * n / 4), F.lit(0.7)).otherwise(F.lit(0.5))
            each = lambda s, i: _cut(0.4 * vx.cosine(F.get(vectors, i), c) + 0.2 * place(i) + 0.4 * content(s))
            return F.transform(sentences, each)

        return vx.let(centre, with_centre)

    return vx.let(F.transform(sentences, lambda s: hashed_embedding(s, VECTOR_SIZE)), with_vectors)


def prune_sentences(text: Column, ratio: Column | float = 0.5) -> Column:
    """The best sentences whose estimated tokens fit the ratio, in order; the first is always kept, later ones that don't fit are passed over.

    A text of one sentence stays as it is.
    """
    estimate = tx.tokens_by_length(text)
    target = _share(estimate, ratio)

    def pruned(sentences: Column) -> Column:
        def scored(scores: Column) -> Column:
            order = F.sort_array(F.transform(scores, lambda s, i: F.struct((-s).alias("less"), i.alias("i"))))
            fill = F.aggregate(
                order,
                F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept")),
                lambda acc, x: vx.let(
                    tx.tokens_by_length(F.get(sentences, x["i"])),
                    lambda cost: F.when(
                        (acc["used"] + cost <= target) | (F.size(acc["kept"]) == 0), F.struct((acc["used"] + cost).alias("used"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))
                    ).otherwise(acc),
                ),
                lambda acc: F.sort_array(acc["kept"]),
            )

            def chosen(places: Column) -> Column:
                joined = F.array_join(F.transform(places, lambda i: F.get(sentences, i)), " ")
                total = _total(scores)
                share = F.when(total > 0, _total(F.transform(places, lambda i: F.get(scores, i))) / total).otherwise(F.lit(1.0))
                return _result(joined, estimate, tx.tokens_by_length(joined), share, F.array(), tx.tokens_by_length(joined) <= target)

            return vx.let(fill, chosen)

        return vx.let(sentence_scores(sentences), scored)

    whole = _result(text, estimate, estimate, F.lit(1.0), F.array(), F.lit(True))
    return vx.let(tx.sentences(text, newlines=False), lambda s: F.when(F.size(s) > 1, pruned(s)).otherwise(whole))


def prune_both(text: Column, ratio: float = 0.5) -> Column:
    """Sentences first, at half as much again as the ratio and at most 0.7; then tokens of what is left, if it is still above the ratio."""

    def second(first: Column) -> Column:
        current = F.when(first["n_tokens"] > 0, first["n_kept"].cast("float") / first["n_tokens"].cast("float")).otherwise(F.lit(0.0)).cast("float")
        pruned = lambda t: _result(t["compressed"], first["n_tokens"], t["n_kept"], first["retention"] * t["retention"], t["removed"], t["achieved"])
        return F.when(current <= F.lit(ratio).cast("float"), first).otherwise(vx.let(prune_tokens(first["compressed"], F.lit(ratio).cast("float") / current), pruned))

    return vx.let(prune_sentences(text, min(0.7, ratio * 1.5)), second)


def drop_words(words: list[str], ratio: float) -> tuple[list[str], list[str]]:
    """(kept, removed): stop words go, except kept words and as long as too few are kept; then the words nearest the middle, stop words first.

    A removal moves the middle by half a place, so stop words are held on both sides of it and
    only the two next to it are compared.
    """
    stop, held = set(STOP_WORDS), set(KEPT_WORDS)
    target = int(np.float32(len(words)) * np.float32(ratio))
    kept, removed = [], []
    for w in words:
        low = w.lower()
        fits = low not in stop or low in held or len(kept) < target
        (kept if fits else removed).append(w)
    n, gone, size = len(kept), 0, max(target, 1)
    left, right, out = [k for k, w in enumerate(kept) if w.lower() in stop], deque(), set()
    while n > size and (left or right):
        while left and 2 * left[-1] > n:
            right.appendleft((left[-1] + gone, left.pop()))  # its place is the first less the removals by then
        far = lambda place: abs(np.float32(place) / np.float32(n) - np.float32(0.5))  # noqa: B023, E731
        nearer = left and (not right or far(left[-1]) <= far(right[0][0] - gone))
        place = left.pop() if nearer else right.popleft()[1]
        out.add(place)
        removed.append(kept[place])
        n, gone = n - 1, gone + 1
    rest = [w for k, w in enumerate(kept) if k not in out]
    if len(rest) > size:  # half of what stays is before the middle
        low = (size + 1) // 2
        high = len(rest) - (size - low)
        removed, rest = removed + rest[low:high], rest[:low] + rest[high:]
    return rest, removed


def drop_stop_words(text: Column, ratio: float = 0.5) -> Column:
    """The text without stop words, and then without the words in the middle, at the ratio of its tokens; see ``drop_words``.

    The order of removals depends on all before, so this one strategy runs in Arrow batches.
    """

    @F.pandas_udf("kept array<string>, removed array<string>")
    def each(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drop_words(list(x), ratio) for x in rows], columns=["kept", "removed"])

    def done(words: Column, parts: Column) -> Column:
        return _result(F.array_join(parts["kept"], " "), F.size(words), F.size(parts["kept"]), F.lit(HEURISTIC_RETENTION), parts["removed"], F.size(parts["kept"]) <= _share(F.size(words), ratio))

    return done(tokens(text), each(tokens(text)))


STRATEGIES = {"tokens": prune_tokens, "sentences": prune_sentences, "hybrid": prune_both, "heuristic": drop_stop_words}


def compress(text: Column, strategy: str = "hybrid", ratio: float = 0.5) -> Column:
    """The struct of a strategy; a blank or null text gives an empty one with retention 1."""
    none = _result(F.lit(""), F.lit(0), F.lit(0), F.lit(1.0), F.array(), F.lit(True))
    return F.when(F.coalesce(text, F.lit("")).rlike("\\S"), STRATEGIES[strategy](text, ratio)).otherwise(none)


def compression_estimate(text: Column) -> Column:
    """1 less 0.4 of the share of stop words that are no kept words; 1 for blank texts."""
    words = tokens(text)
    stop = F.size(F.filter(words, lambda t: _stop(t) & ~_kept(t)))
    return F.when(F.size(words) > 0, 1 - 0.4 * stop / F.size(words)).otherwise(F.lit(1.0))
