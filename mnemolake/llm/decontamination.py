"""Benchmark decontamination by BM25 over an inverted index of test items.

Test items are indexed; every passage of a training text is a query, and all items that
reach the threshold are retrieved. Scores are divided by the item's score for itself, so
one threshold serves all. The search is block-max WAND over arrays: items lie in blocks,
the commonest terms of a block are passed over as long as no item gets more than SLACK
from them all, and postings of the other terms carry the largest impact in the block.
Only (passage, block) pairs whose sum of these can still reach the threshold are scored
in full. The bounds of all pairs are summed by arrays, in place of moving from pivot to
pivot one passage after another; the result is that of the full scores. A retrieved item counts as a leak if runs of its question and of its answer both
stand in the passage.

Items are dealt to classes by length, up to LONGEST terms, twice that, and so on. A class's
passages are twice as long as its longest item, and start at every multiple of its length:
an item stands whole in one of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, words
from .store import written

THRESHOLD = 0.6
SLACK = 0.37
K1, B = 1.2, 0.75
BLOCK = 4
RUN = 3
#: Least share of the runs of RUN terms of the question, and of the answer, that the passage holds.
OVERLAP = 0.5
#: Terms of the first class of items; each further class reaches twice as far.
LONGEST = 256
#: Bytes of item texts in one broadcast index; a larger benchmark is searched by several, one after another.
INDEX_BYTES = 16 << 20


@dataclass
class Index:
    """Items of one class in order of id; postings of essential terms by term; all impacts by item."""

    ids: list[int]
    terms: np.ndarray  # sorted hashes of all terms
    essential: np.ndarray  # postings of term k: essential[k]:essential[k + 1]
    block: np.ndarray  # block of each posting
    most: np.ndarray  # largest impact of the posting's term in its block
    impacts: list[dict[int, float]]
    questions: list[set]
    answers: list[set]
    stride: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


def _runs(h: np.ndarray) -> set:
    """Hashes of the runs of RUN terms, or of the whole where it is shorter."""
    n = min(RUN, len(h))
    return set(words.window_hashes(h, n).tolist()) if n else set()


def _answer_start(text: str, n: int) -> int:
    """Number of terms before the answer: the last sentence, or the last third of a single one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p]
    if len(parts) > 1:
        before = " ".join(parts[:-1]).encode()
        k = len(words.of_bytes(np.frombuffer(before, np.uint8), np.array([0, len(before)]), True, True).hashes)
        if 0 < k < n:
            return k
    return n - max(1, n // 3)


@dataclass
class Statistics:
    """Of all items with a term: their lengths, and the number of items that hold each of some terms (sorted hashes)."""

    n: int
    mean: float
    longest: dict[int, int]  # of each class
    terms: np.ndarray
    df: np.ndarray


def _terms(text: str) -> np.ndarray:
    data = (text or "").encode()
    return words.of_bytes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), True, True).hashes


def local_statistics(items: list[tuple[int, str]]) -> Statistics:
    """Those of a list of (id, text) items."""
    parts = [h for h in (_terms(text) for _, text in items) if len(h)]
    terms, df = np.unique(np.concatenate([np.unique(h) for h in parts]) if parts else np.zeros(0, np.uint64), return_counts=True)
    longest: dict[int, int] = {}
    for h in parts:
        longest[class_of(len(h))] = max(len(h), longest.get(class_of(len(h)), 0))
    return Statistics(len(parts), sum(map(len, parts)) / max(len(parts), 1), longest, terms, df)


def class_of(length: int) -> int:
    """The class of an item of so many terms: 0 up to LONGEST, 1 up to twice that, and so on."""
    return (-(-length // LONGEST) - 1).bit_length()


def build_indexes(items: list[tuple[int, str]], all_items: Statistics | None = None) -> list[Index]:
    """The indexes of (id, text) items, one for each class of lengths; those without a term are left out.

    Weights follow ``all_items``, which covers at least the terms of ``items``; default: these are all.
    """
    parts, ids, halves = [], [], []
    for item, text in sorted(items):
        h = _terms(text)
        if not len(h):
            continue
        cut = _answer_start(text, len(h))
        parts.append(h)
        ids.append(item)
        halves.append((_runs(h[:cut]) or _runs(h), _runs(h[cut:])))
    all_items = all_items or local_statistics(items)
    n, mean, terms, df = all_items.n, all_items.mean, all_items.terms, all_items.df
    counted = [np.unique(p, return_counts=True) for p in parts]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impacts, entries = [], []
    for k, (t, tf) in enumerate(counted):
        at = np.searchsorted(terms, t)
        weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(parts[k]) / mean))
        weight = weight / weight.sum()
        impacts.append(dict(zip(t.tolist(), weight.tolist())))
        entries.append((at, weight))
    classes: dict[int, list[int]] = {}
    for k, p in enumerate(parts):
        classes.setdefault(class_of(len(p)), []).append(k)
    out = []
    for c, own in sorted(classes.items()):
        keys, most = _postings([entries[k] for k in own], df)
        owner = np.array([t for t, _ in keys], np.int64)
        out.append(Index(
            [ids[k] for k in own], terms, np.searchsorted(owner, np.arange(len(terms) + 1)), np.array([b for _, b in keys], np.int64), np.array(most, np.float64),
            [impacts[k] for k in own], [halves[k][0] for k in own], [halves[k][1] for k in own], all_items.longest[c],
        ))
    return out


def _postings(entries: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray) -> tuple[list[tuple[int, int]], list[float]]:
    """(term, block) of the essential terms in order, and the largest impact of each."""
    postings: dict[tuple[int, int], float] = {}
    for low in range(0, len(entries), BLOCK):
        members = entries[low : low + BLOCK]
        # the commonest terms first, while no item of the block gets more than SLACK from them
        order = sorted({int(x) for at, _ in members for x in at}, key=lambda x: (-df[x], x))
        passed, sums = set(), np.zeros(len(members))
        inside = [dict(zip(at.tolist(), weight.tolist())) for at, weight in members]
        for t in order:
            more = sums + [m.get(t, 0.0) for m in inside]
            if more.max() > SLACK:
                break
            passed.add(t)
            sums = more
        for m in inside:
            for t, w in m.items():
                if t not in passed:
                    key = (t, low // BLOCK)
                    postings[key] = max(w, postings.get(key, 0.0))
    keys = sorted(postings)
    return keys, [postings[k] for k in keys]


def search_all(w: words.Words, classes: list[Index], threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """The leaks of all classes, each text and item once."""
    best: dict[tuple[int, int], tuple] = {}
    for index in classes:
        for leak in search(w, index, threshold):
            best[leak[:2]] = max(best.get(leak[:2], leak), leak)
    return sorted(best.values())


def search(w: words.Words, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text, item id, score, question overlap, answer overlap): the best passage of each leak in a slice of terms."""
    if not len(index.ids) or not len(w.hashes):
        return []
    at = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hashes)
    n_postings = np.diff(index.essential)[at[known]]
    owner = w.owner()[known]
    # chunk: a stride of one text; a passage is two that follow each other
    chunks = -(-w.counts // index.stride)
    base = np.concatenate([[0], np.cumsum(chunks + 1)])
    chunk = base[owner] + (known - w.first[owner]) // index.stride
    take = np.repeat(index.essential[at[known]] - np.concatenate([[0], np.cumsum(n_postings)[:-1]]), n_postings) + np.arange(n_postings.sum())
    key = np.repeat(chunk, n_postings) * index.blocks + index.block[take]
    order = np.argsort(key, kind="stable")
    key, most = key[order], index.most[take][order]
    if not len(key):
        return []
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, sums = key[start], np.add.reduceat(most, start)
    # the sum of a passage is that of its two chunks
    following = np.searchsorted(key, key + index.blocks)
    both = sums.copy()
    has = following < len(key)
    has[has] = key[following[has]] == key[has] + index.blocks
    both[has] += sums[following[has]]
    single = key[both >= threshold - SLACK]
    last = key[(sums >= threshold - SLACK)] - index.blocks  # the passage that begins a chunk before
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    text_of = np.repeat(np.arange(len(chunks)), chunks + 1)
    seen: dict[int, tuple[set, set, np.ndarray]] = {}
    for k in np.unique(np.concatenate([single, last[last >= 0]])).tolist():
        c, block = divmod(k, index.blocks)
        j = int(text_of[c])
        low = int(w.first[j] + (c - base[j]) * index.stride)
        high = min(low + 2 * index.stride, int(w.first[j + 1]))
        if high <= low:
            continue
        if c not in seen:
            seen = {c: (set(w.hashes[low:high].tolist()), w.hashes[low:high])}
        bag, h = seen[c]
        for item in range(block * BLOCK, min((block + 1) * BLOCK, len(index.ids))):
            score = sum(x for t, x in index.impacts[item].items() if t in bag)
            if score < threshold:
                continue
            held = [len(runs & found) / len(runs) for runs, found in ((r, _runs_as(h, r)) for r in (index.questions[item], index.answers[item]))]
            if min(held) >= overlap:
                at_item = (j, index.ids[item])
                best[at_item] = max(best.get(at_item, (0.0, 0.0, 0.0)), (score, *held))
    return [(*k, *v) for k, v in sorted(best.items())]


def _runs_as(h: np.ndarray, runs: set) -> set:
    """The runs of a passage of every length up to RUN."""
    return {x for n in range(1, RUN + 1) for x in words.window_hashes(h, n).tolist()}


def _item_terms(items: DataFrame) -> DataFrame:
    """h, n: the distinct terms of every item, and its number of terms with one of them (the others have 0)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in words.slices(batch.column(0), lower=True, terms=True):
                for j, count in enumerate(w.counts):
                    if count:
                        h = np.unique(w.hashes[w.first[j] : w.first[j + 1]])
                        n = np.zeros(len(h), np.int64)
                        n[0] = count
                        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return items.select("t").mapInArrow(rows, "h long, n long")


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Index]]:
    """The classes' indexes of at most about INDEX_BYTES of item texts each time, which together hold every item.

    Weights are by all items, counted before, so a score does not depend on how they are dealt.
    """
    items = benchmark.select(native.whole_number(benchmark, id_col).alias("item"), native.quoted(text_col).alias("t")).filter("item IS NOT NULL AND t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // INDEX_BYTES))
    found = written(_item_terms(items))
    counts = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("df")))
    # a row for each class: the class is that of the length, a logarithm
    by_class = found.filter("n > 0").groupBy(F.length(F.bin(F.ceil(F.col("n") / LONGEST) - 1)).alias("digits"), (F.col("n") > LONGEST).alias("beyond"))
    lengths = by_class.agg(F.max("n").alias("longest"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("items")).collect()
    number, length = sum(r["items"] for r in lengths), sum(r["total"] for r in lengths)
    longest = {class_of(r["longest"]): r["longest"] for r in lengths}
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        known = counts.join(_item_terms(part).select("h").distinct(), "h", "left_semi").select("h", "df").toArrow()
        terms = known.column("h").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        own = Statistics(number, length / max(number, 1), longest, terms[order], known.column("df").to_numpy()[order])
        yield build_indexes([(r.item, r.t) for r in part.collect()], own)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that leaked into it: the id, item_id, score, question_overlap, answer_overlap, contaminated (true).

    Terms are lower-cased (A-Z) runs of letters and digits. Null and empty texts and items
    match nothing; repeated items count once, and texts of one item id give one row, the best.
    Rows with one id give a row each; null ids stay null. A very long text is searched whole,
    passage by passage; a very long item has an index and passages of its length. An empty
    benchmark or table gives no rows. Other columns are not read.
    """
    own = docs.select(native.quoted(id_col).alias("_id"), native.quoted(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    out = None
    for classes in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(classes)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, _, w in words.slices(batch.column(1), lower=True, terms=True):
                    if found := search_all(w, shared.value, threshold):
                        text, item, score, question, answer = zip(*found)
                        ids = batch.column(0).take(pa.array([low + j for j in text]))
                        yield pa.record_batch([ids, pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in (score, question, answer))], ["_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = own.mapInArrow(rows, f"_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("contaminated", F.lit(True)).withColumnRenamed("_id", id_col)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns; see ``find_leaks``."""
    out, place = docs, docs.columns.index(text_col)
    for classes in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(classes)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, _, w in words.slices(batch.column(place), lower=True, terms=True):
                    keep[[low + j for j, *_ in search_all(w, shared.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(rows, docs.schema)
    return out
