"""Substring dedup by difference-cover anchors.

``DifferenceCover(window)`` picks a period v and a cover D of residues such that any two
offsets share an aligned position: for all i, j there is k < v with (i + k) mod v and
(j + k) mod v both in D. Word n-grams of length m = window - v + 1 are hashed only at
positions p with p mod v in D, so two occurrences of the same window share an aligned
anchor wherever they start. Only windows around an anchor that another document holds
too are extended to the full window and compared.

Both rounds exchange sorted hash arrays between groups of documents and buckets of
hashes: a group sends each distinct hash once, so the commonest passage puts one entry
for each group into its bucket, and gets a bitmap back. Nothing is kept for pairs.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, words

#: (period, cover): every difference modulo the period is that of two members.
COVERS = ((1, (0,)), (3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (0, 1, 4, 14, 16)))
ANCHOR_BYTES = 5
_LOWEST = np.iinfo(np.int64).min


def choose_cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length): the longest period that leaves anchors of at least half a window."""
    v, cover = max((x for x in COVERS if x[0] <= max(1, window // 2 + 1)), key=lambda x: x[0])
    return v, cover, window - v + 1


def _sorted_words(table: pa.Table):
    """doc ids (null: lowest) and words of a group, in slices."""
    ids = table.column("_id").fill_null(_LOWEST).to_numpy()
    for low, high, w in words.slices(table.column("_text")):
        yield ids[low:high], w


def _anchors(w: words.Words, v: int, cover: tuple[int, ...], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, owner, hash) of the anchors of a slice."""
    at, owner = words.inside(w.first, m)
    take = np.isin((at - w.first[:-1][owner]) % v, cover)
    at, owner = at[take], owner[take]
    return at, owner, words.window_hashes(w.hashes, m)[at]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)


def _pack(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _group_anchors(table: pa.Table, buckets: int, v: int, cover: tuple, m: int):
    """Distinct anchors of a group, sorted by (bucket, short hash), and whether several of its documents hold them."""
    keys, owners, base = [], [], 0
    for ids, w in _sorted_words(table):
        _, owner, h = _anchors(w, v, cover, m)
        keys.append(np.stack([_bucket(h, buckets).astype(np.uint64), _short(h)]))
        owners.append(ids[owner])
    if not keys:
        return np.zeros((2, 0), np.uint64), np.zeros(0, bool)
    keys, owners = np.concatenate(keys, axis=1), np.concatenate(owners)
    joint = keys[0] << np.uint64(8 * ANCHOR_BYTES) | keys[1]
    order = np.lexsort((owners, joint))
    joint, owners = joint[order], owners[order]
    new = np.ones(len(joint), bool)
    new[1:] = joint[1:] != joint[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(joint)) - 1
    several = owners[start] != owners[end] if len(start) else np.zeros(0, bool)
    joint = joint[start]
    return np.stack([joint >> np.uint64(8 * ANCHOR_BYTES), joint & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)]), several


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of a sorted array."""
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(edges, np.append(edges[1:], len(bucket)))]


def _group_windows(table: pa.Table, shared: pa.Table, buckets: int, window: int, v: int, cover: tuple, m: int):
    """Distinct candidate windows of a group, sorted by (bucket, hash): hash, lowest document, and how many.

    A candidate holds an anchor that another document holds too.
    """
    (bucket, short), _ = _group_anchors(table, buckets, v, cover, m)
    flags = np.zeros(len(bucket), bool)
    bits = dict(zip(shared.column("bucket").to_pylist(), shared.column("bits").to_pylist()))
    for b, i, j in _by_bucket(bucket):
        if b in bits:
            flags[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    known = (bucket << np.uint64(8 * ANCHOR_BYTES) | short)[flags]
    hashes, ids_out = [], []
    for ids, w in _sorted_words(table):
        at, owner, h = _candidates(w, known, buckets, window, v, cover, m)
        hashes.append(h)
        ids_out.append(ids[owner])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ids = np.concatenate(ids_out) if ids_out else np.zeros(0, np.int64)
    order = np.lexsort((ids, h, _bucket(h, buckets)))
    h, ids = h[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return known, h[new], ids[new]


def _candidates(w: words.Words, known: np.ndarray, buckets: int, window: int, v: int, cover: tuple, m: int):
    """(word position, owner, window hash) of the windows that hold a known anchor among their first v anchor places."""
    at, owner, h = _anchors(w, v, cover, m)
    joint = _bucket(h, buckets).astype(np.uint64) << np.uint64(8 * ANCHOR_BYTES) | _short(h)
    hit = at[_member(joint, known)]
    mark = np.zeros(len(w.hashes) + 1, np.int32)
    np.add.at(mark, np.maximum(hit - v + 1, 0), 1)
    np.add.at(mark, hit + 1, -1)
    near = np.cumsum(mark)[:-1] > 0
    at, owner = words.inside(w.first, window)
    take = near[at]
    at, owner = at[take], owner[take]
    return at, owner, words.window_hashes(w.hashes, window)[at]


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, partitions: int | None = None) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Returns for each row of ``docs``: the id, n_words, n_removed, kept_text (the kept
    words joined by one space). Windows are ``window`` consecutive words of one document,
    compared by 64-bit hashes and judged on the input. A null text has no words; a null id
    counts as the smallest; rows with one id are one document, and do not remove from each
    other. Ids are whole numbers. An empty table gives no rows; a very long text is a group
    of its own. Other columns are not read.

    Documents are dealt to groups of about GROUP_BYTES of text, at least two for each of
    ``partitions`` (default: the shuffle partitions); a Python worker holds one group several
    times over, or one bucket of the hashes of about four groups.
    """
    v, cover, m = choose_cover(window)
    own = docs.select(native.whole_number(docs, id_col).alias("_id"), native.quoted(text_col).alias("_text"))
    groups, _ = native.groups_by_bytes(own, "_text", partitions)
    buckets = max(partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 4)
    dealt = own.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(groups)).cast("int").alias("group"), "_id", "_text")

    def send_anchors(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        (bucket, short), several = _group_anchors(table, buckets, v, cover, m)
        out = [(b, group, _pack(short[i:j], ANCHOR_BYTES), np.packbits(several[i:j]).tobytes()) for b, i, j in _by_bucket(bucket)]
        return pa.Table.from_pylist([dict(zip(("bucket", "group", "hashes", "more"), x)) for x in out], schema=_SENT)

    def meet_anchors(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values = [_unpack(r["hashes"], ANCHOR_BYTES) for r in rows]
        several = [np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(x)).astype(bool) for r, x in zip(rows, values)]
        found, inverse, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[inverse[np.concatenate(several)]] = True
        flags = np.split(shared[inverse], np.cumsum([len(x) for x in values])[:-1])
        return _answers(rows, flags)

    def send_windows(key, table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SENT_WINDOWS.empty_table()
        group = key[0].as_py()
        _, h, ids = _group_windows(table, shared, buckets, window, v, cover, m)
        out = []
        for b, i, j in _by_bucket(_bucket(h, buckets)):
            low = int(ids[i:j].min())
            gaps = (ids[i:j] - np.int64(low)).view(np.uint64)
            width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
            out.append({"bucket": b, "group": group, "hashes": h[i:j].tobytes(), "low": low, "width": width, "owners": _pack(gaps, width)})
        return pa.Table.from_pylist(out, schema=_SENT_WINDOWS)

    def meet_windows(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        owners = np.concatenate([_unpack(r["owners"], r["width"]).view(np.int64) + np.int64(r["low"]) for r in rows])
        found, inverse = np.unique(np.concatenate(values), return_inverse=True)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, owners)
        flags = np.split(least[inverse] < owners, np.cumsum([len(x) for x in values])[:-1])
        return _answers(rows, flags)

    def finish(key, table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT.empty_table()
        anchors = shared.filter(pa.compute.equal(shared.column("step"), 1))
        later = shared.filter(pa.compute.equal(shared.column("step"), 2))
        known, h, ids = _group_windows(table, anchors, buckets, window, v, cover, m)
        elsewhere = np.zeros(len(h), bool)
        bits = dict(zip(later.column("bucket").to_pylist(), later.column("bits").to_pylist()))
        for b, i, j in _by_bucket(_bucket(h, buckets)):
            if b in bits:
                elsewhere[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
        order = np.argsort(h)
        h, ids, elsewhere = h[order], ids[order], elsewhere[order]
        n_words, n_removed, kept = [], [], []
        for own, w in _sorted_words(table):
            at, owner, found = _candidates(w, known, buckets, window, v, cover, m)
            mark = np.zeros(len(w.hashes) + 1, np.int32)
            if len(h):
                place = np.searchsorted(h, found)
                gone = at[elsewhere[place] | (ids[place] < own[owner])]
                np.add.at(mark, gone, 1)
                np.add.at(mark, gone + window, -1)
            keep = np.cumsum(mark)[:-1] == 0
            for j in range(len(own)):
                flags = keep[w.first[j] : w.first[j + 1]]
                parts = w.data[w.offsets[j] : w.offsets[j + 1]].tobytes().split()
                if not flags.all():
                    parts = list(compress(parts, flags.tolist()))
                n_words.append(len(flags))
                n_removed.append(len(flags) - len(parts))
                kept.append(b" ".join(parts).decode())
        return pa.table({"_id": table.column("_id"), "n_words": n_words, "n_removed": n_removed, "kept_text": kept}, schema=_RESULT)

    sent = dealt.groupBy("group").applyInArrow(send_anchors, "bucket int, group int, hashes binary, more binary")
    anchors = sent.groupBy("bucket").applyInArrow(meet_anchors, "group int, bucket int, bits binary")
    candidates = dealt.groupBy("group").cogroup(anchors.groupBy("group")).applyInArrow(
        send_windows, "bucket int, group int, hashes binary, low long, width int, owners binary"
    )
    earlier = candidates.groupBy("bucket").applyInArrow(meet_windows, "group int, bucket int, bits binary")
    both = anchors.withColumn("step", F.lit(1)).unionByName(earlier.withColumn("step", F.lit(2)))
    out = dealt.groupBy("group").cogroup(both.groupBy("group")).applyInArrow(finish, "_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", id_col)


def _answers(rows: list[dict], flags: list[np.ndarray]) -> pa.Table:
    out = [{"group": r["group"], "bucket": r["bucket"], "bits": np.packbits(x).tobytes()} for r, x in zip(rows, flags)]
    return pa.Table.from_pylist(out, schema=_ANSWER)


_SENT = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
_SENT_WINDOWS = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("hashes", pa.binary()), ("low", pa.int64()), ("width", pa.int32()), ("owners", pa.binary())])
_ANSWER = pa.schema([("group", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_RESULT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
