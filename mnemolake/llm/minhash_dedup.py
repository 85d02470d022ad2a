"""Near-duplicate classes by b-bit MinHash.

Each document's set of word shingles gets HASHES minima. BANDS groups of ROWS minima give
candidates; the low BITS of every minimum are packed into one signature, and equal
positions, counted on the XOR of two signatures and corrected for chance collisions,
estimate the similarity of candidates. Those that may reach the threshold are confirmed
on full sets.

Exact copies of a set are folded into one representative first, by a partial aggregate.
Representatives are confirmed against the least member of a band bucket. Buckets that
still hold several components then give loose groups, of members whose signatures and
sizes allow links between components, as one edge for each member; the links within a
group are found on full sets and come out as a spanning forest. Pairs are compared where
they lie and never emitted. Every member outside a bucket's or group's largest component
meets all its members, in pairs of blocks of at most about SPLIT / 2, so that no task holds
a large one as a whole and no pair that shares a band is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native, words
from .components import connected_components
from .store import Scratch, written

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
SHINGLE = 4
#: Estimates so many standard errors below the threshold are given up: under one link in 10 ** 6 at the threshold, fewer above it.
DEVIATIONS = 5.0
#: About the most rows of a bucket or group that one task compares.
SPLIT = 2000
_MULTIPLY = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(8).integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.ChunkedArray, n: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, offsets): the sorted distinct shingles of each text of a slice.

    A text of fewer than n words, but one, has the whole sequence as its shingle.
    """
    for low, high, w in words.slices(texts, lower=True):
        at, owner = words.inside(w.first, n)
        h = words.window_hashes(w.hashes, n)[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < n))
        if len(short):
            whole = np.array([_sequence(w.hashes[w.first[j] : w.first[j + 1]]) for j in short], np.uint64)
            h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield low, high, h, np.searchsorted(owner, np.arange(high - low + 1))


def _sequence(hashes: np.ndarray) -> int:
    return int(words.window_hashes(hashes, len(hashes))[0] ^ np.uint64(len(hashes) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def minima(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima, 64 bits each, of every set that isn't empty; others get zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    block = 1 << 15  # values that stay in cache
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(offsets[full], offsets[full[i]] + block)))
        low, high = offsets[full[i]], offsets[full[j - 1] + 1]
        part, starts = h[low:high], offsets[full[i:j]] - low
        for k in range(HASHES):
            x = part * _MULTIPLY[k] + _ADD[k]
            out[full[i:j], k] = np.minimum.reduceat(x, starts)
        i = j
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, BITS each, as bytes: one row for each document."""
    low = (words.mix(mins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(((low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1).reshape(len(low), -1), axis=1)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    grouped = mins.reshape(len(mins), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), grouped.shape[:2]).copy()
    for r in range(ROWS):
        out = words.mix(out * np.uint64(0xD6E8FEB86659FD93) + grouped[:, :, r])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, by bit counts, corrected for collisions of low bits."""
    x = np.bitwise_xor(a, b).view(np.uint64)
    for k in (1, 2):  # a position differs if any of its BITS bits does
        x = x | x >> np.uint64(k)
    equal = 1 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """_id, n_shingles, fp (128-bit fingerprint of the set), sig, bands of each row of _id, _text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, h, offsets in shingle_sets(batch.column(1), n):
                mins = minima(h, offsets)
                sizes = np.diff(offsets)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ np.uint64(seed)))]) for seed in (3, 5)]
                fp = np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], axis=1)
                bands, sig = band_keys(mins).view(np.int64), pack(mins)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([x.tobytes() for x in fp], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.array([x.tobytes() for x in bands], pa.binary()),
                    ],
                    ["_id", "n_shingles", "fp", "sig", "bands"],
                )

    return docs.mapInArrow(rows, "_id long, n_shingles long, fp binary, sig binary, bands binary")


def _buckets(reps: DataFrame) -> DataFrame:
    """key, id, sig for each band of each representative."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("bands").to_pylist()])
                take = np.repeat(np.arange(batch.num_rows), BANDS)
                yield pa.record_batch([pa.array(keys), batch.column("id").take(pa.array(take))], ["key", "id"])

    return reps.select("id", "bands").mapInArrow(rows, "key long, id long")


def _spread(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of ``table`` (id, columns) for both ends, as a_ and b_.

    A pair's a may be that of very many: its row of the table is repeated once for each SPLIT
    pairs, and these are dealt by a hash of b. The ends that are repeated, of which there are
    fewer than one for each SPLIT pairs, are broadcast with their numbers.
    """
    many = F.broadcast(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT))
    parts = F.coalesce(F.ceil(F.col("n") / SPLIT).cast("int"), F.lit(1))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    left = table.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    left = left.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    right = table.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return dealt.join(left.hint("merge"), ["a", "part"]).join(right.hint("merge"), "b").select("a", "b", *(f"a_{c}" for c in columns), *(f"b_{c}" for c in columns))


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""
    joined = _spread(pairs, texts, ["_text"])

    def rows(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [[h[offsets[k] : offsets[k + 1]] for _, _, h, offsets in shingle_sets(part.column(c), n) for k in range(len(offsets) - 1)] for c in (2, 3)]
                for k, (x, y) in enumerate(zip(*sets)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[low + k] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return joined.mapInArrow(rows, "a long, b long")


def _open(members: DataFrame, key: str) -> DataFrame:
    """Members (key, id, comp) of the keys that hold several components, with the key's largest component and sizes."""
    counts = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("own"))
    sizes = counts.groupBy(key).agg(
        F.max_by("comp", F.struct("own", "comp")).alias("largest"), F.sum("own").alias("total"), (F.sum("own") - F.max("own")).alias("movers"), F.count(F.lit(1)).alias("comps")
    )
    return native.join_split(members, sizes.filter("comps > 1").drop("comps"), key, "total")


def _dealt(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, i, j, alone, moves, id, comp, columns: the members in which every member outside the largest component meets all members.

    Those outside it, the movers, are cut into blocks of about SPLIT / 2, and so are all
    members; a task holds one block of each, whatever the size of the key's group.
    ``alone`` says that there is one block of each: its rows are then given once, and the movers are those of another component than ``largest``.
    """
    blocks = lambda size: F.ceil(F.col(size) * 2 / SPLIT).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    hashed = lambda n, *salt: F.pmod(F.xxhash64("id", *map(F.lit, salt)), n).cast("int")
    mover = F.col("comp") != F.col("largest")
    alone = (blocks("movers") == 1) & (blocks("total") == 1)
    sized = members.withColumns({"alone": alone, "mover": mover})
    whole = sized.withColumns({"j": hashed(blocks("total")), "i": F.explode(numbers(blocks("movers")))}).withColumn("moves", F.col("mover") & F.col("alone"))
    moved = sized.filter(mover & ~alone).withColumns({"i": hashed(blocks("movers"), 1), "j": F.explode(numbers(blocks("total")))}).withColumn("moves", F.lit(True))
    rows = whole.select(key, "i", "j", "alone", "moves", "id", "comp", *columns).unionByName(moved.select(key, "i", "j", "alone", "moves", "id", "comp", *columns))
    # by number, as tasks are few bytes but much work
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "i", "j")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(movers, members to meet): rows of a dealt group; alone, the movers are among the members."""
    moves = table.column("moves").to_numpy(zero_copy_only=False)
    alone = table.column("alone")[0].as_py()
    return np.flatnonzero(moves), np.arange(len(moves)) if alone else np.flatnonzero(~moves)


def _loose(percent: int):
    """Edges that join the members of a bucket which links between different components may reach.

    A pair may be linked if its signatures and set sizes allow it; each member found in such
    a pair gets one edge to the least member of its local group, so edges are fewer than members.
    """
    least = least_estimate(percent / 100)

    def rows(table: pa.Table) -> pa.Table:
        ids, comps, sizes = (table.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        movers, others = _sides(table)
        _, local = np.unique(comps, return_inverse=True)
        root = np.arange(int(local.max()) + 1)
        touched = np.zeros(len(ids), bool)
        own_sizes, own_local, own_sigs = sizes[others], local[others], sigs[others]
        for i in movers:
            fits = (100 * np.minimum(own_sizes, sizes[i]) >= percent * np.maximum(own_sizes, sizes[i])) & (own_local != local[i])
            near = np.flatnonzero(fits)
            hit = others[near[estimate(sigs[i], own_sigs[near]) >= least]]
            if len(hit):
                touched[hit] = touched[i] = True
                own, found = _find(root, int(local[i])), {_find(root, int(c)) for c in np.unique(local[hit])}
                for c in found:
                    root[max(c, own)] = own = min(c, own)
        groups = np.array([_find(root, c) for c in range(len(root))])[local]
        picked = np.flatnonzero(touched)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.unique(groups[picked]):
            own = np.unique(ids[picked[groups[picked] == g]])
            a.append(np.full(len(own) - 1, own[0]))
            b.append(own[1:])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def _exact(n: int, percent: int):
    """Pairs of components that links between a group's members join, on full sets: a spanning forest of them."""

    def rows(table: pa.Table) -> pa.Table:
        comps = table.column("comp").to_numpy()
        movers, others = _sides(table)
        parts = list(shingle_sets(table.column("_text"), n))
        sizes = np.concatenate([np.diff(offsets) for *_, offsets in parts])
        _, values = np.unique(np.concatenate([h for _, _, h, _ in parts]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(sizes)])
        named, local = np.unique(comps, return_inverse=True)
        root = np.arange(len(named))
        mark = np.zeros(int(values.max()) + 1, np.int32)
        a, b = [], []
        for i in movers:
            own = values[first[i] : first[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[values], first[:-1])[others]
            mark[own] = 0
            for j in others[(100 * common >= percent * (sizes[others] + sizes[i] - common)) & (local[others] != local[i])]:
                x, y = _find(root, int(local[i])), _find(root, int(local[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(named[x])
                    b.append(named[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: the id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    lower-case (A-Z) word shingles. ``component_id`` is the least id reachable by links,
    ``kept`` says that it is the row's own. A text of fewer words than a shingle is one
    shingle of all its words; an empty or null text has no shingles and links with nothing.
    Rows with one id and one set are one document, and all kept or none; of rows with one id and
    different sets, the links of the least text count. Ids are whole numbers. A null id counts as
    smaller than all others; texts without an id are told apart by a hash of the text, and a
    component that holds one has a null ``component_id``. Shingles are compared by 64-bit hashes.
    A very long text is one row with its whole set. An empty table gives no rows. Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = native.quoted(text_col)
    # ids below 2 ** 62 stand for rows without one, by the hash of the text
    nameless = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.coalesce(F.xxhash64(text), F.lit(0)), 3)
    own = docs.select(F.coalesce(native.whole_number(docs, id_col), nameless).alias("_id"), text.alias("_text"))
    sigs = scratch.written(signatures(own, shingle))
    reps = sigs.filter("n_shingles > 0").groupBy("fp").agg(F.min(F.struct("_id", "n_shingles", "sig", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.written(reps.select("fp", F.col("r._id").alias("id"), "r.n_shingles", "r.sig", "r.bands", "copies"))
    buckets = _buckets(reps)
    crowded = buckets.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    members = scratch.written(native.join_split(buckets, crowded, "key", "n").select("key", "id", "least"))
    # each representative meets the least member of its buckets that it meets most often
    star = members.filter("id <> least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("bands"))
    star = star.groupBy("id").agg(F.min(F.struct((-F.col("bands")).alias("fewer"), "least")).alias("best")).select(F.col("best.least").alias("a"), F.col("id").alias("b"))
    involved = members.select("id").distinct()
    sig_of = scratch.written(reps.join(involved, "id", "left_semi").select("id", "n_shingles", "sig"))
    # the ids grow with the corpus, so they are not left to a broadcast at small sizes
    holders = own.filter(F.col("_text").rlike(native.WORD)).join(sig_of.select(F.col("id").alias("_id")).hint("merge"), "_id", "left_semi")
    texts = scratch.written(holders.groupBy(F.col("_id").alias("id")).agg(F.min("_text").alias("_text")))
    star = scratch.written(star)
    # what several parts of a query read is written first, so that no part computes it anew
    likely = scratch.written(_estimated(star, sig_of, least_estimate(percent / 100)))
    links = scratch.written(confirm(likely, texts, shingle, percent))
    scratch.drop(star)
    scratch.drop(likely)
    comps = connected_components(links, scratch)
    labelled = members.join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    opened = scratch.written(_open(labelled, "key"))
    scratch.drop(members)
    still_open = _dealt(opened.join(sig_of.hint("merge"), "id"), "key", ["n_shingles", "sig"])
    loose = scratch.written(still_open.groupBy("key", "i", "j").applyInArrow(_loose(percent), "a long, b long").distinct())
    scratch.drop(opened)
    scratch.drop(sig_of)
    joined = None
    if not loose.isEmpty():
        groups = connected_components(loose, scratch).select(F.col("node").alias("id"), F.col("component").alias("loose"))
        labelled = groups.join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("loose", "id", F.coalesce("component", "id").alias("comp"))
        near = _dealt(scratch.written(_open(labelled, "loose")).join(texts.hint("merge"), "id"), "loose", ["_text"])
        more = scratch.written(near.groupBy("loose", "i", "j").applyInArrow(_exact(shingle, percent), "a long, b long"))
        scratch.drop(texts)
        # what the later links join are components, so those are settled anew, not all links
        joined = connected_components(more, scratch).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    classes = reps.join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("fp", "copies", F.coalesce("component", "id").alias("component"))
    if joined is not None:
        classes = classes.join(joined.hint("merge"), "component", "left").select("fp", "copies", F.coalesce("joined", "component").alias("component"))
    # a class can hold the least id of its component only through its representative
    placed = native.join_split(sigs.filter("n_shingles > 0").select("_id", "n_shingles", "fp"), classes, "fp", "copies").select("_id", "n_shingles", "component")
    out = placed.unionByName(sigs.filter("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component")))
    named = lambda c: F.when(F.col(c) >= -(1 << 62), F.col(c))
    out = written(out.select(named("_id").alias(id_col), "n_shingles", named("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept")))
    scratch.drop()
    return out


def _estimated(pairs: DataFrame, sig_of: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures allow a similarity of the threshold."""
    joined = _spread(pairs, sig_of, ["sig"])

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(estimate(x, y) >= least))

    return joined.mapInArrow(rows, "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, repeated rows once, with all their columns.

    Documents without shingles are all kept. Of documents without an id, which no id tells
    apart, each distinct text stays. Whole rows are dealt once, to be joined with the narrow list
    of the ids that go; those of ids that occur more than once, and those without an id, are
    compared as rows, if there are any.
    """
    scratch = Scratch(docs.sparkSession)
    identity = native.quoted(id_col)
    verdict, times, keeps, own_th = native.fresh(docs.columns, "_verdict_id", "_times", "_keeps", "_text_hash")
    found = near_duplicates(docs, id_col, text_col, shingle, percent).filter(identity.isNotNull())
    special = found.groupBy(identity.alias(verdict)).agg(F.count(F.lit(1)).alias(times), F.min("kept").alias(keeps)).filter(f"{times} > 1 OR NOT {keeps}")
    special = scratch.written(special)
    columns = [native.quoted(c) for c in docs.columns]
    out = docs.filter(identity.isNotNull()).join(special.hint("merge"), identity == F.col(verdict), "left_anti").select(*columns)
    repeated = special.filter(keeps)
    if not repeated.isEmpty():
        several = docs.join(repeated.hint("merge"), identity == F.col(verdict), "left_semi").withColumn(own_th, F.xxhash64(native.quoted(text_col)))
        out = out.unionByName(several.dropDuplicates([id_col, own_th]).select(*columns))
    nameless = docs.filter(identity.isNull())
    if not nameless.isEmpty():
        out = out.unionByName(nameless.withColumn(own_th, F.xxhash64(native.quoted(text_col))).dropDuplicates([own_th]).select(*columns))
    return out
