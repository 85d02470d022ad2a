"""Dense, sparse and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx

K1, B = 1.5, 0.75
RRF_K = 60
DENSE_WEIGHT, SPARSE_WEIGHT = 0.6, 0.4


#: Bounds of arguments: how many rows a search may return, by kind, and thresholds of likeness.
LIMITS = {"recall": 20, "list": 100, "search": 50}
THRESHOLDS = (0.5, 0.99)


def clamped_limit(k: int, kind: str = "search") -> int:
    return max(1, min(LIMITS[kind], k))


def clamped_threshold(x: float) -> float:
    return max(THRESHOLDS[0], min(THRESHOLDS[1], x))


def dense_topk(
    df: DataFrame, query: Sequence[float], k: int = 5, floor: float | None = None, score: Column | None = None, id_col: str = "id", vector_col: str = "embedding", ties: Sequence[Column] = ()
) -> DataFrame:
    """The k rows of the best score (default: cosine with the query), ties by ``ties`` and id, at or above ``floor``.

    The floor is applied after the limit: rows are in order of the score, so the same remain,
    and each score is computed once.
    """
    score = vx.cosine(F.col(vector_col), vx.literal(query)) if score is None else score
    top = df.filter(F.col(vector_col).isNotNull()).withColumn("score", score).orderBy(F.desc("score"), *ties, F.asc(id_col)).limit(k)
    return top if floor is None else top.filter(F.col("score") >= floor)


def newest_first() -> list[Column]:
    """The order of ties that puts the newest first."""
    return [F.desc("created_at")]


#: Queries that are sent to the tasks of the corpus as they are; more are dealt to blocks.
FEW_QUERIES = 1024
#: Rows of one part of the corpus, about, and scores that a worker holds at once.
PART_ROWS, PRODUCT = 16384, 1 << 21


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    v = vectors.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def nearest(asked_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): the k rows of the highest inner product for each query, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    m, out = min(k, len(ids)), []
    for low in range(0, len(asked) if m else 0, step := max(1, PRODUCT // max(1, len(ids)))):
        scores = asked[low : low + step] @ vectors.T
        least = np.partition(scores, len(ids) - m, axis=1)[:, len(ids) - m]
        for r, q in enumerate(asked_ids[low : low + step]):
            at = np.flatnonzero(scores[r] >= least[r])
            at = at[np.argsort(-scores[r][at], kind="stable")[:m]]  # ids are in order, so equal scores are too
            out.append((np.full(m, q), ids[at], scores[r][at]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def batch_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", block: int = 512) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows by cosine for each row of queries (query_id, vector).

    Up to FEW_QUERIES go to the tasks of the corpus, which is not shuffled; more are dealt to
    blocks of about ``block``, and the corpus to parts of about PART_ROWS. Each task keeps the k
    best of each query, and a window keeps the k best of those. Rows without a vector are left out.
    """
    q = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    x = corpus.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    few = q.limit(FEW_QUERIES + 1).collect()
    local = _of_few(few, x, k) if len(few) <= FEW_QUERIES else _of_blocks(q, x, k, block)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return local.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def _of_few(few: list, x: DataFrame, k: int) -> DataFrame:
    asked_ids = np.array([r["id"] for r in few], np.int64)
    asked = units(np.array([r["v"] for r in few], np.float64)) if few else np.zeros((0, 1))
    shared = x.sparkSession.sparkContext.broadcast((asked_ids, asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        for batch in batches:
            if batch.num_rows and len(own_ids):
                v = units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.record_batch(list(map(pa.array, nearest(own_ids, own, batch.column(0).to_numpy(), v, k))), ["query_id", "id", "score"])

    return x.mapInArrow(best, "query_id long, id long, score double")


def _of_blocks(q: DataFrame, x: DataFrame, k: int, block: int) -> DataFrame:
    n = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-x.count() // PART_ROWS))
    blocks = q.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("id"), F.lit(n))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.lit(n)).otherwise(F.col("blocks")) - 1))
    both = q.withColumn("side", F.lit(0)).unionByName(x.withColumn("side", F.lit(1)))
    dealt = both.crossJoin(F.broadcast(blocks)).withColumns({"own": own, "other": other})  # one row of a number
    i, j = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")).alias(c) for s, c in ((0, "i"), (1, "j")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        if not all(map(len, sides)):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        (asked_ids, asked), (ids, v) = ((side["id"].to_numpy(), units(np.stack(side["v"].to_numpy()))) for side in sides)
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), nearest(asked_ids, asked, ids, v, k))))

    return dealt.select("id", "v", "side", i, j).groupBy("i", "j").applyInPandas(best, "query_id long, id long, score double")


def doc_terms(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, term, tf: the inverted index; write it partitioned or bucketed by term for many searches."""
    return df.select(F.col(id_col).alias("id"), F.explode(tx.terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, query: str, id_col: str = "id", text_col: str = "content", require_all: bool = False) -> DataFrame:
    """id, score for rows that hold a term of the query, or all of them.

    Only the query's terms are exploded; lengths and document frequencies come from one
    aggregate over the projected counts, and no text is shuffled.
    """
    wanted = query_terms(query)
    if not wanted:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    words = tx.terms(F.col(text_col))
    counts = df.select(F.col(id_col).alias("id"), words.alias("w")).select(
        "id", F.size("w").alias("dl"), *(_count(F.col("w"), t).alias(f"t{k}") for k, t in enumerate(wanted))
    )
    n_terms = range(len(wanted))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"t{k}") > 0).alias(f"df{k}") for k in n_terms))
    score = F.lit(0.0)
    for k in n_terms:
        idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5) + 1)
        tf = F.col(f"t{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    present = sum(((F.col(f"t{k}") > 0).cast("int") for k in n_terms), F.lit(0))
    held = counts.filter(present == len(wanted) if require_all else present > 0)
    return held.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row of statistics


def _count(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


def query_terms(query: str) -> list[str]:
    """The distinct search terms of a query, in order."""
    import regex

    return list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+", query.lower()) if len(t) >= 2))


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.asc("id")).limit(k)


def searchable(df: DataFrame) -> DataFrame:
    """id, content: the content with the topics and entities, where the table has them."""
    lists = [F.array_join(F.col(c), " ") for c in ("topics", "entities") if c in df.columns]
    return df.select("id", F.concat_ws(" ", "content", *lists).alias("content"))


def fts_search(df: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Rows whose content, topics or entities hold every term, best BM25 first; ``fts_score`` is 1 / (1 + score), lower for better matches."""
    return top(bm25(searchable(df), query, require_all=True), k).withColumn("fts_score", 1 / (1 + F.abs("score")))


def trigram_search(df: DataFrame, query: str, k: int = 10, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Rows by the number of the query's trigrams that they hold, all of them first."""
    q = query.lower()
    grams = list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2)))
    lower = F.lower(F.col(text_col))
    held = sum((F.contains(lower, F.lit(g)).cast("int") for g in grams), F.lit(0))
    return top(df.select(F.col(id_col).alias("id"), held.cast("double").alias("score")).filter("score > 0"), k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 5, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """id, score, dense_score, sparse_score, kind by weighted reciprocal ranks of two short ranked lists."""
    order = Window.orderBy(F.desc("score"), F.asc("id"))
    legs = [
        leg.select("id", F.col("score").alias(f"{name}_score"), (F.lit(w) / (RRF_K + F.row_number().over(order))).alias(f"{name}_part"))
        for leg, name, w in ((dense, "dense", dense_weight), (sparse, "sparse", sparse_weight))
    ]
    both = legs[0].join(legs[1], "id", "full_outer").fillna(0.0, ["dense_score", "sparse_score", "dense_part", "sparse_part"])
    kind = F.when((F.col("dense_score") > 0) & (F.col("sparse_score") > 0), "hybrid").when(F.col("dense_score") > 0, "dense").otherwise("sparse")
    scored = both.select("id", (F.col("dense_part") + F.col("sparse_part")).alias("score"), "dense_score", "sparse_score", kind.alias("kind"))
    return top(scored, k)


def hybrid_search(df: DataFrame, query: str, vector: Sequence[float], k: int = 5, over_fetch: int = 3, index=None, floor: float | None = None, whole: bool = False) -> DataFrame:
    """Dense and BM25 legs over the same filtered rows, ``over_fetch`` times as long, fused.

    With a ``TermIndex`` the sparse leg reads its postings, and else the texts: with one of
    just these rows (``whole``) the best blocks of them, with one of more rows all, of which only ids
    of ``df`` count.
    """
    dense = dense_topk(df, vector, k * over_fetch, floor).select("id", "score")
    if index is not None and whole:
        return rrf(dense, index.best(query, k * over_fetch), k)
    sparse = bm25(df, query) if index is None else index.scores(query, only=df)
    return rrf(dense, top(sparse, k * over_fetch), k)


def related(df: DataFrame, key: int, k: int = 5, index=None) -> DataFrame:
    """The rows most like one of ``df`` by its own text and vector, without itself."""
    own = df.filter(F.col("id") == key).select("content", "embedding").first()
    if own is None:
        return df.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("dense_score"), F.lit(0.0).alias("sparse_score"), F.lit("").alias("kind")).limit(0)
    vector = [float(x) for x in own["embedding"] or []]
    found = hybrid_search(df.filter(F.col("id") != key), own["content"] or "", vector or [0.0], k, index=index)
    return found


def mmr_fused(fused: DataFrame, vectors: DataFrame, weight: float = 0.7) -> DataFrame:
    """id, position: all rows of a fused result (id, score) in the order of marginal relevance; the best stays first."""
    n = fused.count()  # of a top-k
    rows = fused.join(vectors.select("id", "vector"), "id").select(F.lit(0).alias("query_id"), "id", "score", "vector")
    return mmr(rows, n, weight, every=True).select("id", "position")


def max_over_queries(hits: DataFrame, k: int) -> DataFrame:
    """The best score of each id over several queries, the k best."""
    return top(hits.groupBy("id").agg(F.max("score").alias("score")), k)


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, group: str = "query_id", every: bool = False) -> DataFrame:
    """group, id, position: maximal marginal relevance over each group's candidates (id, score, vector).

    Candidates are those of a top-k, so a group is short. With no more than k they stay in
    order, unless ``every`` asks for all of them to be ordered anew.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen = list(range(len(pdf)))
        if len(pdf) > k or every:
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            chosen, similar = [], np.zeros(len(pdf))
            left = np.ones(len(pdf), bool)
            for _ in range(min(k, len(pdf))):
                gain = np.where(left, weight * pdf["score"].to_numpy() - (1 - weight) * similar, -np.inf)
                best = int(np.argmax(gain))
                chosen.append(best)
                left[best] = False
                likeness = x @ x[best]
                similar = np.maximum(similar, likeness) if len(chosen) > 1 else likeness
        return pd.DataFrame({group: pdf[group].iloc[0], "id": pdf["id"].to_numpy()[chosen], "position": range(1, len(chosen) + 1)})

    return candidates.groupBy(group).applyInPandas(pick, f"{group} {candidates.schema[group].dataType.simpleString()}, id long, position int")
