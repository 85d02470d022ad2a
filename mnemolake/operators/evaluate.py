"""Retrieval quality from result and relevance relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audit import percentiles


def judged(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, id, rank, rel: results (query_id, id, rank) with 1 where relevant (query_id, id) has them."""
    known = relevant.select("query_id", "id").distinct().withColumn("rel", F.lit(1))
    return results.join(known, ["query_id", "id"], "left").select("query_id", "id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def query_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, f1, rr, ndcg, success; queries without relevant rows are left out."""
    totals = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = judged(results.filter(F.col("rank") <= k), relevant)
    gain = F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    df = totals.join(per, "query_id", "left").fillna(0, ["n", "hits", "dcg"])
    recall = F.col("hits") / F.col("n_relevant")
    precision = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
    rr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return df.select("query_id", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), rr.alias("rr"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("hits") > 0).alias("success"))


def by_kind(metrics: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, n, success_rate, mean recall, precision, rr, ndcg over successful queries; kind null: all queries."""
    df = metrics.join(kinds, "query_id")
    means = [F.coalesce(F.avg(F.when(F.col("success"), F.col(c))), F.lit(0.0)).alias(c) for c in ("recall", "precision", "rr", "ndcg")]
    return df.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), *means)


def context_precision(scored: DataFrame) -> DataFrame:
    """query_id, precision: the share of places (rank) that hold the row of that place by relevance."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("rank")))
    placed = scored.withColumn("same", (ideal == F.col("rank")).cast("double"))
    return placed.groupBy("query_id").agg(F.avg("same").alias("precision"))


def answerability(scored: DataFrame, useful: float = 0.5) -> DataFrame:
    """query_id, context_relevance, answerability: means of relevance, and half the useful share with half the best."""
    share = F.avg((F.col("relevance") > useful).cast("double"))
    return scored.groupBy("query_id").agg(F.avg("relevance").alias("context_relevance"), (0.5 * share + 0.5 * F.max("relevance")).alias("answerability"))


def distribution(df: DataFrame, column: str, target: float, tie: str) -> DataFrame:
    """n, mean, share at the target, least, most, nearest-rank quartiles and p95, sample deviation of a column.

    The quartiles come from ranks over sorted ranges, ties by ``tie``, so no task has all values.
    """
    c = F.col(column)
    sums = df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.avg((c >= target).cast("double")).alias("target_share"), F.min(c).alias("least"), F.max(c).alias("most"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd")
    )
    ranks = percentiles(df.withColumn("_all", F.lit(0)), "_all", column, tie, (0.25, 0.5, 0.75, 0.95)).drop("_all")
    return sums.crossJoin(ranks).select("n", "mean", "target_share", "least", "most", "p25", "p50", "p75", "p95", "sd")  # one row each


def needle_places(needles: DataFrame, n_distractors: int, seed: int = 42) -> DataFrame:
    """Needles (query_id) with the place among the distractors that a hash deals them."""
    return needles.withColumn("place", F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(n_distractors + 1)).cast("int"))


def needle_haystack(needles: DataFrame, corpus: DataFrame, n_distractors: int, seed: int = 42) -> DataFrame:
    """query_id, id, place, is_needle: each needle (query_id, id) among rows of the corpus (id) that a hash picks for it.

    The corpus is dealt to numbered slots by a hash of the id; each needle takes one row, the
    least by hash, of each of ``n_distractors`` slots, itself aside, and stands at its place.
    """
    slot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_distractors)).cast("int")
    two = corpus.select("id", slot.alias("slot"), F.xxhash64("id", F.lit(seed + 1)).alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("h", "id"))).filter("r <= 2")
    two = two.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("x"))  # two rows for each slot
    own = needle_places(needles.select("query_id", F.col("id").alias("needle")), n_distractors, seed)
    picked = own.join(F.broadcast(two)).withColumn("id", F.when(F.col("x")[0]["id"] == F.col("needle"), F.get(F.col("x"), F.lit(1))["id"]).otherwise(F.col("x")[0]["id"])).filter("id IS NOT NULL")
    hay = picked.select("query_id", "id", (F.col("slot") + (F.col("slot") >= F.col("place")).cast("int")).alias("place"), F.lit(False).alias("is_needle"))
    return hay.unionByName(own.select("query_id", F.col("needle").alias("id"), "place", F.lit(True).alias("is_needle")))


def needle_hits(haystack: DataFrame, scores: DataFrame, most: int = 5) -> DataFrame:
    """query_id, rank, hit: where each needle ranks by score (query_id, id, score), the best first, and whether within ``most``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked_rows = haystack.join(scores, ["query_id", "id"]).withColumn("rank", rank)
    return ranked_rows.filter("is_needle").select("query_id", F.col("rank").cast("long").alias("rank"), (F.col("rank") <= most).alias("hit"))


def coverage(scored: DataFrame) -> DataFrame:
    """query_id, coverage: the best relevance (cosine to a context or answer), at least 0."""
    return scored.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.max("relevance")).alias("coverage"))


def overall(df: DataFrame, *metrics: str) -> DataFrame:
    """The rows with ``overall``: the mean of the metrics that are present."""
    present = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    return df.withColumn("overall", F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)))


# Targets of the metrics.
TARGETS = {"recall": 0.7, "precision": 0.8, "faithfulness": 0.85, "ndcg": 0.8, "rr": 0.75}
KINDS = ("single_hop", "multi_hop", "temporal", "knowledge_update", "adversarial")


# What a query of each kind asks; {} is a memory's topic.
TEMPLATES = {
    "single_hop": "What did I say about {}?", "multi_hop": "How does {} relate to what I said before?", "temporal": "When did I last mention {}?",
    "knowledge_update": "What is the latest about {}?", "adversarial": "Did I ever mention that {} is impossible?",
}


def synthetic_suite(df: DataFrame, n_queries: int, per_query: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(queries: query_id, kind, session_id, text; relevant: query_id, id): queries of five kinds in turn, each with memories (session_id, id, content) of one session.

    Sessions are dealt to as many slots as there are queries by a hash; a query takes the
    session of the least hash in its slot, or in an empty slot that of the next, in a circle.
    Its text asks for the topic, the first words, of its first memory by hash.
    """
    slot = F.pmod(F.xxhash64("session_id", F.lit(seed)), F.lit(n_queries))
    first = df.select("session_id").distinct().groupBy(slot.alias("slot")).agg(F.min_by("session_id", F.struct(F.xxhash64("session_id", F.lit(seed + 1)), "session_id")).alias("session_id"))
    # one row for each query at most, in a window: the size of the suite, not of the memories
    ids = df.sparkSession.range(n_queries).withColumnRenamed("id", "query_id").join(first, F.col("query_id") == F.col("slot"), "left")
    forward, everything = Window.orderBy("query_id").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.coalesce(F.first("session_id", ignorenulls=True).over(forward), F.first("session_id", ignorenulls=True).over(everything))
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("query_id") % len(KINDS) + 1).cast("int"))
    queries = ids.select("query_id", kinds.alias("kind"), found.alias("session_id")).filter("session_id IS NOT NULL")
    picked = Window.partitionBy("query_id").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    rows = queries.join(df.select("session_id", "id", "content"), "session_id").withColumn("rank", F.row_number().over(picked)).filter(F.col("rank") <= per_query)
    topic = F.array_join(F.slice(F.filter(F.split("content", "\\s+"), lambda w: w != ""), 1, 3), " ")
    template = F.element_at(F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv)), F.col("kind"))
    texts = rows.filter("rank = 1").select("query_id", F.replace(template, F.lit("{}"), topic).alias("text"))
    return queries.join(texts, "query_id", "left"), rows.select("query_id", "id")


def meets_targets(metrics: DataFrame) -> DataFrame:
    """The metrics with ``met_<name>`` for each of TARGETS that they hold."""
    return metrics.withColumns({f"met_{k}": F.col(k) >= v for k, v in TARGETS.items() if k in metrics.columns})
