"""Queries over the memory relation, each with the same result in SQL where it has one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..functions.stem import stemmed_texts, with_stems
from ..operators import dedup, scoring, search, store, term_index, vector_index
from ..sources.scratch import new_folder
from ..sources.tables import MEMORIES_SQL, memories, table

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL over the tables and ``memories``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {MEMORIES_SQL} {sql}" if "memories" in sql else sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir, vectors=False, tombstones=False)


def _index(spark: SparkSession, sf_dir: str) -> term_index.TermIndex:
    return term_index.cached_index(spark, _texts(spark, sf_dir), "memories")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{new_folder(spark)}_{name}"


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _sql_dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _sql_cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"SELECT vec_id AS id, round({_sql_cos('embedding', _Q0)}, 6) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY {_sql_cos('embedding', _Q0)} DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir).filter("id <> 0")
    return search.dense_topk(corpus, _vector(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@query(
    f"SELECT id, user_id, round({_sql_cos('embedding', _Q0)}, 6) AS score FROM memories WHERE user_id IN ('src1', 'src2') AND type IN (0, 1, 2) AND NOT is_deleted AND embedding IS NOT NULL"
    f" ORDER BY {_sql_cos('embedding', _Q0)} DESC, id LIMIT 5"
)
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.scope(memories(spark, sf_dir), types=[0, 1, 2]).filter(F.col("user_id").isin("src1", "src2"))
    return search.dense_topk(rows, _vector(spark, sf_dir), 5).select("id", "user_id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT vec_id AS id, {_sql_cos('embedding', _Q0)} AS s FROM embeddings ORDER BY s DESC, id LIMIT 50) WHERE s >= 0.2")
def dense_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(_vectors(spark, sf_dir), _vector(spark, sf_dir), 50, floor=0.2).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({_sql_dot('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY {_sql_dot('embedding', _Q0)} DESC, vec_id LIMIT 10")
def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir)
    return search.dense_topk(_vectors(spark, sf_dir), v, 10, score=vx.dot(F.col("embedding"), vx.literal(v))).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), vec_id LIMIT 10")
def euclid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir)
    near = search.dense_topk(_vectors(spark, sf_dir), v, 10, score=-vx.euclidean(F.col("embedding"), vx.literal(v)))
    return near.select("id", F.round(-F.col("score"), 6).alias("distance"))


@query(f"SELECT vec_id AS id, round(({_sql_cos('embedding', _Q0)} + 1) / 2, 6) AS score FROM embeddings")
def cosine01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vx.literal(_vector(spark, sf_dir))
    return _vectors(spark, sf_dir).select("id", F.round(vx.cosine01(F.col("embedding"), v), 6).alias("score"))


@query("SELECT label, dim, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY label, dim")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = vx.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return centre.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(
    f"SELECT query_id, id, round(s, 6) AS score, r AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {_sql_cos('q.embedding', 'c.embedding')} AS s,"
    f" row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sql_cos('q.embedding', 'c.embedding')} DESC, c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE r <= 5"
)
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    asked = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batch_topk(asked, corpus, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT id, session_id, importance FROM memories WHERE user_id = 'src3' AND NOT is_deleted AND created_at BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00' ORDER BY importance DESC, id LIMIT 10 OFFSET 3")
def scan_filtered_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.scope(memories(spark, sf_dir, vectors=False), user="src3", since=datetime(2024, 1, 1, 1), until=datetime(2024, 1, 1, 12))
    return store.ordered(rows, "importance_desc", skip=3, limit=10).select("id", "session_id", "importance")


@query("SELECT user_id, count(*) AS n FROM memories WHERE NOT is_deleted GROUP BY user_id")
def count_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_by_tenant(memories(spark, sf_dir, vectors=False))


@query("SELECT o AS ordinal, m.id, m.user_id FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 100), (4, -1)) a(o, i) JOIN memories m ON m.id = a.i")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.multi_get(_texts(spark, sf_dir), [7, 3, 7, 100, -1]).select(F.col("ordinal").cast("int").alias("ordinal"), "id", "user_id")


@query("SELECT id, user_id, type, preview FROM (SELECT id, user_id, CASE type WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'fact' END AS type, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview FROM memories)")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import TYPES

    names = F.element_at(F.array(*map(F.lit, TYPES)), F.col("type") + 1)
    return _texts(spark, sf_dir).select("id", "user_id", names.alias("type"), tx.preview(F.col("content")).alias("preview"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import latest

    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(f"SELECT id, is_deleted OR id % 7 = 0 AS is_deleted, CASE WHEN id % 7 = 0 THEN {AS_OF} ELSE created_at END AS updated_at FROM memories")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir, vectors=False).withColumn("updated_at", F.col("created_at"))
    return store.soft_delete(rows, F.col("id") % 7 == 0, F.expr(AS_OF)).select("id", "is_deleted", "updated_at")


@query("SELECT user_id, count(*) AS n, sum(id)::BIGINT AS ids FROM memories WHERE id % 7 <> 0 GROUP BY user_id")
def hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    left = store.hard_delete(rows, rows.filter("id % 7 = 0").select("id"))
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT user_id, sum(CASE WHEN id % 5 = 0 THEN 100 ELSE access_count END)::BIGINT AS accesses, count(*) AS n FROM memories GROUP BY user_id")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    changed = rows.filter("id % 5 = 0").withColumn("access_count", F.lit(100))
    return store.replace_rows(rows, changed).groupBy("user_id").agg(F.sum("access_count").alias("accesses"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, user_id FROM memories WHERE id % 3 = 0")
def migrate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return store.missing_rows(rows, rows.filter("id % 3 <> 0")).select("id", "user_id")


@query("SELECT user_id, count(*) AS n_source, count(*) FILTER (WHERE id % 3 <> 0) AS n_destination, count(*) FILTER (WHERE id % 3 <> 0) >= count(*) AS complete FROM memories GROUP BY user_id")
def migrate_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return store.migration_counts(rows, rows.filter("id % 3 <> 0"))


_RECENCY = f"greatest(0, least(1, pow(0.99::DOUBLE, (epoch_us({AS_OF}) - epoch_us(created_at)) / 3.6e9)))"
_FREQUENCY = "greatest(0, least(1, ln(1 + access_count) / ln(101)))"


@query(f"SELECT id, round({_RECENCY}, 6) AS recency, round({_FREQUENCY}, 6) AS frequency FROM memories")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = scoring.recency(F.lit(None).cast("timestamp"), F.col("created_at"), F.expr(AS_OF))
    return _texts(spark, sf_dir).select("id", F.round(recent, 6).alias("recency"), F.round(scoring.frequency(F.col("access_count")), 6).alias("frequency"))


@query(
    f"SELECT id, round(s, 6) AS score FROM (SELECT id, {_RECENCY} + importance + coalesce(({_sql_cos('embedding', _Q0)} + 1) / 2, 0.5) + 0.1 * {_FREQUENCY} AS s FROM memories WHERE NOT is_deleted) ORDER BY s DESC, id LIMIT 20"
)
def score_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vx.literal(_vector(spark, sf_dir))
    relevance = F.when(F.col("embedding").isNotNull(), vx.cosine01(F.col("embedding"), v))
    recent = scoring.recency(F.lit(None).cast("timestamp"), F.col("created_at"), F.expr(AS_OF))
    score = scoring.combined(recent, F.col("importance"), relevance, scoring.frequency(F.col("access_count")))
    rows = store.scope(memories(spark, sf_dir)).withColumn("score", score)
    return search.top(rows.select("id", "score"), 20).select("id", F.round("score", 6).alias("score"))


@query(
    f"SELECT id, round((c + 1 + importance + (c + 1) / 2 + 0.1 * least(1, ln(2 + access_count) / ln(101))) / 2, 6) AS score FROM (SELECT *, {_sql_cos('embedding', _Q0)} AS c FROM memories"
    " WHERE NOT is_deleted AND embedding IS NOT NULL) ORDER BY (c + 1 + importance + (c + 1) / 2 + 0.1 * least(1, ln(2 + access_count) / ln(101))) / 2 DESC, id LIMIT 10"
)
def recall_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vx.literal(_vector(spark, sf_dir))
    rows = store.scope(memories(spark, sf_dir)).filter("embedding IS NOT NULL")
    blend = scoring.combined(F.lit(1.0), F.col("importance"), vx.cosine01(F.col("embedding"), v), scoring.frequency(F.col("access_count") + 1))
    scored = rows.select("id", ((vx.cosine(F.col("embedding"), v) + blend) / 2).alias("score"))
    return search.top(scored, 10).select("id", F.round("score", 6).alias("score"))


def _sql_hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(content), '{w}')::INT" for w in words) + ")"


def _sql_clean(pattern: str) -> str:
    return pattern.replace("'", "''")


_IMPORTANCE = {
    "keywords": f"greatest(-0.2, least(0.3, 0.15 * {_sql_hits(scoring.HIGH_WORDS)} + 0.05 * {_sql_hits(scoring.MEDIUM_WORDS)} - 0.02 * {_sql_hits(scoring.LOW_WORDS)}))",
    "structure": "(CASE WHEN w > 100 THEN 0.10 WHEN w >= 10 THEN 0.05 ELSE 0 END + CASE WHEN contains(content, '?') THEN 0.05 ELSE 0 END + CASE WHEN contains(content, '!') THEN 0.03 ELSE 0 END"
    f" + CASE WHEN regexp_matches(content, '{scoring.BULLET}') THEN 0.1 ELSE 0 END)",
    "kind": "(CASE type WHEN 2 THEN 0.15 WHEN 3 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0 END)",
}
_IN_WORDS = "regexp_split_to_array(content, '[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+')"
_WORDED = (
    "(SELECT *, len(list_filter(string_split(content, ' '), lambda x: x <> '')) AS w,"
    f" len(list_filter({_IN_WORDS}, lambda x: regexp_matches(x, '^[A-Z][a-z]+$'))) AS names, len(list_filter({_IN_WORDS}, lambda x: regexp_matches(x, '^[0-9]+$'))) AS numbers FROM memories)"
)


@query(f"SELECT id, {', '.join(f'round(({x})::DOUBLE, 6) AS {k}' for k, x in _IMPORTANCE.items())} FROM {_WORDED}")
def importance_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scoring.importance_parts(F.col("content"), F.col("type"))
    return _texts(spark, sf_dir).select("id", *(F.round(parts[k], 6).alias(k) for k in _IMPORTANCE))


_SPECIFIC = (
    f"least(0.1, 0.03 * numbers) + CASE WHEN regexp_matches(content, '{scoring.DATE}') THEN 0.1 ELSE 0 END"
    f" + CASE WHEN regexp_matches(content, '{scoring.TIME}') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(content, '{scoring.CURRENCY}') THEN 0.1 ELSE 0 END"
)
_NAMED = (
    "CASE WHEN names > 2 THEN least(0.1, 0.02 * names) ELSE 0 END"
    f" + CASE WHEN regexp_matches(content, '{scoring.EMAIL}') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '{scoring.URL}') THEN 0.05 ELSE 0 END"
)
_TOTAL = f"greatest(0.1, least(1, 0.5 + {' + '.join(_IMPORTANCE.values())} + {_SPECIFIC} + {_NAMED}))"


@query(f"SELECT id, round(({_TOTAL})::DOUBLE, 6) AS importance, CASE WHEN round(({_TOTAL})::DOUBLE, 6) >= 0.8 THEN 'critical' WHEN round(({_TOTAL})::DOUBLE, 6) >= 0.6 THEN 'high' WHEN round(({_TOTAL})::DOUBLE, 6) >= 0.4 THEN 'medium' WHEN round(({_TOTAL})::DOUBLE, 6) >= 0.2 THEN 'low' ELSE 'minimal' END AS label FROM {_WORDED}")
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(scoring.importance(F.col("content"), F.col("type")), 6)
    rows = _texts(spark, sf_dir).select("id", score.alias("importance"))
    return rows.withColumn("label", scoring.importance_label(F.col("importance")))


_TERMS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+'), lambda x: length(x) >= 2)"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest({_TERMS}) AS term FROM memories) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.doc_terms(_texts(spark, sf_dir))
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


_ASKED = "the of thation and"


def _sql_bm25(terms: list[str], table_sql: str = "memories") -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{x}')) AS t{k}" for k, x in enumerate(terms))
    frequencies = ", ".join(f"count(*) FILTER (WHERE t{k} > 0) AS df{k}" for k in range(len(terms)))
    parts = " + ".join(f"ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * t{k} * 2.5::DOUBLE / (t{k} + 1.5 * (0.25 + 0.75 * dl / mean))" for k in range(len(terms)))
    present = " + ".join(f"(t{k} > 0)::INT" for k in range(len(terms)))
    return (
        f"counted AS (SELECT id, len(t) AS dl, {counts} FROM (SELECT id, {_TERMS} AS t FROM {table_sql})),"
        f" stats AS (SELECT count(*) AS n, avg(dl)::DOUBLE AS mean, {frequencies} FROM counted),"
        f" bm25 AS (SELECT id, {parts} AS score, {present} AS present FROM counted, stats WHERE {present} > 0)"
    )


def _with(body: str, terms: list[str], more: str = "") -> str:
    return f"WITH {MEMORIES_SQL}, {_sql_bm25(terms)}{more} {body}"


@query()
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).best(_ASKED, 10).select("id", F.round("score", 6).alias("score"))


@query()
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index."""
    return search.top(search.bm25(_texts(spark, sf_dir), _ASKED), 10).select("id", F.round("score", 6).alias("score"))


ORACLE_SQL["bm25_scan"] = ORACLE_SQL["bm25_topk"] = _with("SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 10", _ASKED.split())


@query()
def fts_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fts_search(_texts(spark, sf_dir), "the tion and", 10).select("id", F.round("score", 6).alias("score"), F.round("fts_score", 6).alias("fts_score"))


ORACLE_SQL["fts_all_terms"] = _with("SELECT id, round(score, 6) AS score, round(1 / (1 + abs(score)), 6) AS fts_score FROM bm25 WHERE present = 3 ORDER BY score DESC, id LIMIT 10", ["the", "tion", "and"])


@query("SELECT id, score::DOUBLE AS score FROM (SELECT id, contains(lower(content), 'ati')::INT + contains(lower(content), 'tio')::INT + contains(lower(content), 'ion')::INT + contains(lower(content), 'ont')::INT AS score FROM memories) WHERE score > 0 ORDER BY score DESC, id LIMIT 25")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trigram_search(_texts(spark, sf_dir), "ationt", 25)


_FUSED = (
    f", dense AS (SELECT id, {_sql_cos('embedding', _Q0)} AS score FROM memories WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 30),"
    " sparse AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 30),"
    " d AS (SELECT id, score AS dense_score, 0.6::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM dense),"
    " s AS (SELECT id, score AS sparse_score, 0.4::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM sparse)"
)


@query()
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid_search(memories(spark, sf_dir, tombstones=False), _ASKED, _vector(spark, sf_dir), 10, index=_index(spark, sf_dir), whole=True)
    return found.select("id", F.round("score", 6).alias("score"), "kind")


ORACLE_SQL["rrf_hybrid"] = _with(
    "SELECT coalesce(d.id, s.id) AS id, round(coalesce(d.p, 0) + coalesce(s.p, 0), 6) AS score,"
    " CASE WHEN coalesce(dense_score, 0) > 0 AND coalesce(sparse_score, 0) > 0 THEN 'hybrid' WHEN coalesce(dense_score, 0) > 0 THEN 'dense' ELSE 'sparse' END AS kind"
    " FROM d FULL OUTER JOIN s ON d.id = s.id ORDER BY coalesce(d.p, 0) + coalesce(s.p, 0) DESC, coalesce(d.id, s.id) LIMIT 10",
    _ASKED.split(), _FUSED,
)


@query(
    f"SELECT id, round(max(s), 6) AS score FROM (SELECT c.vec_id AS id, {_sql_cos('q.embedding', 'c.embedding')} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sql_cos('q.embedding', 'c.embedding')} DESC, c.vec_id) AS r"
    " FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE r <= 10 GROUP BY id ORDER BY max(s) DESC, id LIMIT 15"
)
def multi_query_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    asked = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.max_over_queries(search.batch_topk(asked, corpus, 10), 15).select("id", F.round("score", 6).alias("score"))


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    asked = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = search.batch_topk(asked, corpus, 20).join(corpus.select("id", F.col("embedding").alias("vector")), "id")
    return search.mmr(hits.select("query_id", "id", "score", "vector"), 5)


@query("SELECT id, sha256(content) AS hash FROM memories")
def hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", tx.content_hash(F.col("content")).alias("hash"))


_NORMALIZED = "upper(sha256(regexp_replace(regexp_replace(lower(content), '^\\s+|\\s+$', '', 'g'), '\\r\\n|\\r', chr(10), 'g')))"


@query(f"SELECT hash, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_NORMALIZED} AS hash FROM memories) GROUP BY hash HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_texts(spark, sf_dir))


_PAIRS = f"SELECT a.user_id AS tenant, a.id AS a, b.id AS b, {_sql_cos('a.embedding', 'b.embedding')} AS s FROM memories a JOIN memories b ON a.user_id = b.user_id AND a.id < b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL"


@query(f"SELECT tenant, a, b, round(s, 6) AS score FROM ({_PAIRS}) WHERE s >= 0.3")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(memories(spark, sf_dir), 0.3).select("tenant", "a", "b", F.round("score", 6).alias("score"))


def _with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories, and a copy of each whose components are moved a little, by its id."""
    rows = memories(spark, sf_dir, tombstones=False).filter("embedding IS NOT NULL").select("id", "user_id", "embedding")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + 0.05 * F.sin((F.col("id") + 1) * (i + 1)))
    return rows.unionByName(rows.select((F.col("id") + 1_000_000_000).alias("id"), "user_id", moved.cast("array<float>").alias("embedding")))


@query()
def near_dup_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at 0.8 by hashed directions; the tests compare them with those of all pairs."""
    return dedup.near_pairs_hashed(_with_copies(spark, sf_dir), 0.8).select("tenant", "a", "b", F.round("score", 6).alias("score"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_topk`` through a vector index; the tests measure its recall."""
    corpus = _vectors(spark, sf_dir)
    index = vector_index.VectorIndex(spark, _folder(spark, "vectors"))
    index.build(corpus, k=5)
    asked = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.search(asked, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# the later row of a pair is the new one; its score counts thrice, as few pairs of the tables are that alike
_ACTION = "CASE WHEN least(1, 3 * p.s) >= 0.95 THEN CASE WHEN length(n.content) > 1.2 * length(o.content) THEN 'update' ELSE 'skip' END WHEN least(1, 3 * p.s) >= 0.85 THEN 'merge' ELSE 'add_with_relation' END"


@query(f"SELECT tenant, {_ACTION} AS action, count(*) AS n FROM ({_PAIRS}) p JOIN memories o ON o.id = p.a JOIN memories n ON n.id = p.b WHERE p.s >= 0.25 GROUP BY 1, 2")
def dup_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.near_pairs(memories(spark, sf_dir), 0.25)
    length = lambda key, name: _texts(spark, sf_dir).select(F.col("id").alias(key), F.char_length("content").alias(name))
    both = pairs.join(length("a", "old"), "a").join(length("b", "new"), "b")
    score = F.least(F.lit(1.0), 3 * F.col("score"))
    return both.groupBy("tenant", dedup.action(score, F.col("old"), F.col("new")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query()
def dup_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    members = rows.filter("embedding IS NOT NULL").select(F.col("user_id").alias("tenant"), "id", "created_at")
    return dedup.leader_clusters(dedup.near_pairs(rows, 0.3), members)


@query(
    "SELECT hash, first(id ORDER BY created_at, importance DESC, id) AS primary_id, count(*) AS n, sum(access_count)::BIGINT AS access_count, max(importance) AS importance FROM (SELECT *, sha256(content) AS hash FROM memories) GROUP BY hash"
)
def dup_merge_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merge_groups(_texts(spark, sf_dir).withColumn("hash", tx.content_hash(F.col("content"))), "hash")


_BY_STRATEGY = {"oldest": "created_at, importance DESC, id", "newest": "created_at DESC, importance DESC, id", "most_accessed": "access_count DESC, importance DESC, id", "most_important": "importance DESC, id"}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, hash, first(id ORDER BY {order}) AS primary_id, count(*) AS n, sum(access_count)::BIGINT AS access_count, max(importance) AS importance, array_to_string(list_sort(list(DISTINCT lang)), ',') AS topics FROM (SELECT *, sha256(left(content, 1)) AS hash FROM memories) GROUP BY hash"
        for name, order in _BY_STRATEGY.items()
    )
)
def dup_merge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts with the same first character, whose languages stand for topics."""
    rows = _texts(spark, sf_dir).withColumns({"hash": F.sha2(F.encode(F.substring("content", 1, 1), "utf-8"), 256), "topics": F.array("lang")})
    out = None
    for name in _BY_STRATEGY:
        merged = dedup.merge_groups(rows, "hash", name, "topics").select(F.lit(name).alias("strategy"), "hash", "primary_id", "n", "access_count", "importance", F.array_join("topics", ",").alias("topics"))
        out = merged if out is None else out.unionByName(merged)
    return out


_NEW = f"SELECT n.id, o.id AS o, {_sql_cos('n.embedding', 'o.embedding')} AS s, length(n.content) AS nl, length(o.content) AS ol FROM memories n JOIN memories o ON n.user_id = o.user_id AND n.id % 10 = 0 AND o.id % 10 <> 0 WHERE n.embedding IS NOT NULL AND o.embedding IS NOT NULL"


@query(
    f", hashed AS (SELECT id, user_id, {_NORMALIZED} AS hash FROM memories), exact AS (SELECT n.id, min(o.id) AS match_id FROM hashed n JOIN hashed o ON n.user_id = o.user_id AND n.hash = o.hash AND n.id % 10 = 0 AND o.id % 10 <> 0 GROUP BY n.id),"
    f" best AS (SELECT id, o AS match_id, s, nl, ol, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS r FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM exact)),"
    " semantic AS (SELECT id, match_id, s, CASE WHEN s >= 0.95 THEN CASE WHEN nl > 1.2 * ol THEN 'update' ELSE 'skip' END WHEN s >= 0.85 THEN 'merge' ELSE 'add_with_relation' END AS action FROM best WHERE r = 1 AND s >= 0.3)"
    " SELECT id, 'exact' AS kind, match_id, 1.0::DOUBLE AS score, 'skip' AS action FROM exact UNION ALL SELECT id, 'semantic', match_id, round(s, 6), action FROM semantic"
    " UNION ALL SELECT id, 'none', NULL, 0, 'add' FROM memories WHERE id % 10 = 0 AND id NOT IN (SELECT id FROM exact) AND id NOT IN (SELECT id FROM semantic)"
)
def dup_check_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row as a new one against the others."""
    rows = memories(spark, sf_dir, tombstones=False)
    found = dedup.check_new(rows.filter("id % 10 = 0"), rows.filter("id % 10 <> 0"), 0.3)
    return found.select("id", "kind", "match_id", F.round("score", 6).alias("score"), "action")


@query(f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS}) AS term FROM memories) GROUP BY 1, 2) GROUP BY term")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds, read back."""
    return _index(spark, sf_dir).terms().groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query()
def index_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the rows, to which the others are added and some again, and from which every seventh is removed."""
    rows = _texts(spark, sf_dir).select("id", "content")
    index = term_index.TermIndex(spark, _folder(spark, "index"))
    index.rebuild(rows.filter("id % 3 <> 0"))
    index.add(rows.filter("id % 3 = 0 OR id % 4 = 0"), 1)
    index.remove(rows.filter("id % 7 = 0"), 2)
    return index.best(_ASKED, 25).select("id", F.round("score", 6).alias("score"))


ORACLE_SQL["index_add_remove"] = f"WITH {MEMORIES_SQL}, {_sql_bm25(_ASKED.split(), '(SELECT * FROM memories WHERE id % 7 <> 0)')} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 25"


@query()
def term_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of all texts with their stems and rows."""
    found = _index(spark, sf_dir).terms().groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    return with_stems(found).select("term", "stem", "rows")


@query()
def stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by stems, whatever endings the words have, through an index of the stems of all texts."""
    index = term_index.TermIndex(spark, _folder(spark, "stems"))
    index.rebuild(stemmed_texts(_texts(spark, sf_dir)))
    asked = stemmed_texts(spark.createDataFrame([(0, "things in thanks andes")], "id long, content string")).first()["content"]
    return index.best(asked, 10).select("id", F.round("score", 6).alias("score"))


@query()
def hybrid_two_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the rows in each leg, and no dense hit below 0."""
    found = search.hybrid_search(memories(spark, sf_dir, tombstones=False), _ASKED, _vector(spark, sf_dir), 10, 2, _index(spark, sf_dir), 0.0, whole=True)
    return found.select("id", F.round("score", 6).alias("score"), "kind")


ORACLE_SQL["hybrid_two_legs"] = ORACLE_SQL["rrf_hybrid"].replace("LIMIT 30)", "LIMIT 20)").replace("AS score FROM dense)", "AS score FROM dense WHERE score >= 0)")


@query()
def hybrid_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused rows in the order of marginal relevance."""
    found = search.hybrid_search(memories(spark, sf_dir, tombstones=False), _ASKED, _vector(spark, sf_dir), 10, index=_index(spark, sf_dir))
    return search.mmr_fused(found, _vectors(spark, sf_dir).select("id", F.col("embedding").alias("vector")))


@query()
def related_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is most like memory 7, without itself."""
    return search.related(memories(spark, sf_dir, tombstones=False), 7, 5, _index(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "kind")


_Q7 = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
ORACLE_SQL["related_memories"] = (
    f"WITH {MEMORIES_SQL}, words AS (SELECT id, {_TERMS} AS t FROM memories), stats AS (SELECT count(*) AS n, avg(len(t))::DOUBLE AS mean FROM words),"
    " postings AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM words) GROUP BY id, dl, term),"
    " asked AS (SELECT DISTINCT term FROM postings WHERE id = 7), rarity AS (SELECT term, count(*) AS df FROM postings GROUP BY term),"
    " sparse AS (SELECT p.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM postings p JOIN asked USING (term) JOIN rarity USING (term), stats WHERE p.id <> 7 GROUP BY p.id ORDER BY score DESC, p.id LIMIT 15),"
    f" dense AS (SELECT id, {_sql_cos('embedding', _Q7)} AS score FROM memories WHERE embedding IS NOT NULL AND id <> 7 ORDER BY score DESC, id LIMIT 15),"
    " d AS (SELECT id, score AS dense_score, 0.6::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM dense),"
    " s AS (SELECT id, score AS sparse_score, 0.4::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM sparse)"
    " SELECT coalesce(d.id, s.id) AS id, round(coalesce(d.p, 0) + coalesce(s.p, 0), 6) AS score,"
    " CASE WHEN coalesce(dense_score, 0) > 0 AND coalesce(sparse_score, 0) > 0 THEN 'hybrid' WHEN coalesce(dense_score, 0) > 0 THEN 'dense' ELSE 'sparse' END AS kind"
    " FROM d FULL OUTER JOIN s ON d.id = s.id ORDER BY coalesce(d.p, 0) + coalesce(s.p, 0) DESC, coalesce(d.id, s.id) LIMIT 5"
)


@query(f"SELECT id, round(s, 3) AS score FROM (SELECT id, created_at, round({_sql_cos('embedding', _Q0)}, 1) AS s FROM memories WHERE embedding IS NOT NULL) ORDER BY s DESC, created_at DESC, id LIMIT 20")
def dense_ties_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one decimal, which tie, newest first."""
    score = F.round(vx.cosine(F.col("embedding"), vx.literal(_vector(spark, sf_dir))), 1)
    return search.dense_topk(memories(spark, sf_dir, tombstones=False), [], 20, score=score, ties=search.newest_first()).select("id", F.round("score", 3).alias("score"))


_ORDERS = {"created_desc": "created_at DESC", "created_asc": "created_at", "updated_desc": "updated_at DESC", "updated_asc": "updated_at", "importance_desc": "importance DESC", "access_desc": "access_count DESC"}


@query(
    " UNION ALL ".join(
        f"(SELECT '{k}' AS ordering, id, row_number() OVER (ORDER BY {o}, id) AS place FROM (SELECT *, created_at + INTERVAL (id % 3) HOUR AS updated_at FROM memories WHERE session_id IN ('s0', 's1') AND NOT is_deleted) ORDER BY {o}, id LIMIT 12)"
        for k, o in _ORDERS.items()
    )
)
def scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six orders over two sessions."""
    from pyspark.sql import Window

    rows = store.scope(memories(spark, sf_dir, vectors=False)).filter(F.col("session_id").isin("s0", "s1"))
    rows = rows.withColumn("updated_at", F.col("created_at") + F.make_dt_interval(hours=(F.col("id") % 3).cast("int")))
    out = None
    for k in _ORDERS:
        page = store.ordered(rows, k, limit=12)
        column = store._ORDER_COLUMNS[k.split("_")[0]]
        page = page.select(F.lit(k).alias("ordering"), "id", F.row_number().over(Window.orderBy(store.ORDERS[k](column), F.asc("id"))).cast("long").alias("place"))  # of twelve rows
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT id, user_id, session_id FROM memories WHERE session_id = 's1' AND NOT is_deleted AND type IN (1, 2) ORDER BY created_at DESC, id LIMIT 15")
def scan_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan_newest(memories(spark, sf_dir, vectors=False), session="s1", types=[1, 2], limit=15).select("id", "user_id", "session_id")


@query("SELECT id, user_id, type FROM memories WHERE NOT is_deleted AND type = 3 ORDER BY id LIMIT 10000")
def scan_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scroll(memories(spark, sf_dir, vectors=False), types=[3]).select("id", "user_id", "type")


_TABLE_COLUMNS = ("id", "user_id", "session_id", "content", "created_at", "importance", "access_count", "type", "is_deleted")


def _memory_table(spark: SparkSession, sf_dir: str) -> store.MemoryTable:
    """A table of all memories, a fifth of which were then updated, some put to rest and some removed."""
    table_of = store.MemoryTable(spark, _folder(spark, "memories"))
    rows = memories(spark, sf_dir, vectors=False).select(*_TABLE_COLUMNS, F.col("created_at").alias("updated_at"), F.lit(False).alias("removed"))
    table_of.append(rows, 1)
    table_of.update(rows.filter("id % 5 = 0").withColumn("access_count", F.lit(100)), datetime(2024, 3, 1), 2)
    table_of.delete(rows.filter("id % 7 = 0").select("id"), datetime(2024, 3, 2), 3)
    table_of.delete(rows.filter("id % 11 = 0").select("id"), datetime(2024, 3, 3), 4, hard=True)
    return table_of


_TABLE = "(SELECT id, user_id, content, CASE WHEN id % 5 = 0 THEN 100 ELSE access_count END AS access_count, is_deleted OR id % 7 = 0 AS is_deleted, CASE WHEN id % 7 = 0 THEN TIMESTAMP '2024-03-02' WHEN id % 5 = 0 THEN TIMESTAMP '2024-03-01' ELSE created_at END AS updated_at FROM memories WHERE id % 11 <> 0)"


@query(f"SELECT id, user_id, length(content) AS n, access_count, is_deleted, updated_at FROM {_TABLE}")
def memory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends, updates, soft and hard deletes, read back."""
    return _memory_table(spark, sf_dir).read().select("id", "user_id", F.char_length("content").cast("long").alias("n"), "access_count", "is_deleted", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(f"SELECT id, access_count, is_deleted FROM {_TABLE} WHERE id = 35")
def memory_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key, a tombstone, by its own versions."""
    return _memory_table(spark, sf_dir).get(35).select("id", "access_count", "is_deleted")


@query(f"SELECT t.user_id, any_value(s.n) AS versions, count(*) AS rows, count(*) FILTER (WHERE NOT is_deleted) AS live FROM {_TABLE} t JOIN (SELECT user_id, sum(1 + (id % 5 = 0)::INT + (id % 7 = 0)::INT + (id % 11 = 0)::INT)::BIGINT AS n FROM memories GROUP BY user_id) s ON s.user_id = t.user_id GROUP BY t.user_id")
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory_table(spark, sf_dir).statistics()


_MOVED = "(SELECT id, CASE WHEN id % 10 = 0 THEN 'moved' WHEN id % 15 = 0 THEN 'src2' ELSE user_id END AS user_id, is_deleted OR id % 20 = 0 AS is_deleted FROM memories WHERE id % 30 <> 0)"


@query(f"SELECT t.reader, m.id, m.user_id, m.is_deleted FROM {_MOVED} m JOIN (VALUES ('src1'), ('src2'), ('moved')) t(reader) ON t.reader = m.user_id")
def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three tenants read after every tenth memory, and some more, moved to another of them, and some that moved were deleted, softly or for good."""
    table_of = store.MemoryTable(spark, _folder(spark, "tenants"))
    rows = memories(spark, sf_dir, vectors=False).select(*_TABLE_COLUMNS, F.col("created_at").alias("updated_at"))
    table_of.append(rows, 1)
    table_of.update(rows.filter("id % 15 = 0").withColumn("user_id", F.lit("src2")), datetime(2024, 3, 1), 2)
    table_of.update(rows.filter("id % 10 = 0").withColumn("user_id", F.lit("moved")), datetime(2024, 3, 2), 3)
    table_of.delete(rows.filter("id % 20 = 0").select("id"), datetime(2024, 3, 3), 4)
    table_of.delete(rows.filter("id % 30 = 0").select("id"), datetime(2024, 3, 4), 5, hard=True)
    read = None
    for tenant in ("src1", "src2", "moved"):
        own = table_of.read(tenant).select(F.lit(tenant).alias("reader"), "id", "user_id", "is_deleted")
        read = own if read is None else read.unionByName(own)
    return read


@query("SELECT 'healthy' AS status, count(*) FILTER (WHERE id % 11 <> 0) AS rows, true AS sound FROM memories UNION ALL SELECT 'unavailable', 0, false")
def table_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table, and one that is not there."""
    both = _memory_table(spark, sf_dir).health().unionByName(store.MemoryTable(spark, _folder(spark, "missing")).health())
    return both.select("status", "rows", F.col("error").isNull().alias("sound"))


@query("SELECT user_id AS tenant, count(*) FILTER (WHERE id % 3 = 0) AS migrated, count(*) FILTER (WHERE id % 3 <> 0) AS skipped, 'completed' AS status FROM memories WHERE user_id IN ('src1', 'src2', 'src3') GROUP BY user_id UNION ALL SELECT NULL, 0, 0, 'skipped'")
def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tenants, whose third rows the destination lacks, and a migration that names no tenant."""
    rows = memories(spark, sf_dir, vectors=False).select(*_TABLE_COLUMNS)
    destination = store.MemoryTable(spark, _folder(spark, "destination"))
    destination.append(rows.filter("id % 3 <> 0"), 1)
    report = store.migrate(rows, destination, ["src1", "src2", "src3"], 2).unionByName(store.migrate(rows, destination, [], 3))
    return report.select("tenant", "migrated", "skipped", "status")


@query(
    "SELECT m.id, access_count + coalesce(n, 0) AS access_count, seen AS last_accessed_at FROM memories m LEFT JOIN (SELECT id, count(*)::INT AS n, max(t) AS seen FROM"
    " (SELECT id, TIMESTAMP '2024-02-01' AS t FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, TIMESTAMP '2024-02-02' FROM memories WHERE id % 6 = 0) GROUP BY id) a ON a.id = m.id"
)
def access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses that recalls logged, folded into the rows."""
    rows = _texts(spark, sf_dir)
    log = scoring.access_events(rows.filter("id % 2 = 0"), F.lit(datetime(2024, 2, 1))).unionByName(scoring.access_events(rows.filter("id % 6 = 0"), F.lit(datetime(2024, 2, 2))))
    return scoring.with_access(rows, log).select("id", "access_count", F.col("last_accessed_at").cast("timestamp_ntz").alias("last_accessed_at"))


_INDICATORS = " + ".join(f"contains(lower(text), '{w}')::INT" for w in scoring.WORKING_WORDS)


@query(
    f"SELECT conv_id, turn, round(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE least(5, 0.5 + least(len(regexp_extract_all(text, '[^ \n]+')) / 100, 2) + 0.5 * ({_INDICATORS}) + 0.3 * contains(text, '?')::INT"
    " + 0.5 * (contains(text, '```') OR contains(text, 'function') OR contains(text, 'class'))::INT) END::DOUBLE, 6) AS importance FROM conversations"
)
def message_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(scoring.working_importance(F.col("text")), 6).alias("importance"))


@query("SELECT id, round(greatest(0, least(1, (id % 17) / 10.0 - 0.3))::DOUBLE, 6) AS importance FROM memories")
def importance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.round(scoring.manual_importance((F.col("id") % 17) / 10 - 0.3), 6).alias("importance"))


@query("SELECT user_id, count(*) AS n FROM memories WHERE NOT is_deleted AND created_at >= TIMESTAMP '2024-02-01' - INTERVAL 1 DAY * (CASE user_id WHEN 'src1' THEN 31 WHEN 'src2' THEN 100 ELSE 365 END) AND (user_id <> 'src3' OR type IN (0, 2)) GROUP BY user_id HAVING count(*) > 5")
def tenant_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention, allowed types and quota of tenants."""
    rows = store.within_retention(memories(spark, sf_dir, vectors=False), {"src1": 31, "src2": 100}, datetime(2024, 2, 1))
    return store.over_quota(store.allowed_types(rows, {"src3": [0, 2]}), 5)
