"""Entities of texts and the graph between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx

# Patterns of entities: kind, pattern, confidence.
PATTERNS = (
    ("email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", 1.0),
    ("url", "https?://[^\\s<>\"]+", 1.0),
    ("datetime", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 1.0),
    ("datetime", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", 0.9),
    ("datetime", "[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\\s*[AP]M)?", 0.9),
    ("numeric", "\\$[0-9,]+(?:\\.[0-9]{2})?|[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]{2})?\\s*(?:USD|EUR|GBP)", 1.0),
    ("numeric", "[0-9]+(?:\\.[0-9]+)?%", 1.0),
)
CAPITALIZED = "(?:[A-Z][a-z]+\\s*)+"
#: The same without steps back, which the JVM would take by recursion, word for word.
CAPITALIZED_RUN = "(?:[A-Z][a-z]++\\s*+)++"
# Words that class capitalized runs, and technical terms.
ORGANIZATION_WORDS = ("inc", "corp", "ltd", "llc", "co", "company", "corporation", "foundation", "association", "institute", "university", "college")
PERSON_WORDS = ("mr", "mrs", "ms", "dr", "prof", "ceo", "cto", "cfo", "manager", "director")
LOCATION_WORDS = ("city", "state", "country", "street", "avenue", "road")
TECHNICAL_TERMS = (
    "API", "SDK", "CLI", "GUI", "URL", "HTTP", "HTTPS", "SQL", "JSON", "XML", "HTML", "CSS", "JavaScript", "Python", "Java", "C#", "NET",
    "Docker", "Kubernetes", "AWS", "Azure", "GCP", "database", "server", "algorithm", "framework", "library", "package", "module", "class",
    "function", "method", "interface", "protocol", "encryption",
)
# Phrases of relations.
RELATIONS = (
    ("works at|employed by|works for", "WORKS_AT"),
    ("located in|based in|located at", "LOCATED_IN"),
    ("part of|belongs to|member of", "PART_OF"),
    ("created by|developed by|built by|made by", "CREATED_BY"),
    ("manages|leads|heads|supervises", "MANAGES"),
    ("reports to|works under", "REPORTS_TO"),
    ("uses|utilizes|employs", "USES"),
    ("related to|connected to|associated with", "RELATED_TO"),
    ("scheduled for|planned for|set for", "SCHEDULED_FOR"),
    ("sent to|emailed to|messaged", "SENT_TO"),
)
ENTITY = "array<struct<name:string,kind:string,confidence:double>>"


def _entity(name: Column, kind: Column, confidence: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"), confidence.cast("double").alias("confidence"))


def _found(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(tx.searched(pattern)), F.lit(0)), lambda m: _entity(m, F.lit(kind), F.lit(confidence)))


def named_kind(name: Column) -> Column:
    """organization by a word of it, person by a title first, location by its last word, person for two words, else unknown."""
    words = F.split(F.lower(name), "\\s+")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    organization = F.arrays_overlap(words, F.array(*map(F.lit, ORGANIZATION_WORDS)))
    return (
        F.when(organization, "organization")
        .when((F.size(words) > 1) & first.isin(*PERSON_WORDS), "person")
        .when(last.isin(*LOCATION_WORDS), "location")
        .when((F.size(words) == 2) & (F.char_length(first) > 1) & (F.char_length(last) > 1), "person")
        .otherwise("unknown")
    )


#: What a text must hold for a pattern to be worth a search.
_NEEDS = ("@", "http", "-", "/", ":", None, "%")


def entity_array(text: Column) -> Column:
    """The entities of a text in order of their extractors: patterns, capitalized runs, technical terms."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(ENTITY)
    parts = []
    for rule, need in zip(PATTERNS, _NEEDS):
        found = _found(text, *rule).cast(ENTITY)
        parts.append(found if need is None else F.when(F.contains(text, F.lit(need)), found).otherwise(none))
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(CAPITALIZED_RUN), F.lit(0)), tx.stripped), lambda m: F.char_length(m) >= 2)
    parts.append(F.transform(runs, lambda m: vx.let(named_kind(m), lambda k: _entity(m, k, F.when(k == "unknown", F.lit(0.5)).otherwise(F.lit(0.8))))))
    lower = F.lower(text)
    terms = F.filter(F.array(*(F.when(F.contains(lower, F.lit(t.lower())), F.lit(t)) for t in TECHNICAL_TERMS)), lambda t: t.isNotNull())
    parts.append(F.transform(terms, lambda t: _entity(t, F.lit("technical"), F.lit(0.9))))
    return F.concat(*(p.cast(ENTITY) for p in parts))


def mentions(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """doc, ordinal, key, name, kind, confidence of every mention."""
    found = df.select(F.col(id_col).alias("doc"), F.posexplode(entity_array(F.col(text_col))).alias("ordinal", "e"))
    return found.select("doc", "ordinal", F.lower("e.name").alias("key"), "e.*")


def distinct_entities(entities: Column) -> Column:
    """array<struct<key, ordinal, mentions, name, kind, confidence>>: each entity once in any case, the first mention's, with its number of mentions.

    Mentions are sorted within the row; a key's first is the one that follows another key.
    """
    keyed = F.sort_array(F.transform(entities, lambda e, i: F.struct(F.lower(e["name"]).alias("key"), i.alias("ordinal"), e["name"].alias("name"), e["kind"].alias("kind"), e["confidence"].alias("confidence"))))

    def with_sorted(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda x: x["key"]))
        starts = F.filter(F.transform(s, lambda x, i: F.when(~x["key"].eqNullSafe(F.get(before, i)), i)), lambda i: i.isNotNull())

        def with_starts(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(s)))
            one = lambda i, j: F.struct(F.get(s, i)["key"].alias("key"), F.get(s, i)["ordinal"].alias("ordinal"), (j - i).cast("long").alias("mentions"), F.get(s, i)["name"].alias("name"), F.get(s, i)["kind"].alias("kind"), F.get(s, i)["confidence"].alias("confidence"))
            return F.when(F.size(at) > 0, F.zip_with(at, ends, one))

        return vx.let(starts, with_starts)

    return vx.let(keyed, with_sorted)


def document_entities(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """doc, key, ordinal, mentions, name, kind, confidence: each document's entities once; a projection, without a shuffle."""
    return df.select(F.col(id_col).alias("doc"), F.explode(distinct_entities(entity_array(F.col(text_col)))).alias("e")).select("doc", "e.*")


def nodes(entities: DataFrame) -> DataFrame:
    """key, name, kind, documents of the graph: one for each document that holds the entity."""
    first = F.min_by(F.struct("name", "kind"), F.struct("doc", "ordinal"))
    return entities.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), first.alias("e")).select("key", "e.*", "documents")


def edges(df: DataFrame, entities: DataFrame, id_col: str = "id", text_col: str = "content", block: int = 50) -> DataFrame:
    """source, target, weight: documents with a sentence that holds both entities, source < target."""
    pairs = sentence_pairs(df, entities, id_col, text_col, block)
    return pairs.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


def sentence_pairs(df: DataFrame, entities: DataFrame, id_col: str = "id", text_col: str = "content", block: int = 50) -> DataFrame:
    """doc, source, target: pairs of a document's entities that a sentence holds, in the order of the document's entities, each once.

    Entities are matched in the sentences of their own document as a nested expression, so
    sentences aren't joined with entities. A sentence's entities are cut into blocks in order,
    and every two blocks, and each with itself, are a row; where there are several, they are
    dealt by hash. No row makes over ``block`` squared pairs, and no task has all pairs of a long
    sentence.
    """
    own = entities.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "key"))).alias("_keys"))
    units = df.select(F.col(id_col).alias("doc"), F.posexplode(tx.sentences(F.lower(F.col(text_col)), newlines=False)).alias("unit", "s")).join(own, F.col("doc") == F.col("_doc"))
    held = F.filter("_keys", lambda e: F.contains(F.col("s"), e["key"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("held") - 1) / block).cast("int")), lambda i: F.slice("held", i * block + 1, F.lit(block)))
    rows = units.select("doc", "unit", held.alias("held")).filter(F.size("held") > 1).select("doc", "unit", blocks.alias("blocks"))
    pair = lambda a, b: F.struct(a["key"].alias("source"), b["key"].alias("target"))
    within = lambda x: F.flatten(F.transform(x, lambda a, k: F.transform(F.slice(x, k + 2, F.lit(block)), lambda b: pair(a, b))))
    short = rows.filter(F.size("blocks") == 1).select("doc", F.explode(within(F.get("blocks", F.lit(0)))).alias("p"))
    long = rows.filter(F.size("blocks") > 1).select("doc", "unit", "blocks", F.posexplode("blocks").alias("i", "left"))
    long = long.select("doc", "unit", "i", "left", F.posexplode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("j", "right")).repartition("doc", "unit", "i", "j")
    # block i with itself where j is 0
    across = F.when(F.col("j") == 0, within(F.col("left"))).otherwise(F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: pair(a, b)))))
    return short.unionByName(long.select("doc", F.explode(across).alias("p"))).select("doc", "p.*").distinct()


def phrase_relations(df: DataFrame, id_col: str = "id", text_col: str = "content", reach: int = 100) -> DataFrame:
    """doc, relation, place, source, target: for each phrase of a relation, at its place in code points, the two entities of the document that lie nearest.

    Candidates are those that the text from ``reach`` before the phrase's start to ``reach``
    after it holds, in any case. Their distance is that of their first place in this window from
    ``reach`` / 2, ties by the order of the document's entities; the nearest is the source, the
    next the target. A projection without a shuffle: phrases meet the entities of their own text
    only. Null and empty texts, and texts with fewer than two entities, have no relations.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc"), text.alias("t")).filter(F.col("t").rlike("(?i)" + "|".join(p for p, _ in RELATIONS)))
    placed = lambda name: lambda m: F.struct(F.lit(name).alias("relation"), m["start"].alias("place"))
    found = [F.transform(tx.matches(F.col("t"), f"(?i)(?:{pattern})"), placed(name)) for pattern, name in RELATIONS]
    entities = F.transform(distinct_entities(entity_array(F.col("t"))), lambda e: F.struct(e["ordinal"].alias("ordinal"), e["key"].alias("key")))
    rows = rows.select("doc", "t", F.coalesce(entities, F.array().cast("array<struct<ordinal:int,key:string>>")).alias("entities"), F.concat(*found).alias("phrases"))

    def nearest(at: Column) -> Column:
        start = F.greatest(at - reach, F.lit(0))
        window = F.lower(F.substr(F.col("t"), start + 1, at + reach - start))
        ranked = lambda w: F.array_sort(F.transform(F.filter("entities", lambda e: F.contains(w, e["key"])), lambda e: F.struct(F.abs(F.call_function("locate", e["key"], w) - 1 - reach // 2).alias("away"), e["ordinal"].alias("ordinal"), e["key"].alias("key"))))
        return vx.let(window, lambda w: F.slice(ranked(w), 1, 2))

    near = F.transform("phrases", lambda p: F.struct(p["relation"].alias("relation"), p["place"].alias("place"), nearest(p["place"]).alias("near")))
    pairs = rows.select("doc", F.explode(F.filter(near, lambda p: F.size(p["near"]) == 2)).alias("p"))
    return pairs.select("doc", "p.relation", "p.place", F.get("p.near", F.lit(0))["key"].alias("source"), F.get("p.near", F.lit(1))["key"].alias("target"))


#: The relation of entities that a sentence holds both and no phrase relates.
TOGETHER = "MENTIONED_WITH"


def typed_edges(df: DataFrame, entities: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """source, target, relation, weight: relations of phrases, one for each phrase, and MENTIONED_WITH for each pair of a document that shares a sentence and that no phrase of the document relates in either direction."""
    phrases = phrase_relations(df, id_col, text_col)
    ends = (F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"))
    known = phrases.select("doc", *ends).distinct()
    linked = sentence_pairs(df, entities, id_col, text_col).select("*", *ends).join(known, ["doc", "low", "high"], "left_anti")
    every = phrases.select("source", "target", "relation").unionByName(linked.select("source", "target", F.lit(TOGETHER).alias("relation")))
    return every.groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("weight"))


def relation_counts(df: DataFrame, text_col: str = "content") -> DataFrame:
    """relation, documents, matches of the phrases of relations."""
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counted = df.select(*(F.regexp_count(lower, F.lit(p)).alias(name) for p, name in RELATIONS))
    sums = counted.agg(F.array(*(F.struct(F.lit(n).alias("relation"), F.count_if(F.col(n) > 0).alias("documents"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matches")) for _, n in RELATIONS)).alias("rows"))
    return sums.select(F.inline("rows"))


def query_graph(graph_nodes: DataFrame, graph_edges: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """key, score, hop: the k best nodes for the terms (1 for equal names, 0.5 for parts), and their neighbours."""
    score = sum((F.when(F.col("key") == t, F.lit(1.0)).when(F.contains(F.col("key"), F.lit(t)), F.lit(0.5)).otherwise(F.lit(0.0)) for t in (x.lower() for x in terms)), F.lit(0.0))
    hits = graph_nodes.select("key", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "key").limit(k)
    both = graph_edges.select("source", "target").unionByName(graph_edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = both.join(F.broadcast(hits.select(F.col("key").alias("source"))), "source").select(F.col("target").alias("key")).distinct().join(hits.select("key"), "key", "left_anti")
    return hits.withColumn("hop", F.lit(0)).unionByName(near.select("key", F.lit(0.0).alias("score"), F.lit(1).alias("hop")))


def graph_statistics(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """what, kind, n: entities by kind and edges by relation."""
    a = graph_nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("what"), "kind", "n")
    b = graph_edges.groupBy(F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("what"), "kind", "n")
    return a.unionByName(b)


def merge_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    every = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return every.groupBy("key").agg(F.sum("documents").alias("documents"), F.min_by(F.struct("name", "kind"), "_side").alias("e")).select("key", "e.*", "documents")


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of two graphs by source, target and, where they have one, relation."""
    return a.unionByName(b).groupBy(*(c for c in a.columns if c != "weight")).agg(F.sum("weight").alias("weight"))


def node_degrees(graph_edges: DataFrame) -> DataFrame:
    ends = graph_edges.select(F.explode(F.array("source", "target")).alias("key"), "weight")
    return ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def top_entities(graph_nodes: DataFrame, k: int = 10) -> DataFrame:
    return graph_nodes.orderBy(F.desc("documents"), "key").limit(k)


def rank_in_kind(graph_nodes: DataFrame) -> DataFrame:
    return graph_nodes.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("documents"), "key")))


class StoredGraph:
    """A typed graph under a folder, kept up by batches of documents: ``nodes`` and ``edges``, by batch.

    A batch adds its own sums under its number, and written again replaces them, so a job that
    is repeated counts nothing twice. Reading adds the batches up: that is the graph of all
    documents at once, as no pair or phrase spans two. ``compact`` writes the sums of all
    batches as the first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, batch: int, id_col: str = "id", text_col: str = "content") -> None:
        """The documents of one batch; each document belongs to one batch."""
        found = document_entities(df, id_col, text_col)
        first = F.min_by(F.struct("doc", "ordinal", "name", "kind"), F.struct("doc", "ordinal"))
        own = found.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), first.alias("first"))
        for name, rows in (("nodes", own), ("edges", typed_edges(df, found, id_col, text_col))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def nodes(self) -> DataFrame:
        """key, name, kind, documents; name and kind are those of the first mention in the least document."""
        each = self.spark.read.parquet(f"{self.path}/nodes")
        merged = each.groupBy("key").agg(F.sum("documents").alias("documents"), F.min("first").alias("e"))
        return merged.select("key", "e.name", "e.kind", "documents")

    def edges(self) -> DataFrame:
        """source, target, relation, weight."""
        each = self.spark.read.parquet(f"{self.path}/edges")
        return each.groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"))

    def compact(self, target: str) -> StoredGraph:
        """The same graph as one batch in another folder."""
        out = StoredGraph(self.spark, target)
        sums = self.spark.read.parquet(f"{self.path}/nodes").groupBy("key").agg(F.sum("documents").alias("documents"), F.min("first").alias("first"))
        sums.write.mode("overwrite").parquet(f"{target}/nodes/batch=0")
        self.edges().write.mode("overwrite").parquet(f"{target}/edges/batch=0")
        return out
