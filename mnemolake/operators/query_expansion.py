"""Query expansion by synonyms and contexts; the maps are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as vx

# Synonyms of query words and context terms of query phrases.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "who": ("person", "people", "team", "member", "colleague"),
    "when": ("time", "date", "schedule", "deadline"),
    "where": ("location", "place", "address"),
    "how": ("method", "way", "process", "approach"),
    "why": ("reason", "cause", "purpose"),
    "build": ("create", "develop", "implement", "make", "construct"),
    "use": ("utilize", "employ", "work with", "apply"),
    "work": ("job", "task", "project", "employment"),
    "plan": ("schedule", "roadmap", "strategy", "intention", "future"),
    "feature": ("functionality", "capability", "component", "module"),
    "bug": ("issue", "error", "problem", "defect"),
    "code": ("program", "script", "implementation", "software"),
    "tech": ("technology", "technical", "stack", "framework"),
    "team": ("colleague", "member", "coworker", "collaborator"),
    "member": ("person", "colleague", "teammate"),
    "future": ("upcoming", "later", "next", "plan", "will"),
    "past": ("previous", "before", "earlier", "history"),
    "challenge": ("difficulty", "problem", "issue", "obstacle"),
    "tool": ("software", "application", "utility", "program"),
    "meeting": ("call", "standup", "sync", "discussion"),
}
CONTEXTS: dict[str, tuple[str, ...]] = {
    "building": ("developing", "implementing", "creating", "working on"),
    "features": ("workout", "nutrition", "sleep", "tracking", "logging", "functionality"),
    "team members": ("Mike", "Sarah", "colleague", "collaborator", "working with"),
    "future plans": ("planning", "will add", "next", "upcoming", "roadmap", "social", "AI"),
    "tech stack": ("React", "Node", "MongoDB", "GraphQL", "framework", "library"),
    "dietary": ("vegetarian", "allergic", "food", "eat", "diet"),
    "pet": ("dog", "cat", "animal", "Max", "companion"),
    "programming": ("code", "development", "software", "language", "Rust", "Python"),
}
MAX_SYNONYMS, MAX_CONTEXTS = 3, 4


def expanded(query: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS, contexts: Mapping[str, Sequence[str]] = CONTEXTS) -> Column:
    """The query followed by synonyms of its words (over two letters) and terms of contexts that it holds, each once in any case."""
    lower = F.lower(query)
    words = F.filter(F.split(lower, "[^\\p{L}\\p{Nd}]+"), lambda w: F.char_length(w) > 2)
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v[:MAX_SYNONYMS])))))
    none = F.array().cast("array<string>")
    from_words = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), none)))
    from_contexts = F.flatten(F.array(*(F.when(F.contains(lower, F.lit(k)), F.array(*map(F.lit, v[:MAX_CONTEXTS]))).otherwise(none) for k, v in contexts.items())))
    more = F.filter(F.concat(from_words, from_contexts), lambda x: F.lower(x) != lower)
    first = F.filter(F.transform(more, lambda x, i: F.when(F.array_position(F.transform(more, F.lower), F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.when(F.trim(query) == "", query).otherwise(F.array_join(F.concat(F.array(query), first), " "))


def variants(
    queries: DataFrame, query_col: str = "query", limit: int = 3, synonyms: Mapping[str, Sequence[str]] = SYNONYMS, contexts: Mapping[str, Sequence[str]] = CONTEXTS
) -> DataFrame:
    """query_col, ordinal, variant: the query, then with the first synonym in place of a word that has one, then with the first term of a context that it holds after it.

    Each variant changes one word, wherever it stands and in any case; up to ``limit`` in all, each once.
    """
    query = F.col(query_col)
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.lit(v[0]))))
    words = F.filter(F.split(F.lower(query), "[^\\p{L}\\p{Nd}]+"), lambda w: (F.char_length(w) > 2) & F.element_at(known, w).isNotNull())
    swapped = F.transform(words, lambda w: F.regexp_replace(query, F.concat(F.lit("(?iu)"), w), F.element_at(known, w)))
    extended = F.array(*(F.when(F.contains(F.lower(query), F.lit(k)), F.concat(query, F.lit(" " + v[0]))) for k, v in contexts.items()))
    every = F.array_distinct(F.concat(F.array(query), swapped, F.filter(extended, lambda x: x.isNotNull())))
    every = F.when(F.trim(query) == "", F.array(query)).otherwise(F.slice(every, 1, limit))
    return queries.select(query_col, F.posexplode(every).alias("ordinal", "variant"))


# What a hypothetical answer says, by a word that the query holds; the first counts, the empty one always.
ANSWERS = (
    ("how", "The process involves the following steps: {}. First, you need to understand the requirements. Then, implement the solution step by step."),
    ("what", "The answer to '{}' is: This refers to a concept or entity that can be described as follows."),
    ("why", "The reason for '{}' is: There are several factors that contribute to this, including important considerations."),
    ("when", "Regarding '{}': The timing and circumstances are as follows, with specific dates and conditions."),
    ("", "Information about '{}': This topic involves key concepts and details that are relevant to understanding the subject matter."),
)


def hypothetical_answer(query: Column) -> Column:
    """A text that resembles an answer to the query, to be embedded beside it."""
    texts = (F.when(F.contains(F.lower(query), F.lit(word)), F.replace(F.lit(text), F.lit("{}"), query)) for word, text in ANSWERS)
    return F.coalesce(*texts)


def hypothetical_vector(query: Column, embed) -> Column:
    """The normalized mean of the vectors of the query and of its hypothetical answer; ``embed``: text to vector."""
    return vx.mean_of_two(embed(query), embed(hypothetical_answer(query)))
