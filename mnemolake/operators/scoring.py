"""Recency, frequency, importance and their blends, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

DECAY, MAX_ACCESS = 0.99, 100

# Words that raise or lower importance.
HIGH_WORDS = (
    "important", "critical", "urgent", "remember", "never forget", "always", "must", "essential", "key", "priority", "deadline", "requirement",
    "decision", "agreement", "promise", "password", "secret", "credential", "api key", "token",
)
MEDIUM_WORDS = ("note", "fyi", "update", "change", "prefer", "like", "want", "need", "should", "would", "plan", "goal", "project", "task", "meeting", "schedule")
LOW_WORDS = ("hello", "hi", "thanks", "thank you", "okay", "ok", "sure", "yes", "no", "maybe", "test", "example")
# Patterns of structure, entities and specific statements.
BULLET = "(?m)^[\\s]*[-*\u2022]\\s"
#: Edges of a word, for tests of presence.
_BEFORE, _AFTER = "(?:^|[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}])", "(?:$|[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}])"
EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
URL = "https?://[^\\s]+"
NUMBER = f"(?<!{tx.IN_WORD})[0-9]++(?!{tx.IN_WORD})"
DATE = f"{_BEFORE}(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}){_AFTER}"
TIME = f"{_BEFORE}[0-9]{{1,2}}:[0-9]{{2}}{_AFTER}"
CURRENCY = "[$\u20ac\u00a3\u00a5\u20a9][0-9]+|[0-9]+[$\u20ac\u00a3\u00a5\u20a9]"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(last_access: Column, created: Column, as_of: Column, decay: float = DECAY) -> Column:
    """decay to the hours since the last access, or since creation."""
    hours = (F.unix_micros(as_of) - F.unix_micros(F.coalesce(last_access, created))) / F.lit(3.6e9)
    return clamp(F.pow(F.lit(decay), hours), 0.0, 1.0)


def frequency(count: Column, most: int = MAX_ACCESS) -> Column:
    """log share of the expected largest count."""
    return clamp(F.log1p(count.cast("double")) / math.log1p(most), 0.0, 1.0) if most > 0 else F.lit(0.0)


def combined(recent: Column, importance: Column, relevance: Column, frequent: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> Column:
    return alpha * recent + beta * importance + gamma * F.coalesce(relevance, F.lit(0.5)) + 0.1 * frequent


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def importance_parts(text: Column, kind: Column) -> dict[str, Column]:
    """keywords, structure, kind, entities and specificity bonuses."""
    lower = F.lower(text)
    words = F.regexp_count(text, F.lit("[^ ]+"))
    # most texts lack the mark that a pattern needs, and are spared the search for it
    # where only presence counts, one character of a run is as good as the run, and is found in one pass
    has = lambda p, x, mark: F.when(mark & text.rlike(p), F.lit(x)).otherwise(F.lit(0.0))
    holds = lambda s: F.contains(text, F.lit(s))
    names, numbers = F.regexp_count(text, F.lit(tx.CAPITALIZED)), F.regexp_count(text, F.lit(NUMBER))
    return {
        "keywords": clamp(0.15 * _hits(lower, HIGH_WORDS) + 0.05 * _hits(lower, MEDIUM_WORDS) - 0.02 * _hits(lower, LOW_WORDS), -0.2, 0.3),
        "structure": F.when(words > 100, F.lit(0.10)).when(words >= 10, F.lit(0.05)).otherwise(F.lit(0.0))
        + has(BULLET, 0.1, holds("-") | holds("*") | holds("\u2022"))
        + F.when(F.contains(text, F.lit("?")), F.lit(0.05)).otherwise(F.lit(0.0))
        + F.when(F.contains(text, F.lit("!")), F.lit(0.03)).otherwise(F.lit(0.0)),
        "kind": F.when(kind == 2, F.lit(0.15)).when(kind == 3, F.lit(0.1)).when(kind == 1, F.lit(0.05)).otherwise(F.lit(0.0)),
        "entities": F.when(names > 2, F.least(F.lit(0.1), 0.02 * names)).otherwise(F.lit(0.0)) + has(EMAIL.replace("+@", "@", 1), 0.1, holds("@")) + has(URL, 0.05, holds("http")),
        "specificity": F.least(F.lit(0.1), 0.03 * numbers) + has(DATE, 0.1, numbers > 0) + has(TIME, 0.05, holds(":")) + has(CURRENCY.replace("]+", "]"), 0.1, F.lit(True)),
    }


def importance(text: Column, kind: Column) -> Column:
    """Importance of a text from 0.1 to 1; blank texts get 0.1."""
    total = sum(importance_parts(text, kind).values(), F.lit(0.5))
    return F.when(F.coalesce(text, F.lit("")).rlike("\\S"), clamp(total, 0.1, 1.0)).otherwise(F.lit(0.1))


def importance_label(x: Column) -> Column:
    return F.when(x >= 0.8, "critical").when(x >= 0.6, "high").when(x >= 0.4, "medium").when(x >= 0.2, "low").otherwise("minimal")


def manual_importance(x: Column) -> Column:
    """An importance that a user sets, within 0 and 1."""
    return clamp(x, 0.0, 1.0)


# Words that make a message matter to working memory, and marks of code.
WORKING_WORDS = ("important", "critical", "remember", "note", "key", "essential", "must", "priority", "urgent", "significant")
CODE_MARKS = ("```", "function", "class")


def working_importance(text: Column, words: tuple[str, ...] = WORKING_WORDS) -> Column:
    """Importance of a message to working memory, up to 5; 0 for an empty one."""
    text = F.coalesce(text, F.lit(""))
    question = F.contains(text, F.lit("?")).cast("int")
    code = (sum((F.contains(text, F.lit(m)).cast("int") for m in CODE_MARKS), F.lit(0)) > 0).cast("int")
    total = 0.5 + F.least(F.regexp_count(text, F.lit("[^ \n]+")) / 100, F.lit(2.0)) + 0.5 * _hits(F.lower(text), words) + 0.3 * question + 0.5 * code
    return F.when(text == "", F.lit(0.0)).otherwise(F.least(F.lit(5.0), total))


def access_events(rows: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """key, at: the record that recalled rows were read, to be appended to the access log."""
    return rows.select(key, at.alias("at"))


def with_access(memories: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Memories with the log folded in: access_count, last_accessed_at and updated_at follow the accesses."""
    folded = log.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.max("at").alias("_last"))
    both = memories.join(folded, key, "left")
    later = lambda c: F.greatest(F.col(c), F.col("_last")) if c in memories.columns else F.col("_last")
    columns = {"access_count": (F.col("access_count") + F.coalesce("_times", F.lit(0))).cast("int"), "last_accessed_at": later("last_accessed_at"), "updated_at": later("updated_at")}
    return both.withColumns(columns).drop("_times", "_last")
