"""Keyed state over time: rate limits and working memory, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.folds import fold_sorted
from ..operators.store import MemoryTable

# Tokens that a working memory holds, summed importance at which it should reflect, summaries it keeps.
CAPACITY, REFLECT_AT, SUMMARIES = 128_000, 10.0, 5
TOKENS_A_WORD = 1.3


def permit(log: list[float], t: float, window: float, most: int) -> bool:
    """Whether a time is permitted: fewer than ``most`` permits of the window up to it; a permit is added to the log, a denial isn't."""
    log[:] = [x for x in log if x >= t - window]
    if len(log) < most:
        log.append(t)
        return True
    return False


def acquire(logs: dict[str, list[float]], operation: str, t: float, window: float, most: int, most_in_all: int | None) -> bool:
    """A permit of an operation, and of the limit of all operations together; where that denies, the first is taken back."""
    own = logs.setdefault(operation, [])
    if not permit(own, t, window, most):
        return False
    if most_in_all is None or permit(logs.setdefault("", []), t, window, most_in_all):
        return True
    own.pop()
    return False


def rate_limited(events: DataFrame, window: float, most: int, most_in_all: int | None = None, user: str = "user_id", operation: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """tie, allowed: events of each user in order of time, under a limit for each operation and one for all.

    Denied events don't count. Only users with more events than a limit go through the fold.
    """
    least = most if most_in_all is None else min(most, most_in_all)
    n = events.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    own = events.select(F.col(user).alias("user"), F.col(operation).alias("operation"), F.col(tie).alias("id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    busy = own.join(n.filter(F.col("_n") > least).select(F.col(user).alias("user")), "user", "left_semi")
    idle = own.join(n.filter(F.col("_n") <= least).select(F.col(user).alias("user")), "user", "left_semi")

    def step(logs: dict, row: dict) -> list[dict]:
        return [{tie: row["id"], "allowed": acquire(logs, str(row["operation"]), row["t"], window, most, most_in_all)}]

    kind = events.schema[tie].dataType.simpleString()
    out = fold_sorted(busy, ["user"], [F.col("t"), F.col("id")], f"{tie} {kind}, allowed boolean", dict, step)
    return out.unionByName(idle.select(F.col("id").alias(tie), F.lit(True).alias("allowed")))


def limit_status(allowed: DataFrame, at: datetime, window: float, most: int, keys: tuple[str, ...] = ("user_id", "event_type"), ts: str = "ts") -> DataFrame:
    """keys, max_permits, remaining, seconds_to_reset at a time, from the permitted events up to it; a key without permits has all of them and a whole window."""
    now = F.lit(at)
    age = (F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    inside = allowed.filter((age >= 0)).groupBy(*keys).agg(F.count_if(age <= window).alias("used"), F.max(F.when(age <= window, age)).alias("oldest"))
    left = F.lit(window) - F.coalesce("oldest", F.lit(0.0))
    return inside.select(
        *keys, F.lit(most).cast("long").alias("max_permits"), F.greatest(F.lit(most) - F.col("used"), F.lit(0)).cast("long").alias("remaining"), F.when(left > 0, left).otherwise(F.lit(window)).alias("seconds_to_reset")
    )


def reset_limits(allowed: DataFrame, resets: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The permitted events that still count after resets (user, reset_at): those after the user's last."""
    last = resets.groupBy(user).agg(F.max("reset_at").alias("_reset"))
    return allowed.join(last, user, "left").filter(F.col("_reset").isNull() | (F.col(ts) > F.col("_reset"))).drop("_reset")


def rate_limit_stream(events: DataFrame, window: float, most: int, most_in_all: int | None = None) -> DataFrame:
    """The same over a stream of user_id, event_type, event_id, ts with a watermark on ts; state expires with the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        seconds = (pdf["ts"].astype("int64") / {"ns": 1e9, "us": 1e6}[pdf["ts"].dt.unit]).tolist()
        names, times = state.get if state.exists else ([], [])
        logs: dict[str, list[float]] = {}
        for name, t in zip(names, times):
            logs.setdefault(name, []).append(t)
        out = [acquire(logs, str(o), t, window, most, most_in_all) for o, t in zip(pdf["event_type"], seconds)]
        flat = [(name, t) for name, log in logs.items() for t in log]
        state.update(([x for x, _ in flat], [t for _, t in flat]))
        state.setTimeoutTimestamp(max(int((seconds[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": key[0], "event_type": pdf["event_type"], "allowed": out})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, event_type string, allowed boolean", "names array<string>, permits array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def first_sentence(text: str) -> str:
    """The default summary of a context."""
    return text.split(".")[0]


def count_tokens(text: str) -> int:
    return int(len(text.split()) * TOKENS_A_WORD) if text else 0


def new_memory(capacity: int = CAPACITY) -> dict:
    return {"core": "", "context": "", "summaries": [], "importance": 0.0, "capacity": capacity, "tokens": 0}


def _counted(memory: dict) -> None:
    memory["tokens"] = count_tokens(memory["core"] + memory["context"] + " ".join(memory["summaries"]))


def replace(memory: dict, location: str, content: str) -> str | None:
    """Put a text in place of the core or the context; returns what was there. Other locations are refused."""
    slot = {"core": "core", "core_memory": "core", "context": "context", "conversation": "context", "conversation_context": "context"}.get(location.lower())
    if slot is None:
        raise ValueError(f"unknown memory location: {location}; valid ones are core and context")
    before, memory[slot] = memory[slot], content
    _counted(memory)
    return before


def snapshot(memory: dict) -> dict:
    """A copy that later changes leave alone."""
    return {**memory, "summaries": list(memory["summaries"])}


def truncate(memory: dict) -> str:
    """Cut the first third of the context, or up to the next end of a paragraph, or else of a sentence, before its middle; returns it."""
    context = memory["context"]
    cut = len(context) // 3
    for end in ("\n\n", ". "):
        at = context.find(end, cut)
        if 0 < at < len(context) * 0.5:
            cut = at + 2
            break
    memory["context"] = context[cut:]
    _counted(memory)
    return context[:cut]


def append(memory: dict, text: str, importance: float) -> tuple[str, bool]:
    """Add a message after a blank line; (what was cut for the archive past 90 % of the capacity, whether reflection is due)."""
    memory["context"] = f"{memory['context']}\n\n{text}" if memory["context"] else text
    memory["importance"] += importance
    _counted(memory)
    cut = truncate(memory) if memory["tokens"] > memory["capacity"] * 0.9 else ""
    return cut, memory["importance"] >= REFLECT_AT


def reflect(memory: dict, summary: Callable[[str], str] = first_sentence) -> str | None:
    """Sum up the context: the summary joins the last SUMMARIES, the last two of which become the context; returns what to archive, none for a blank context."""
    content = memory["context"]
    if not content.strip():
        return None
    memory["summaries"] = [*memory["summaries"], summary(content)][-SUMMARIES:]
    memory["context"] = "\n".join(memory["summaries"][-2:])
    memory["importance"] = 0.0
    _counted(memory)
    return content


def manage(memory: dict, most: int, summary: Callable[[str], str] = first_sentence) -> tuple[str, str | None]:
    """(action, archived): up to 85 % of ``most`` tokens nothing; else reflect, and if over 90 % are left cut the context too, which is not archived."""
    memory["capacity"] = most
    if memory["tokens"] <= most * 0.85:
        return "none", None
    archived = reflect(memory, summary)
    action = "none" if archived is None else "summarized"
    if memory["tokens"] > most * 0.9 and truncate(memory):
        action = "combined" if action == "summarized" else "pruned"
    return action, archived


def remember(memory: dict, text: str, importance: float, manage_at: int | None) -> list[tuple[str, str]]:
    """A message added, and the context managed where ``manage_at`` names its tokens; returns what is archived as (reason, text)."""
    cut, _ = append(memory, text, importance)
    archived = [("truncation", cut)] if cut else []
    if manage_at is not None:
        _, reflected = manage(memory, manage_at)
        archived += [("reflection", reflected)] if reflected else []
    return archived


def working_memory(messages: DataFrame, session: str = "conv_id", order: str = "turn", capacity: int = CAPACITY, manage_at: int | None = None) -> DataFrame:
    """session, n_messages, tokens, context_chars, importance, reflection_due, n_summaries, n_archived after each session's messages (text, importance)."""

    def start() -> dict:
        return new_memory(capacity) | {"n": 0, "archived": 0}

    def step(memory: dict, row: dict) -> list[dict]:
        memory["archived"] += len(remember(memory, row["text"] or "", row["importance"], manage_at))
        memory["n"] += 1
        return []

    def finish(memory: dict, row: dict) -> list[dict]:
        return [{
            session: row[session], "n_messages": memory["n"], "tokens": memory["tokens"], "context_chars": len(memory["context"]), "importance": round(memory["importance"], 6),
            "reflection_due": memory["importance"] >= REFLECT_AT, "n_summaries": len(memory["summaries"]), "n_archived": memory["archived"],
        }]

    kind = messages.schema[session].dataType.simpleString()
    schema = f"{session} {kind}, n_messages long, tokens long, context_chars long, importance double, reflection_due boolean, n_summaries long, n_archived long"
    return fold_sorted(messages.select(session, order, "text", "importance"), [session], [F.col(order)], schema, start, step, finish)


def archived_texts(messages: DataFrame, session: str = "conv_id", order: str = "turn", capacity: int = CAPACITY, manage_at: int | None = None) -> DataFrame:
    """session, place, reason, text of what the sessions' messages send to the archive, numbered in each session from 1, in rows for ``archival_rows``."""

    def step(memory: dict, row: dict) -> list[dict]:
        sent = remember(memory, row["text"] or "", row["importance"], manage_at)
        memory["archived"] += len(sent)
        return [{session: row[session], "place": memory["archived"] - len(sent) + k + 1, "reason": reason, "text": text} for k, (reason, text) in enumerate(sent)]

    kind = messages.schema[session].dataType.simpleString()
    start = lambda: new_memory(capacity) | {"archived": 0}
    return fold_sorted(messages.select(session, order, "text", "importance"), [session], [F.col(order)], f"{session} {kind}, place long, reason string, text string", start, step)


def archival_rows(archived: DataFrame, first_id: int, at: datetime, session: str = "conv_id") -> DataFrame:
    """Archived texts as memories of the user ``system``: semantic, of importance 0.7, with their source and session as metadata; ids follow from the session and the place in it."""
    return archived.select(
        (F.lit(first_id) + F.pmod(F.xxhash64(session, "place"), F.lit(1 << 40))).alias("id"), F.lit("system").alias("user_id"), F.col("text").alias("content"), F.lit(at).alias("created_at"),
        F.lit(0.7).alias("importance"), F.lit(0).alias("access_count"), F.lit(1).alias("type"), F.create_map(F.lit("source"), "reason", F.lit("session_id"), F.col(session).cast("string")).alias("metadata"),
        F.lit(False).alias("is_deleted"),
    )


def working_memory_stream(messages: DataFrame, session: str = "conv_id", order: str = "turn", capacity: int = CAPACITY, manage_at: int | None = None) -> DataFrame:
    """session, place, reason, text of what each micro-batch archives; the session's memory is its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, place = new_memory(capacity), 0
        if state.exists:
            memory["context"], memory["importance"], memory["summaries"], place = state.get[0], state.get[1], list(state.get[2]), state.get[3]
            _counted(memory)
        out = []
        for text, weight in pd.concat(list(batches)).sort_values(order)[["text", "importance"]].itertuples(index=False):
            out += remember(memory, text or "", weight, manage_at)
        state.update((memory["context"], memory["importance"], memory["summaries"], place + len(out)))
        yield pd.DataFrame([(key[0], place + k + 1, *x) for k, x in enumerate(out)], columns=[session, "place", "reason", "text"])

    kind = messages.schema[session].dataType.simpleString()
    return messages.groupBy(session).applyInPandasWithState(
        step, f"{session} {kind}, place long, reason string, text string", "context string, importance double, summaries array<string>, place long", "append", GroupStateTimeout.NoTimeout
    )


def archive_stream(messages: DataFrame, table: MemoryTable, checkpoint: str, first_id: int, at: datetime, session: str = "conv_id", capacity: int = CAPACITY, manage_at: int | None = None) -> StreamingQuery:
    """The stream that keeps what sessions archive as memories of ``table``, as all messages at once would give it; runs over what is there and ends.

    A micro-batch is one version of the table, by its number, and written once however often it
    is tried; ids follow from the session and place, so a batch that comes again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.append_once(archival_rows(batch, first_id, at, session), number + 1)

    archived = working_memory_stream(messages, session, capacity=capacity, manage_at=manage_at)
    return archived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts_stream(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """bucket, event_type, n, total of a stream by tumbling windows under a watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")
