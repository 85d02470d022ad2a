"""Alerts over metrics: rules that have to hold for a time and then rest for a time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.folds import fold_sorted
from ..operators.audit import COMPARE


@dataclass(frozen=True)
class Rule:
    """A metric's comparison with a threshold that has to hold for ``hold`` seconds; after an alert the rule rests for ``cooldown`` seconds."""

    name: str
    metric: str
    comparator: str
    threshold: float
    hold: float = 0.0
    severity: str = "warning"
    cooldown: float = 300.0


# The default rules.
DEFAULT_RULES = (
    Rule("high_recall_latency", "recall_latency", "gt", 200.0, 120.0),
    Rule("high_error_rate", "error_rate", "gt", 0.05, 300.0, "error"),
    Rule("storage_capacity", "storage_utilization", "gt", 0.85),
    Rule("security_threat", "injection_detections", "gt", 5.0, 60.0, "critical"),
    Rule("rate_limit_violations", "rate_limit_violations", "gt", 10.0, 60.0),
)


def judged(samples: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, key, t, hit, hold, cooldown, severity: each sample (metric, key, ts, value) under the rules of its metric; t in microseconds, samples without a value or time left out."""
    each = [
        F.when(F.col("metric") == r.metric, F.struct(F.lit(r.name).alias("rule"), COMPARE[r.comparator](F.col("value"), F.lit(r.threshold)).alias("hit"), F.lit(round(r.hold * 1e6)).cast("long").alias("hold"), F.lit(round(r.cooldown * 1e6)).cast("long").alias("cooldown"), F.lit(r.severity).alias("severity")))
        for r in rules
    ]
    found = samples.filter("value IS NOT NULL AND ts IS NOT NULL").select("key", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    return found.select("r.rule", "key", "ts", F.unix_micros("ts").alias("t"), "r.hit", "r.hold", "r.cooldown", "r.severity")


def runs(samples: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, key, started, ended, hold, cooldown, severity: how long each rule held; ``ended`` is the first sample at which it no longer did, null for a run that goes on.

    Of samples of one time a hit counts. Runs are found where hits begin and end, without gathering a series.
    """
    own = judged(samples, rules).groupBy("rule", "key", "t", "hold", "cooldown", "severity").agg(F.max("hit").alias("hit"))
    order = Window.partitionBy("rule", "key").orderBy("t")
    edges = own.withColumn("_before", F.coalesce(F.lag("hit").over(order), F.lit(False))).filter("hit <> _before")
    started = edges.withColumn("ended", F.lead("t").over(order)).filter("hit")
    return started.select("rule", "key", F.col("t").alias("started"), "ended", "hold", "cooldown", "severity")


def fires_at(started: int, hold: int, cooldown: int, last: int | None) -> int:
    """When a run fires unless it ends before: it has held, and the rule has rested."""
    return started + hold if last is None else max(started + hold, last + cooldown)


def fired(samples: DataFrame, rules: tuple[Rule, ...], as_of: datetime) -> DataFrame:
    """rule, key, severity, fired_at, resolved_at of the alerts up to a time, one for a run; null where the run goes on.

    Alerts of a rule and key depend on the last one, so their runs are folded in order; there
    are far fewer of them than samples.
    """
    until = pd.Timestamp(as_of).tz_localize("UTC") if pd.Timestamp(as_of).tz is None else pd.Timestamp(as_of)
    now = until.value // 1000
    kind = samples.schema["key"].dataType.simpleString()

    def step(last: list[int], row: dict) -> list[dict]:
        at = fires_at(row["started"], row["hold"], row["cooldown"], last[0] if last else None)
        if at > now or row["ended"] is not None and at >= row["ended"]:
            return []
        last[:] = [at]
        return [{"rule": row["rule"], "key": row["key"], "severity": row["severity"], "fired": at, "resolved": row["ended"] if row["ended"] is not None and row["ended"] <= now else None}]

    found = fold_sorted(runs(samples, rules), ["rule", "key"], [F.col("started")], f"rule string, key {kind}, severity string, fired long, resolved long", list, step)
    return found.select("rule", "key", "severity", F.timestamp_micros("fired").alias("fired_at"), F.timestamp_micros("resolved").alias("resolved_at"))


def alert_stream(samples: DataFrame, rules: tuple[Rule, ...], late: str = "0 seconds") -> DataFrame:
    """rule, key, severity, at, event of a stream of samples (metric, key, ts, value): ``fired`` and ``resolved``, as ``fired`` finds them in all samples.

    Samples wait in the state of their rule and key until the watermark passes them, so those
    that come late, within ``late``, are taken in order. A timer in event time fires a run that
    has held long enough without a further sample.
    """
    kind = samples.schema["key"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, hits, started, last, open_alert, hold, cooldown, severity = state.get if state.exists else ([], [], None, None, False, 0, 0, "")
        waiting, hits, out = list(waiting), list(hits), []
        for pdf in batches if not state.hasTimedOut else ():
            waiting += pdf["t"].tolist()
            hits += pdf["hit"].tolist()
            if len(pdf):
                hold, cooldown, severity = int(pdf["hold"].iloc[0]), int(pdf["cooldown"].iloc[0]), pdf["severity"].iloc[0]
        mark = state.getCurrentWatermarkMs() * 1000
        ready: dict[int, bool] = {}
        for t, hit in zip(waiting, hits):
            if t < mark:
                ready[t] = ready.get(t, False) or bool(hit)
        left = [(t, h) for t, h in zip(waiting, hits) if t >= mark]

        def fire(until: int) -> None:
            nonlocal last, open_alert
            at = fires_at(started, hold, cooldown, last)
            if at < until:
                out.append((at, "fired"))
                last, open_alert = at, True

        for t in sorted(ready):
            if started is not None and not open_alert:
                fire(t)
            if ready[t] and started is None:
                started = t
            elif not ready[t] and started is not None:
                if open_alert:
                    out.append((t, "resolved"))
                started, open_alert = None, False
        if started is not None and not open_alert:
            fire(mark)
        state.update(([t for t, _ in left], [h for _, h in left], started, last, open_alert, hold, cooldown, severity))
        due = [t for t, _ in left] + ([fires_at(started, hold, cooldown, last)] if started is not None and not open_alert else [])
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"rule": key[0], "key": key[1], "severity": severity, "at": pd.to_datetime([t for t, _ in out], unit="us"), "event": [e for _, e in out]})

    marked = judged(samples, rules).withWatermark("ts", late)
    return marked.groupBy("rule", "key").applyInPandasWithState(
        step, f"rule string, key {kind}, severity string, at timestamp, event string",
        "waiting array<long>, hits array<boolean>, started long, last long, open_alert boolean, hold long, cooldown long, severity string", "append", GroupStateTimeout.EventTimeTimeout,
    )


def as_events(alerts: DataFrame) -> DataFrame:
    """rule, key, severity, at, event of the alerts of ``fired``, as the stream gives them."""
    event = lambda c, name: F.struct(F.col(c).alias("at"), F.lit(name).alias("event"))
    both = alerts.select("rule", "key", "severity", F.explode(F.array(event("fired_at", "fired"), event("resolved_at", "resolved"))).alias("e"))
    return both.select("rule", "key", "severity", "e.at", "e.event").filter("at IS NOT NULL")


def samples_of(series: DataFrame, metrics: dict[str, Column], key: str, ts: str) -> DataFrame:
    """metric, key, ts, value: a row for each metric of a series of buckets."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()))
    return series.select(F.explode(each).alias("m"), F.col(key).alias("key"), F.col(ts).alias("ts")).select("m.metric", "key", "ts", "m.value")
