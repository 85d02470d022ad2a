"""Audit, lineage, sessions, alerts and metric series over event relations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_sorted
from ..functions.ranks import ranked

# Actions and outcomes that set the severity of an audit row, in order.
CRITICAL_ACTIONS, WARNING_ACTIONS = ("injection_attempt", "suspicious_activity"), ("pii_detected", "rate_limit_exceeded", "login_failed")
OUTCOME_SEVERITY = {"denied": "warning", "failure": "error", "blocked": "warning"}


def severity(action: Column, outcome: Column) -> Column:
    """How grave a row is: by its action, and else by its outcome."""
    out = F.when(action.isin(*CRITICAL_ACTIONS), "critical").when(action.isin(*WARNING_ACTIONS), "warning")
    for name, level in OUTCOME_SEVERITY.items():
        out = out.when(outcome == name, level)
    return out.otherwise("info")


def audit_events(events: DataFrame) -> DataFrame:
    """Events as audit rows: five tenants, errors are failures."""
    outcome = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("tenant"), "user_id", F.col("event_type").alias("action"),
        outcome.alias("outcome"), severity(F.col("event_type"), outcome).alias("severity"), "value",
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows (action, outcome, ts and others) with their severity, appended by day."""
    graded = rows.withColumns({"severity": severity(F.col("action"), F.col("outcome")), "day": F.to_date("ts")})
    graded.write.mode("append").partitionBy("day").parquet(path)


# Kinds of lineage events, and the relation that a merge adds.
LINEAGE_KINDS = ("created", "updated", "accessed", "deleted", "merged")
MERGED_FROM = "merged_from"


def lineage_events(rows: DataFrame, kind: str, details: dict[str, Column] | None = None) -> DataFrame:
    """memory_id, kind, user_id, ts, details, related of rows (memory_id, user_id, ts; for merges source_ids): one event for each."""
    if kind not in LINEAGE_KINDS:
        raise ValueError(f"unknown kind of lineage event: {kind}")
    own = dict(details or {})
    related = F.col("source_ids") if kind == "merged" else F.array().cast("array<bigint>")
    if kind == "merged":
        own["sourceCount"] = F.size("source_ids").cast("string")
    pairs = [x for k, v in own.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select("memory_id", F.lit(kind).alias("kind"), "user_id", "ts", made.alias("details"), related.alias("related"))


def lineage_relations(events: DataFrame) -> DataFrame:
    """memory_id, related_id, relation, ts: what merges relate."""
    return events.filter("kind = 'merged'").select("memory_id", F.explode("related").alias("related_id"), F.lit(MERGED_FROM).alias("relation"), "ts")


def lineage_query(events: DataFrame, memory: int | None = None, kinds: list[str] | None = None, since: datetime | None = None, until: datetime | None = None, limit: int = 100) -> DataFrame:
    """Lineage events, newest first."""
    events = events if memory is None else events.filter(F.col("memory_id") == memory)
    events = events if not kinds else events.filter(F.col("kind").isin(kinds))
    events = events if since is None else events.filter(F.col("ts") >= F.lit(since))
    events = events if until is None else events.filter(F.col("ts") <= F.lit(until))
    return events.orderBy(F.desc("ts"), "memory_id").limit(limit)


def related_memories(relations: DataFrame, memory: int, relation: str | None = None) -> DataFrame:
    """What a memory is related to, of one relation if it is named."""
    own = relations.filter(F.col("memory_id") == memory)
    return own if relation is None else own.filter(F.col("relation") == relation)


def audit_query(
    audit: DataFrame, tenant: int | None = None, user: int | None = None, actions: list[str] | None = None, outcome: str | None = None, severities: list[str] | None = None,
    since: datetime | None = None, until: datetime | None = None, skip: int = 0, limit: int = 100,
) -> DataFrame:
    """A page of audit rows, newest first."""
    equal = {"tenant": tenant, "user_id": user, "outcome": outcome}
    for c, x in equal.items():
        audit = audit if x is None else audit.filter(F.col(c) == x)
    for c, xs in (("action", actions), ("severity", severities)):
        audit = audit if not xs else audit.filter(F.col(c).isin(xs))
    audit = audit if since is None else audit.filter(F.col("ts") >= F.lit(since))
    audit = audit if until is None else audit.filter(F.col("ts") <= F.lit(until))
    audit = audit.orderBy(F.desc("ts"), F.desc("event_id"))
    return (audit.offset(skip) if skip else audit).limit(limit)


def audit_statistics(audit: DataFrame) -> DataFrame:
    """action, outcome, severity, n, users by grouping sets: one pass gives each breakdown and the total (all null)."""
    sets = [[F.col("action")], [F.col("outcome")], [F.col("severity")], []]
    grouped = audit.groupingSets(sets, "action", "outcome", "severity")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("outcome") == "failure").alias("failures"))


def newest(df: DataFrame, key: str, n: int = 1, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The n newest rows of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def session_summary(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_chars, tokens, roles, last_turn of sessions."""
    chars = F.coalesce(F.char_length("text"), F.lit(0))
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(chars).cast("long").alias("n_chars"), F.sum(F.floor(chars / 4)).cast("long").alias("tokens"), F.count_distinct("role").alias("roles"), F.max("turn").alias("last_turn")
    )


def create_session(sessions: DataFrame, user: str, at: datetime, name: str | None = None) -> DataFrame:
    """The sessions (user_name, session_name, created_at, ended_at) with one more, named by the time unless it has a name."""
    own = (user, name or f"Session {at:%Y-%m-%d %H:%M}", at, None)
    return sessions.unionByName(sessions.sparkSession.createDataFrame([own], "user_name string, session_name string, created_at timestamp, ended_at timestamp"), allowMissingColumns=True)


def update_session(sessions: DataFrame, user: str, name: str, **values) -> DataFrame:
    """The sessions with new values, as for ``ended_at``, in one of them."""
    hit = (F.col("user_name") == user) & (F.col("session_name") == name)
    return sessions.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete_session(sessions: DataFrame, user: str, name: str) -> DataFrame:
    return sessions.filter(~((F.col("user_name") == user) & (F.col("session_name") == name)))


def list_sessions(sessions: DataFrame, user: str, active: bool = False) -> DataFrame:
    """A user's sessions, newest first, those that have not ended if asked for."""
    own = sessions.filter(F.col("user_name") == user)
    return (own.filter(F.col("ended_at").isNull()) if active else own).orderBy(F.desc("created_at"), "session_name")


def get_or_create(sessions: DataFrame, user: str, name: Column) -> DataFrame:
    """The user's newest open session, or one with the name."""
    own = sessions.filter((F.col("user_name") == user) & F.col("ended_at").isNull())
    return own.agg(F.coalesce(F.max_by("session_name", "created_at"), name).alias("session_name"))


def metric_series(events: DataFrame, width: str = "1 day") -> DataFrame:
    """bucket, event_type, n, mean, most of a value by tumbling windows."""
    grouped = events.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("bucket"), "event_type", "n", "mean", "most")


def percentiles(events: DataFrame, group: str = "event_type", value: str = "value", tie: str = "event_id", shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles of a value by group, from ranks over sorted ranges: no group comes into one task."""
    rows = ranked(events.filter(F.col(value).isNotNull()).select(group, value, tie), group, F.col(value), F.col(tie))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.round(F.col("size") * p, 9)))
    return rows.groupBy(group).agg(*(F.max(F.when(F.col("rank") == at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares))


def health_report(audit: DataFrame) -> DataFrame:
    """tenant, operations, failure_rate, security_events, users, status of each tenant: degraded from 5 % failures, unhealthy from 20 %."""
    own = audit.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("operations"), F.avg((F.col("outcome") == "failure").cast("double")).alias("failure_rate"),
        F.count_if(F.col("severity").isin("critical", "warning")).alias("security_events"), F.count_distinct("user_id").alias("users"),
    )
    status = F.when(F.col("failure_rate") >= 0.2, "unhealthy").when(F.col("failure_rate") >= 0.05, "degraded").otherwise("healthy")
    return own.withColumn("status", status)


COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def alerts(series: DataFrame, metric: str, comparator: str, threshold: float, runs: int = 1, key: str = "event_type", ts: str = "bucket") -> DataFrame:
    """Rows of a series at which the comparison has held for ``runs`` buckets and not for one more: the start of an alert."""
    order = Window.partitionBy(key).orderBy(ts)
    hit = COMPARE[comparator](F.col(metric), F.lit(threshold)).cast("int")
    df = series.withColumn("_hit", hit)
    last, more = F.sum("_hit").over(order.rowsBetween(1 - runs, 0)), F.sum("_hit").over(order.rowsBetween(-runs, 0))
    n = F.count(F.lit(1)).over(order.rowsBetween(1 - runs, 0))
    return df.withColumns({"_last": last, "_more": more, "_n": n}).filter((F.col("_n") == runs) & (F.col("_last") == runs) & (F.col("_more") == runs)).select(key, ts, metric)


def cooled(starts: DataFrame, key: str, ts: str, cooldown: float) -> DataFrame:
    """Alert starts without those within ``cooldown`` seconds of the last one that was sent for the key."""
    kind = starts.schema[key].dataType.simpleString()

    def step(last: list, row: dict) -> list[dict]:
        if last and row["t"] - last[0] < cooldown:
            return []
        last[:] = [row["t"]]
        return [{key: row[key], ts: row[ts]}]

    own = starts.select(key, ts, F.unix_seconds(F.col(ts).cast("timestamp")).alias("t"))
    return fold_sorted(own, [key], [F.col("t")], f"{key} {kind}, {ts} {starts.schema[ts].dataType.simpleString()}", list, step)


# Permissions of roles, as bits.
READ_OWN, WRITE_OWN, DELETE_OWN, READ_ALL, WRITE_ALL, DELETE_ALL, AUDIT, ADMIN = (1 << k for k in range(8))
ROLES = {"guest": READ_OWN, "user": READ_OWN | WRITE_OWN | DELETE_OWN, "auditor": READ_ALL | AUDIT, "manager": READ_ALL | WRITE_ALL | AUDIT, "admin": (1 << 8) - 1}


def allowed(granted: Column, own: int, every: int, is_owner: Column) -> Column:
    """Whether the bits permit an action on a row: on all rows, or on one's own."""
    has = lambda bit: granted.bitwiseAND(F.lit(bit)) != 0
    return has(every) | has(ADMIN) | (has(own) & is_owner)
