"""The memory table: appended versions on Parquet, folded when read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TYPES, latest

ORDERS = {
    "created_desc": F.desc, "created_asc": F.asc, "updated_desc": F.desc, "updated_asc": F.asc, "importance_desc": F.desc, "access_desc": F.desc,
}
_ORDER_COLUMNS = {"created": "created_at", "updated": "updated_at", "importance": "importance", "access": "access_count"}


def scope(df: DataFrame, user: str | None = None, session: str | None = None, types: list[int] | None = None, since: datetime | None = None, until: datetime | None = None, deleted: bool = False) -> DataFrame:
    """Rows of a tenant, session, types and inclusive date range; tombstones only if asked for."""
    if user:
        df = df.filter(F.col("user_id") == user)
    if session is not None:
        df = df.filter(F.col("session_id") == session)
    if types:
        df = df.filter(F.col("type").isin(types))
    if since is not None:
        df = df.filter(F.col("created_at") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("created_at") <= F.lit(until))
    return df if deleted else df.filter(~F.col("is_deleted"))


def ordered(df: DataFrame, order: str = "created_desc", skip: int = 0, limit: int | None = None, key: str = "id") -> DataFrame:
    """A page in one of ORDERS, ties by key."""
    df = df.orderBy(ORDERS[order](_ORDER_COLUMNS[order.split("_")[0]]), F.asc(key))
    df = df.offset(skip) if skip > 0 else df
    return df if limit is None else df.limit(limit)


def scan_newest(df: DataFrame, user: str | None = None, session: str | None = None, types: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """The scan that knows tenant, session and types only, newest first."""
    return ordered(scope(df, user, session, types), "created_desc", limit=limit)


def scroll(df: DataFrame, user: str | None = None, types: list[int] | None = None, cap: int = 10_000) -> DataFrame:
    """Up to ``cap`` rows by id."""
    return scope(df, user, types=types).orderBy("id").limit(cap)


def require_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows as they are; a row without a vector fails the job that reads them."""
    checked = F.when(F.col(vector_col).isNotNull(), F.col(vector_col)).otherwise(F.raise_error(F.lit(f"{vector_col} is missing")).cast(df.schema[vector_col].dataType))
    return df.withColumn(vector_col, checked)


def count_by_tenant(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def multi_get(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows of the ids in request order, repeats included, with their ordinal."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), "ordinal long, asked long")
    return df.join(F.broadcast(asked), F.col(key) == F.col("asked")).drop("asked").orderBy("ordinal")


def soft_delete(df: DataFrame, condition: Column, now: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({"is_deleted": F.col("is_deleted") | hit, "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def hard_delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids, key, "left_anti")


def replace_rows(df: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """``changed`` in place of the rows with the same key; keys that don't occur are not added."""
    present = changed.join(df.select(key), key, "left_semi")
    return df.join(changed.select(key), key, "left_anti").unionByName(present)


def missing_rows(source: DataFrame, destination: DataFrame, key: str = "id") -> DataFrame:
    """The rows that a migration copies."""
    return source.join(destination.select(key), key, "left_anti")


def migration_counts(source: DataFrame, destination: DataFrame, key: str = "id", tenant: str = "user_id") -> DataFrame:
    """tenant, n_source, n_destination, complete, by a full outer join of two aggregates."""
    a = source.groupBy(tenant).agg(F.count(F.lit(1)).alias("n_source"))
    b = destination.groupBy(tenant).agg(F.count(F.lit(1)).alias("n_destination"))
    both = a.join(b, tenant, "full_outer").select(tenant, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_source", "n_destination")))
    return both.withColumn("complete", F.col("n_destination") >= F.col("n_source"))


def migrate(source: DataFrame, destination: "MemoryTable", tenants: list[str], version: int) -> DataFrame:
    """tenant, migrated, skipped, status: copies the tenants' rows that the destination lacks, in one job.

    Without tenants nothing is copied, and the one row has the status ``skipped``. A failure
    to write is a status ``failed`` with its message for every tenant, not an error.
    """
    spark = source.sparkSession
    schema = "tenant string, migrated long, skipped long, status string, error string"
    if not tenants:
        return spark.createDataFrame([(None, 0, 0, "skipped", "no tenants named")], schema)
    own = source.filter(F.col("user_id").isin(tenants))
    known = destination.read().select("id") if destination.exists() else own.select("id").limit(0)
    present = own.join(known, "id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("skipped"))
    missing = missing_rows(own, known)
    counts = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(present, "user_id", "left").fillna(0, ["skipped"]).collect()  # a row for each tenant named
    error = None
    try:
        destination.append(missing, version)
    except Exception as e:
        error = str(e).splitlines()[0]
    found = {r["user_id"]: (r["n"], r["skipped"]) for r in counts}
    rows = []
    for t in tenants:
        n, skipped = found.get(t, (0, 0))
        rows.append((t, 0 if error else n - skipped, skipped, "failed" if error else "completed", error))
    return spark.createDataFrame(rows, schema)


def type_code(name: Column) -> Column:
    """The code of a type name; unknown names are episodic."""
    codes = F.create_map(*(F.lit(x) for k, t in enumerate(TYPES) for x in (t, k)))
    return F.coalesce(F.element_at(codes, F.lower(name)), F.lit(0))


class MemoryTable:
    """Memories under a folder, one appended version for each write, of a number of its own; the clock is the caller's.

    A row that moves to another tenant leaves a removed row of the same version in the folder of
    the former, so that reading one tenant's folder gives what reading all does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, df: DataFrame, version: int) -> None:
        """All rows of ``df`` in one committed job, partitioned by tenant."""
        marks = {c: F.lit(False) for c in ("removed", "moved") if c not in df.columns}
        df.withColumns(marks | {"version": F.lit(version).cast("long")}).write.mode("append").partitionBy("user_id").parquet(self.path)

    def append_once(self, df: DataFrame, version: int) -> bool:
        """Append the rows unless there are none or the version is there already, as for a batch that is tried again; whether they were."""
        if df.isEmpty() or self.exists() and not self.spark.read.parquet(self.path).filter(F.col("version") == version).isEmpty():
            return False
        self.append(df, version)
        return True

    def _current(self, df: DataFrame) -> DataFrame:
        """The last version of each row; of one version, that of the tenant it moved to."""
        stays = df.withColumn("_stays", ~F.col("moved"))
        return latest(stays, "id", "version", "_stays").filter(~F.col("removed")).drop("_stays", "moved")

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, user: str | None = None) -> DataFrame:
        """Current rows, tombstones included, removed ones not; a tenant reads only its own folders."""
        df = self.spark.read.parquet(self.path)
        return self._current(df.filter(F.col("user_id") == user) if user else df)

    def get(self, key: int, user: str | None = None) -> DataFrame:
        """The current row of a key, tombstones included; only its own versions are read, and a tenant's folders if it is named."""
        df = self.spark.read.parquet(self.path).filter(F.col("id") == key)
        return self._current(df.filter(F.col("user_id") == user) if user else df)

    def multi_get(self, ids: list[int]) -> DataFrame:
        return multi_get(self.read(), ids)

    def list(self, order: str = "created_desc", skip: int = 0, limit: int | None = None, **scopes) -> DataFrame:
        return ordered(scope(self.read(scopes.get("user")), **scopes), order, skip, limit)

    def count(self, user: str | None = None, tombstones: bool = False) -> int:
        return scope(self.read(user), user, deleted=tombstones).count()

    def search(self, query, k: int = 5, floor: float | None = None, **scopes) -> DataFrame:
        from .search import dense_topk

        return dense_topk(scope(self.read(scopes.get("user")), **scopes), query, k, floor)

    def delete(self, ids: DataFrame, now: datetime, version: int, hard: bool = False) -> None:
        gone = self.read().join(ids, "id", "left_semi")
        gone = gone.withColumns({"is_deleted": F.lit(True), "removed": F.lit(hard)}) if hard else soft_delete(gone, F.lit(True), F.lit(now))
        self.append(gone.drop("version"), version)

    def update(self, changed: DataFrame, now: datetime, version: int) -> int:
        """Replace rows that exist; returns how many did, counted as they were written."""
        known = self.read().select("id", F.col("user_id").alias("_former"))
        present = changed.join(known, "id").withColumn("updated_at", F.lit(now))
        seen = Observation()
        present = present.observe(seen, F.count(F.lit(1)).alias("n"))
        # a row for the new tenant, and one that removes it where the former tenant's rows are
        own = F.struct(F.col("user_id").alias("user_id"), F.lit(False).alias("moved"))
        left = F.struct(F.col("_former").alias("user_id"), F.lit(True).alias("moved"))
        each = F.explode(F.when(F.col("user_id").eqNullSafe(F.col("_former")), F.array(own)).otherwise(F.array(own, left)))
        rows = present.withColumn("_to", each).withColumns({"user_id": F.col("_to.user_id"), "moved": F.col("_to.moved")})
        removed = F.col("moved") | (F.col("removed") if "removed" in changed.columns else F.lit(False))
        self.append(rows.withColumn("removed", removed).drop("_former", "_to"), version)
        return seen.get["n"]

    def health(self) -> DataFrame:
        """path, status, rows, error: whether the table can be read; an error is a value."""
        schema = "path string, status string, rows long, error string"
        try:
            return self.spark.createDataFrame([(self.path, "healthy", self.read().count(), None)], schema)
        except Exception as e:
            return self.spark.createDataFrame([(self.path, "unavailable", 0, str(e).splitlines()[0])], schema)

    def statistics(self) -> DataFrame:
        """user_id, versions, rows, live: what is stored, for the decision to compact."""
        stored = self.spark.read.parquet(self.path).groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"))
        current = self.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("is_deleted")).alias("live"))
        return stored.join(current, "user_id", "left").fillna(0, ["rows", "live"])

    def compact(self, target: str) -> None:
        """Current rows as one version in another folder."""
        self.read().withColumns({"moved": F.lit(False), "version": F.lit(0).cast("long")}).write.mode("overwrite").partitionBy("user_id").parquet(target)


def within_retention(df: DataFrame, days: dict[str, int], as_of: datetime, default: int = 365) -> DataFrame:
    """Rows no older than their tenant's days of retention."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in days.items() for x in kv)), F.col("user_id")), F.lit(default)) if days else F.lit(default)
    return df.filter(F.col("created_at") >= F.lit(as_of) - F.make_dt_interval(limit))


def over_quota(df: DataFrame, quota: int) -> DataFrame:
    """user_id, n of tenants with more live rows than the quota."""
    return count_by_tenant(df).filter(F.col("n") > quota)


def allowed_types(df: DataFrame, types: dict[str, list[int]]) -> DataFrame:
    """Rows of a type that their tenant may hold; tenants that are not named may hold all."""
    if not types:
        return df
    known = F.create_map(*(F.lit(x) if k == 0 else F.array(*map(F.lit, x)) for kv in types.items() for k, x in enumerate(kv)))
    own = F.element_at(known, F.col("user_id"))
    return df.filter(own.isNull() | F.array_contains(own, F.col("type")))
