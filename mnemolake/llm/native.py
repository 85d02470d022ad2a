"""Column expressions that the DataFrame operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the texts of one group of documents that a Python worker holds at once, about.
GROUP_BYTES = 32 << 20
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shifted(array: Column, n: int) -> Column:
    """The array without its first n items."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array) - n, F.lit(0)))


def joined_hashes(hashes: Column, other: Column) -> Column:
    """Hash of each pair of two arrays' items, as long as the second."""
    return F.zip_with(F.slice(hashes, F.lit(1), F.size(other)), other, lambda a, b: F.xxhash64(a, b))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole_number(df: DataFrame, name: str) -> Column:
    """A column of whole numbers as long; others are refused."""
    kind = df.select(quoted(name)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} must hold whole numbers, not {kind}")
    return quoted(name).cast("long")


def groups_by_bytes(df: DataFrame, text: str, partitions: int | None = None) -> tuple[int, int]:
    """(groups to deal rows to, bytes of their texts): two for each shuffle partition, more where they would be over GROUP_BYTES."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * (partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-size // GROUP_BYTES)), size


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each led by as many underscores as keep it apart from the columns in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def join_split(rows: DataFrame, table: DataFrame, key: str, weight: str, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and the number of its rows as ``weight``.

    The ``hot`` keys of the largest weight are broadcast, at most that many rows; the others,
    of which each has under 1 / ``hot`` of all rows, are joined by shuffle.
    """
    top = F.broadcast(table.orderBy(F.desc(weight), key).limit(hot))
    others = rows.join(top.select(key), key, "left_anti").join(table.hint("merge"), key)
    return rows.join(top, key).unionByName(others)
