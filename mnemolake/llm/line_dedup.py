"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed, a hash that occurs more than once gets
its first place by a partial aggregate, and occurrences after it go back to their
document, where the covered lines are merged and removed. Windows join their first
places by shuffle, all but those of the ``HOT`` commonest hashes: these are broadcast, so
that a window found in a third of all documents is never gathered in one task, and no
shuffled hash has more than 1 / ``HOT`` of all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native

#: Broadcast hashes; at most so many rows of a few dozen bytes.
HOT = 1000
LINES = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = LINES) -> DataFrame:
    """_id, _th (hash of the whole text), pos, h: the windows of n lines that hold a word each."""
    text = native.quoted(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(native.WORD))
    df = docs.select(native.quoted(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.transform(lines, lambda line: F.xxhash64(line)).alias("_h1"))
    df = df.filter(F.size("_h1") >= n)
    joined = F.col("_h1")
    for k in range(1, n):
        joined = native.joined_hashes(joined, native.shifted(F.col("_h1"), k))
    return df.select("_id", "_th", F.posexplode(joined).alias("pos", "h"))


def later_windows(windows: DataFrame) -> DataFrame:
    """_id, _th, pos of the windows that occur before, by (_id, pos), null ids first."""
    place = F.struct("_id", "pos")
    firsts = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    found = native.join_split(windows, firsts, "h", "n", HOT)
    return found.filter(place > F.col("first")).select("_id", "_th", "pos")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = LINES) -> DataFrame:
    """The rows of ``docs`` with repeated lines removed from the text, and ``n_lines``, ``n_removed_lines``.

    A window is n consecutive lines with a word; lines without one are passed over and stay.
    A line goes if a window that covers it occurs before, in order of (id, place in the
    text), null ids first. Rows with one id and one text are one document: their windows
    don't remove each other. A null text stays null and has 0 lines; a text of fewer than n
    lines with a word stays. Windows are compared by 64-bit hashes. The order of the other
    columns stays; columns named ``n_lines`` or ``n_removed_lines`` are replaced. A very long
    text is worked through line by line in one row; its windows are rows of their own.
    """
    text = native.quoted(text_col)
    gone = later_windows(line_windows(docs, id_col, text_col, n)).groupBy("_id", "_th").agg(F.collect_set("pos").alias("_pos"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    gone_id, gone_th, own_th, pos, all_lines, gone_lines = native.fresh(kept_columns, "_gone_id", "_gone_th", "_line_th", "_pos", "_lines", "_covered")
    gone = gone.select(F.col("_id").alias(gone_id), F.col("_th").alias(gone_th), F.col("_pos").alias(pos))
    base = docs.select(*(native.quoted(c) for c in kept_columns), F.xxhash64(text).alias(own_th))
    df = base.join(gone, native.quoted(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own_th) == F.col(gone_th)), "left")
    df = df.withColumn(all_lines, F.split(text, "\n"))
    places = F.filter(F.transform(all_lines, lambda line, i: F.when(line.rlike(native.WORD), i)), lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(pos, lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: p + k))))
    covered = native.let(places, lambda own: F.transform(covered, lambda j: F.get(own, j)))
    df = df.withColumn(gone_lines, F.when(F.col(pos).isNotNull(), covered))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone_lines)
    kept_text = native.let(F.col(all_lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))
    new_text = F.when(F.col(gone_lines).isNull(), text).otherwise(kept_text)
    out = [new_text.alias(c) if c == text_col else native.quoted(c) for c in kept_columns]
    counts = (F.coalesce(F.size(all_lines), F.lit(0)), F.coalesce(F.size(gone_lines), F.lit(0)))
    return df.select(*out, *(F.greatest(x, F.lit(0)).cast("long").alias(c) for x, c in zip(counts, ("n_lines", "n_removed_lines"))))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents} WHERE text IS NOT NULL))
), worded AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), windows AS (
  SELECT doc_id, j, [line, lead(line) OVER w, lead(line, 2) OVER w] AS three, lead(j, 2) OVER w AS last FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY j)
), ordered AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY three ORDER BY doc_id, j) AS n FROM windows WHERE last IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest([j, j + 1, j + 2]) AS j FROM ordered WHERE n > 1
), gone AS (
  SELECT w.doc_id, w.i FROM worded w JOIN covered c ON w.doc_id = c.doc_id AND w.j = c.j
), counted AS (
  SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.i) AS BIGINT) AS n_removed_lines,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)"""

ORACLE_SQL = LINE_SQL.format(documents="documents") + """
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed_lines, 0) AS n_removed_lines, c.text
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
